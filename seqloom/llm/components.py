"""Connected components of a graph given as an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.session import drop_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex that has an edge.

    ``edges`` has the bigint columns ``a`` and ``b``. The result has a row
    (node, component) for every vertex of an edge; an empty edge table gives an
    empty result, self-loops and repeated edges do no harm. The result is a
    written table, which :func:`drop_table` removes.

    Each round takes the smallest label among the neighbours, for a vertex and
    also for the vertex that is its label, so that whole trees are hooked, and
    then replaces a label by that label's own label, which halves paths. Labels
    only fall, so rounds end; they go on until nothing moves, which for paths,
    grids and trees of n vertices took about log2(n) rounds whatever the order
    of their ids. Labels live in written tables, so a lost executor repeats
    part of one round only. The second join has a hot key where a component is
    large: both of its sides are plain scans, so that adaptive execution can
    split it.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = write_table(both.where("a <> b").distinct(), "cc-links")
    labels = write_table(
        links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")),
        "cc-labels",
    )
    while True:
        nearest = (
            links.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("low"))
        )
        around = write_table(labels.join(nearest, "node"), "cc-around")
        own = around.select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        roots = around.where("low < label").select(F.col("label").alias("node"), F.lit(None).cast("bigint").alias("was"), F.col("low").alias("label"))
        hooked = write_table(own.union(roots).groupBy("node").agg(F.max("was").alias("was"), F.min("label").alias("label")), "cc-hooked")
        parents = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = write_table(hooked.join(parents, "label").select("node", F.col("top").alias("label"), "was"), "cc-labels")
        moved = jumped.where("label <> was").limit(1).count()
        drop_table(labels)
        drop_table(around)
        drop_table(hooked)
        labels = jumped
        if not moved:
            drop_table(links)
            found = labels.select("node", F.col("label").alias("component"))
            found._written_at = labels._written_at
            return found
