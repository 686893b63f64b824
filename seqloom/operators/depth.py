"""Read depth of a population by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

SAMPLE_SITES = 10_000
MOST_DEPTH = 200
MIN_MODE = 5
BLOCK = 500_000


def _profile(depths: DataFrame, n_taxa: int, chrom_lengths: DataFrame) -> DataFrame:
    """Mean and sample SD of the depths of n_taxa at every position; taxa without a row count as 0.

    Rows (taxon, chrom, pos, depth, per) are dealt once, by blocks of BLOCK
    positions; within a block they are summed by taxon, with ``per`` what a
    depth is divided by, then by position. Each covered position, and a row for
    each block, brings the positions up to the next one, so no table of all
    positions is shuffled or joined. Positions outside of a chromosome are left out.
    """
    block = F.floor((F.col("pos") - 1) / BLOCK).alias("block")
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("chrom_len") - 1) / BLOCK))).alias("block")
    blocks = chrom_lengths.where("chrom_len > 0").select("chrom", number, "chrom_len")
    begin, end = F.col("block") * BLOCK + 1, F.least(F.col("chrom_len"), (F.col("block") + 1) * BLOCK)
    none = F.lit(None)
    heads = blocks.select(none.cast("string").alias("taxon"), "chrom", begin.cast("int").alias("pos"), none.cast("double").alias("depth"), none.cast("double").alias("per"), "block", end.cast("int").alias("last"))
    rows = depths.select(F.col("taxon").cast("string"), "chrom", "pos", F.col("depth").cast("double"), F.col("per").cast("double"), block, none.cast("int").alias("last"))
    parts = int(depths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(heads).repartition(parts, "chrom", "block")
    each = dealt.groupBy("chrom", "block", "pos", "taxon").agg((F.sum("depth") / F.max("per")).alias("d"), F.max("last").alias("last"))
    sums = each.groupBy("chrom", "block", "pos").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.max("last").alias("last"))
    in_block = Window.partitionBy("chrom", "block")
    reach = sums.withColumn("last", F.max("last").over(in_block.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reach = reach.withColumn("next", F.lead("pos").over(in_block.orderBy("pos"))).where(F.col("pos") <= F.col("last"))
    until = F.least(F.coalesce(F.col("next") - 1, F.col("last")), F.col("last"))
    every = reach.select("chrom", F.col("pos").alias("at"), "s", "ss", F.explode(F.sequence("pos", until)).alias("pos"))
    here = lambda c: F.when(F.col("pos") == F.col("at"), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    s, ss = here("s"), here("ss")
    n = F.lit(float(n_taxa))
    sd = F.sqrt(F.greatest(F.try_divide(ss - s * s / n, n - 1), F.lit(0.0)))
    return every.select("chrom", "pos", F.round(s / n, 6).alias("mean"), F.round(sd, 6).alias("sd"))


def _per_taxon(depths: DataFrame) -> DataFrame:
    return depths.groupBy("taxon", "chrom", "pos").agg(F.sum("depth").cast("double").alias("d"))


def pop_depth(depths: DataFrame, taxa: DataFrame, chrom_lengths: DataFrame) -> DataFrame:
    """Mean and sample SD of depth over all taxa of the sheet at every position of every chromosome."""
    sheet = taxa.select("taxon").distinct()
    return _profile(join_sized(depths, sheet, ["taxon"], "inner").withColumn("per", F.lit(1)), sheet.count(), chrom_lengths)


def sample_sites(chrom_lengths: DataFrame, n: int = SAMPLE_SITES) -> DataFrame:
    """Evenly spaced sites: floor(n * length / all) of each chromosome, at floor(j * length / number + 1)."""
    total = F.sum("chrom_len").over(Window.partitionBy())
    share = chrom_lengths.withColumn("k", F.floor(F.lit(n).cast("double") * F.col("chrom_len") / total).cast("int")).where("k > 0")
    j = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    return share.withColumn("j", j).select("chrom", F.floor(F.col("j").cast("bigint") * F.col("chrom_len") / F.col("k") + 1).cast("int").alias("pos"))


def depth_mode(depths: DataFrame, chrom_lengths: DataFrame, n: int = SAMPLE_SITES) -> DataFrame:
    """The most frequent depth of each taxon, of at most MOST_DEPTH, at the sampled sites it covers; on ties the smallest."""
    at = _per_taxon(depths).join(sample_sites(chrom_lengths, n), ["chrom", "pos"]).where(F.col("d") <= MOST_DEPTH)
    counted = at.groupBy("taxon", F.col("d").cast("int").alias("depth")).count()
    return counted.groupBy("taxon").agg(F.max_by("depth", F.struct("count", -F.col("depth"))).alias("mode"))


def pop_depth_std(depths: DataFrame, modes: DataFrame, chrom_lengths: DataFrame, min_mode: int = MIN_MODE) -> DataFrame:
    """Mean and SD of depth divided by the taxon's mode, over the taxa whose mode is at least ``min_mode``."""
    good = modes.where(F.col("mode") >= min_mode)
    rows = join_sized(depths, good, ["taxon"], "inner").withColumn("per", F.col("mode"))
    return _profile(rows, good.count(), chrom_lengths)
