"""Near-duplicate vectors within a label: int8 tile products with error bounds, full precision where those leave doubt."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import forest_edges
from seqloom.llm.components import connected_components
from seqloom.plans.session import drop_table, join_sized, write_table

THRESHOLD = 0.93

#: Vectors of a block, at least; a task holds two blocks at once.
TILE = 2048

#: Larger labels have blocks up to this size, for every block a label has more is a copy more of its vectors.
BLOCK_BYTES = 8 << 20
BLOCKS = 8
_STRIP = 256
_PAIRS = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit rows, the scale of each row, and the exact length of what quantising it lost."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - code * scale[:, None], axis=1)
    return code, scale, lost


def _tree_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the vertices a[i] and b[i] are joined; each vertex is labelled by one of its component."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of x and y; of x alone, i < j, if y is None) with cosine at least ``threshold`` in double precision.

    With v = v' + e for a unit vector, its dequantised form and the rest, the
    true product of v and w differs from that of v' and w' by at most
    |e_v| + (1 + |e_v|) |e_w|, since |w| = 1 and |v'| <= 1 + |e_v|. Products of
    int8 codes are whole numbers below 2^24 for up to a thousand components, so
    they are exact in single precision; wider vectors are multiplied in double.
    Only pairs whose product plus bound reaches the threshold are recomputed.
    """
    norm_x = np.linalg.norm(x, axis=1)
    code_x, scale_x, lost_x = quantise(x / norm_x[:, None])
    if y is None:
        norm_y, code_y, scale_y, lost_y = norm_x, code_x, scale_x, lost_x
    else:
        norm_y = np.linalg.norm(y, axis=1)
        code_y, scale_y, lost_y = quantise(y / norm_y[:, None])
    other = x if y is None else y
    kind = np.float32 if x.shape[1] <= 1000 else np.float64
    right = code_y.astype(kind).T
    for at in range(0, len(x), _STRIP):
        rows = slice(at, at + _STRIP)
        product = (code_x[rows].astype(kind) @ right).astype(np.float64)
        product *= scale_x[rows, None] * scale_y[None, :]
        product += lost_x[rows, None] + (1 + lost_x[rows, None]) * lost_y[None, :]
        i, j = np.nonzero(product >= threshold - 1e-9)
        i += at
        if y is None:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), _PAIRS):
            a, b = i[part : part + _PAIRS], j[part : part + _PAIRS]
            true = np.einsum("ij,ij->i", x[a], other[b]) / (norm_x[a] * norm_y[b])
            good = true >= threshold
            if good.any():
                yield a[good], b[good]


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, label, key, vec): key names the label and the vector, null where the row can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for number, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = vec = None
                if number is not None and label is not None and values and None not in values:
                    x = np.array(values, np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        vec = x.tobytes()
                        key = blake2b(label.encode() + b"\0" + vec, digest_size=16).hexdigest()
                keys.append(key)
                vectors.append(vec)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(vectors, pa.binary())], ["id", "label", "key", "vec"]
            )

    return rows.mapInArrow(run, "id bigint, label string, key string, vec binary")


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        own = table["block"].to_numpy()
        node = table["node"].to_numpy()
        many = table["n"].to_numpy()
        vectors = np.frombuffer(b"".join(table["vec"].to_pylist()), np.float64).reshape(len(node), -1)
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])  # exact, and no square overflows
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        label = np.arange(len(node))
        links = np.zeros(len(node), np.int64)
        for a, b in tile_links(vectors[left], None if low == high else vectors[right], threshold) if len(left) and len(right) else ():
            a, b = left[a], right[b]
            links += np.bincount(a, many[b], len(node)).astype(np.int64)
            links += np.bincount(b, many[a], len(node)).astype(np.int64)
            label = _tree_labels(label, a, b)
        some = np.flatnonzero(links)
        order = some[np.argsort(label[some], kind="stable")]
        groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []
        trees = [forest_edges(node[g]) for g in groups]
        none = np.zeros(0, np.int64)
        a = np.concatenate([none, *(t[0] for t in trees)])
        b = np.concatenate([none, *(t[1] for t in trees)])
        return pa.table(
            {
                "a": np.concatenate((node[some], a)),
                "b": pa.array([*[None] * len(some), *b.tolist()], pa.int64()),
                "links": pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64()),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """(id, n_links, component, kept) of every row: links join vectors of one label with cosine >= ``threshold``.

    Equal vectors of a label are one vertex with a count, so a vector that a
    third of all rows share is compared once. The vertices of a label are dealt
    by hash over blocks of about ``tile``, or, in labels that would have more
    than BLOCKS of them, of up to BLOCK_BYTES. Each pair of blocks is a task of
    its own: a large label makes many tasks of bounded size. A task returns the
    number of links of each vertex and a spanning forest with bounded degree,
    never the pairs, so dense groups cost no rows. A vector is shuffled once
    for each block of its label: products, and copies of vectors by blocks,
    grow with the square of a label's vectors.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label or id, link with nothing (n_links 0, component
    their own id, kept; a null id has neither component nor kept). Vectors of
    unequal length do not link. Repeated rows count as vectors each. Ids should
    name one vector; vertices are named by their smallest id, so where unlike
    vectors share one their links are counted together. Ties cannot arise.
    All columns but the three named are left aside.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    ready = write_table(_prepared(rows), "vectors-ready")
    usable = ready.where("key is not null").withColumn("label", F.concat_ws(":", "label", F.length("vec")))
    vertices = write_table(
        usable.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.min("label").alias("label"), F.first("vec").alias("vec")),
        "vectors-vertices",
    )
    sizes = vertices.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("width"))
    per_block = F.greatest(F.lit(tile), F.least(F.ceil(F.col("n") / BLOCKS), F.floor(F.lit(BLOCK_BYTES) / F.col("width"))))
    sizes = write_table(sizes.select("label", F.ceil(F.col("n") / per_block).cast("int").alias("blocks")), "vectors-sizes")
    dealt = join_sized(vertices, sizes, ["label"], "inner").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", other).select(
        "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "vec"
    )
    found = write_table(pairs.groupBy("label", "low", "high").applyInArrow(_tile(threshold), "a bigint, b bigint, links bigint"), "vectors-links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    members = connected_components(found.where("b is not null").select("a", "b"))
    named = (
        vertices.select("key", "node", "n")
        .join(links, "node", "left")
        .join(members.select("node", "component"), "node", "left")
        .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    named = write_table(named, "vectors-named")
    for table in (vertices, sizes, found, members):
        drop_table(table)
    joined = ready.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"), (F.col("id") == component).alias("kept")
    )

