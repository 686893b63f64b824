"""Hard negatives: Hilbert-ordered blocks of vectors, zone maps, and interval bounds that choose the blocks each anchor reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import drop_table, write_table

POSITIVES, NEGATIVES = 5, 10
ANCHOR_EVERY = 100

#: A negative's score lies between these percentages of its positive's.
LOW_PERCENT, HIGH_PERCENT = 30, 90

#: Vectors of a block, and blocks of a group, which a task reads together and a bit mask of 64 names.
BLOCK_ROWS, GROUP_BLOCKS = 256, 64

#: Groups whose zone maps a task holds, and anchors that a task holds.
ZONE_GROUPS, TILE_ANCHORS = 64, 8192

_SCALE = 256.0
_BITS = 3
_LONGEST = 1 << 28  # scaled vectors are shorter than this, so that all products fit 64 bits
_STRIP = 128
_NONE = -(1 << 62)
_FAR = 1 << 62


def hilbert_keys(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``levels`` (0 to 2^bits - 1 in each dimension), as bytes that sort like it.

    The curve in any number of dimensions is walked in transposed form: from the
    highest bit down, each dimension's lower bits are inverted or exchanged with
    those of the first, then the bits are read as a Gray code.
    """
    rows, dims = levels.shape
    x = levels.T.astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        lower = (1 << bit) - 1
        for d in range(dims):
            high = (x[d] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[d]) & lower)
            x[0] ^= np.where(high, lower, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(rows, np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    planes = [(x >> bit) & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _levels(v: np.ndarray) -> np.ndarray:
    """Direction of each row in 2^_BITS levels, finest where components of a long random vector lie."""
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.maximum(length, 1e-300) * np.sqrt(v.shape[1]) / 2
    return np.clip(np.floor((unit + 1) * (1 << (_BITS - 1))), 0, (1 << _BITS) - 1).astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vec, key) of the rows that take part: whole numbers floor(256 x) and the place on the curve."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        ok = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
        for dims in np.unique(sizes[ok]):
            rows = np.flatnonzero(ok & (sizes == dims))
            v = values[(ends[rows] - dims)[:, None] + np.arange(dims)] if dims else np.zeros((len(rows), 0))
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(_SCALE * v)
                good = np.isfinite(v).all(axis=1) & np.isfinite(scaled).all(axis=1)
                good[good] &= np.linalg.norm(scaled[good], axis=1) < _LONGEST
            rows, scaled = rows[good], scaled[good]
            keys = hilbert_keys(_levels(scaled), _BITS) if dims and len(rows) else np.zeros((len(rows), 1), np.uint8)
            code = scaled.astype(np.int32)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                ["id", "label", "vec", "key"],
            )


_BLOCK = "group bigint, block int, dims int, low_label bigint, high_label bigint, low_id bigint, low binary, high binary, ids binary, labels binary, vecs binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition as blocks, with least and greatest value of each dimension; vectors of unequal length part blocks."""
    made = 0

    def block(rows: list[tuple[int, int, bytes]]) -> tuple:
        nonlocal made
        ids, labels, vecs = zip(*rows, strict=True)
        v = np.frombuffer(b"".join(vecs), np.int32).reshape(len(rows), -1)
        low, high = (v.min(axis=0), v.max(axis=0)) if v.shape[1] else (v[0], v[0])
        group, number = divmod(made, GROUP_BLOCKS)
        made += 1
        return (
            TaskContext.get().partitionId() << 32 | group, number, v.shape[1], min(labels), max(labels), min(ids),
            low.tobytes(), high.tobytes(), np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), v.tobytes(),
        )

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    names = [part.split()[0] for part in _BLOCK.split(", ")]
    held: list[tuple[int, int, bytes]] = []

    def out(blocks: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (len(held) == BLOCK_ROWS or len(held[0][2]) != len(row[2])):
                done.append(block(held))
                held = []
            held.append(row)
        if done:
            yield out(done)
    if held:
        yield out([block(held)])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two tables of whole numbers."""
    size = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())) if x.size else 0.0
    if size(a) * size(b) < 1 << 52:  # then no partial sum leaves the whole numbers that doubles hold
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    some = np.arange(len(score))
    if len(some) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((ids[some], -score[some]))[:k]]


_ANCHOR = "anchor bigint, label bigint, vec binary, lows array<bigint>, highs array<bigint>, kths array<bigint>, kth_ids array<bigint>"


def _seeded(every: int, k: int, tile_of: int):
    """Anchors of each block, with one window without bounds whose kth score is that of their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for group, dims, ids, labels, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                v = np.frombuffer(vecs, np.int32).reshape(len(ids), dims)
                mine = np.flatnonzero(ids % every == 0)
                if not len(mine):
                    continue
                scores = _product(v[mine], v)
                for i, row in zip(mine, scores, strict=True):
                    other = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
                    best = other[_top(row[other], ids[other], k)]
                    full = len(best) == k
                    values = ((group >> 32) // tile_of, int(ids[i]), int(labels[i]), v[i].tobytes(), [int(row[best[-1]]) if full else _NONE], [int(ids[best[-1]]) if full else _FAR])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            longs = pa.list_(pa.int64())
            n = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()),
                    pa.array([[_NONE]] * n, longs), pa.array([[_FAR]] * n, longs), pa.array(out[4], longs), pa.array(out[5], longs),
                ],
                ["part", "anchor", "label", "vec", "lows", "highs", "kths", "kth_ids"],
            )

    return run


def _windows(anchors: pa.Table) -> list[np.ndarray]:
    """Low, high, kth score and kth id as tables of anchors by windows, padded with windows that nothing meets."""
    lists = [anchors[c].to_pylist() for c in ("lows", "highs", "kths", "kth_ids")]
    wide = max((len(x) for x in lists[0]), default=0)
    return [np.array([x + [pad] * (wide - len(x)) for x in column], np.int64).reshape(anchors.num_rows, wide) for column, pad in zip(lists, (_FAR, _NONE, _FAR, _FAR), strict=True)]


def needed(vectors: np.ndarray, label: np.ndarray, windows: list[np.ndarray], low: np.ndarray, high: np.ndarray, zones: tuple[np.ndarray, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks each anchor must read, and the greatest score a block can have for it.

    A dimension of a block spans [low, high]; times the anchor's component it
    spans an interval whose ends add up to bounds of all scores in the block. A
    block must be read if its labels allow it and for some window its scores
    can lie in the window and reach the kth score known so far; one that can
    only equal that needs an id below the kth's.
    """
    low_label, high_label, low_id = zones
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    upper = _product(up, high) + _product(down, low)
    lower = _product(up, low) + _product(down, high)
    own = label[:, None]
    allowed = (low_label <= own) & (own <= high_label) if same else ~((low_label == own) & (high_label == own))
    some = np.zeros(upper.shape, bool)
    for i in range(windows[0].shape[1]):
        at_least, at_most, kth, kth_id = (w[:, i][:, None] for w in windows)
        some |= (upper >= at_least) & (lower <= at_most) & ((upper > kth) | ((upper == kth) & (low_id <= kth_id)))
    return allowed & some, upper


_CHOICE = "tile bigint, group bigint, mask bigint, upper bigint, low_id bigint, " + _ANCHOR


def _choose(same: bool, best_only: bool):
    """Of a tile's anchors and some groups' zone maps: the blocks of each group that an anchor must read; or the one block with the greatest bound."""

    def run(zones: pa.Table, anchors: pa.Table) -> pa.Table:
        picked: list[tuple] = []
        if zones.num_rows and anchors.num_rows:
            group, block = zones["group"].to_numpy(), zones["block"].to_numpy().astype(np.uint64)
            width = zones["dims"].to_numpy()
            vecs, lows, highs = (anchors["vec"].to_pylist(), zones["low"].to_pylist(), zones["high"].to_pylist())
            length = np.array([len(v) // 4 for v in vecs])
            windows, label = _windows(anchors), anchors["label"].to_numpy()
            for dims in np.unique(width):
                z, every = np.flatnonzero(width == dims), np.flatnonzero(length == dims)
                z = z[np.argsort(group[z], kind="stable")]
                low, high = (np.frombuffer(b"".join(x[i] for i in z), np.int32).reshape(len(z), dims) for x in (lows, highs))
                about = tuple(zones[c].to_numpy()[z] for c in ("low_label", "high_label", "low_id"))
                starts = np.flatnonzero(np.concatenate(([True], group[z][1:] != group[z][:-1])))
                bit = np.uint64(1) << block[z]
                for first in range(0, len(every), _STRIP):
                    a = every[first : first + _STRIP]
                    v = np.frombuffer(b"".join(vecs[i] for i in a), np.int32).reshape(len(a), dims)
                    need, upper = needed(v, label[a], [w[a] for w in windows], low, high, about, same)
                    if best_only:
                        reach = np.where(need, upper, _NONE)
                        for i, row in zip(a, reach, strict=True):
                            if row.max() > _NONE:
                                at = np.flatnonzero(row == row.max())
                                j = at[about[2][at].argmin()]
                                picked.append((i, int(group[z][j]), int(bit[j]), int(row[j]), int(about[2][j])))
                        continue
                    masks = np.add.reduceat(np.where(need, bit, np.uint64(0)), starts, axis=1).view(np.int64)
                    for i, g in zip(*np.nonzero(masks), strict=True):
                        picked.append((a[i], int(group[z][starts[g]]), int(masks[i, g]), 0, 0))
        rows = anchors.take(pa.array([p[0] for p in picked], pa.int64()))
        out = {"tile": rows["tile"], "group": pa.array([p[1] for p in picked], pa.int64())}
        out["mask"] = pa.array([p[2] - (1 << 64) if p[2] >= 1 << 63 else p[2] for p in picked], pa.int64())
        out |= {"upper": pa.array([p[3] for p in picked], pa.int64()), "low_id": pa.array([p[4] for p in picked], pa.int64())}
        return pa.table(out | {c: rows[c] for c in ("anchor", "label", "vec", "lows", "highs", "kths", "kth_ids")})

    return run


def _read(same: bool, k: int):
    """The k best rows of each window of each anchor among the blocks of a group that it must read."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "window": [], "id": [], "score": []}
        if blocks.num_rows and anchors.num_rows:
            width, number = blocks["dims"].to_numpy(), blocks["block"].to_numpy().astype(np.uint64)
            ids, labels, vecs = (blocks[c].to_pylist() for c in ("ids", "labels", "vecs"))
            asked, own = anchors["vec"].to_pylist(), anchors["anchor"].to_numpy()
            length = np.array([len(v) // 4 for v in asked])
            windows, label, mask = _windows(anchors), anchors["label"].to_numpy(), anchors["mask"].to_numpy().view(np.uint64)
            for dims in np.unique(width):
                z, every = np.flatnonzero(width == dims), np.flatnonzero(length == dims)
                row_id, row_label = (np.frombuffer(b"".join(x[i] for i in z), np.int64) for x in (ids, labels))
                table = np.frombuffer(b"".join(vecs[i] for i in z), np.int32).reshape(len(row_id), dims)
                block = np.repeat(number[z], [len(ids[i]) // 8 for i in z])
                for first in range(0, len(every), _STRIP):
                    a = every[first : first + _STRIP]
                    scores = _product(np.frombuffer(b"".join(asked[i] for i in a), np.int32).reshape(len(a), dims), table)
                    for i, score in zip(a, scores, strict=True):
                        reads = (mask[i] >> block) & np.uint64(1) == 1
                        reads &= (row_label == label[i]) & (row_id != own[i]) if same else row_label != label[i]
                        reads = np.flatnonzero(reads)
                        for w in range(windows[0].shape[1]):
                            mine = score[reads]
                            fit = reads[(mine >= max(windows[0][i, w], windows[2][i, w])) & (mine <= windows[1][i, w])]
                            best = fit[_top(score[fit], row_id[fit], k)]
                            out["anchor"] += [int(own[i])] * len(best)
                            out["window"] += [w] * len(best)
                            out["id"] += row_id[best].tolist()
                            out["score"] += score[best].tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "window" else pa.int64()) for c, v in out.items()})

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = ANCHOR_EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): hard negatives of every ``anchor_every``-th id.

    Components x become floor(256 x); a score is the inner product of those.
    Positives are an anchor's best rows of its own label. For each of them the
    result has the best rows of other labels whose score is between
    ``low_percent`` and ``high_percent`` of the positive's, fewer where there
    are fewer; equal scores go by id.

    Rows are sorted by label, their place on a Hilbert curve and id, and written
    as blocks: a Parquet row holds a block's vectors, and in columns of its own
    its zone map, the least and greatest value of each dimension, label and id.
    Zone maps alone, read without the vectors, choose the blocks of an anchor:
    interval arithmetic bounds the scores in a block, and it is read only if
    they can meet a window of the anchor and reach the kth best score known
    (:func:`needed`). For positives that score comes from the anchor's own
    block, for negatives from the one block with the greatest bound, read first.
    So the result is exact. Anchors that are near on the curve are dealt
    together, and a task reads a group of blocks, those that any anchor of its
    tile needs; neither grows with the table. Work is at worst that of the
    anchors against all rows, where bounds exclude nothing.

    Rows with a null id or label, a null vector or any null or non-finite
    component take no part, nor do vectors of a scaled length of 2^28 and more,
    whose products would leave 64 bits. Labels are whole numbers. Rows that
    repeat an id count as one, that with the least label, then the least bytes
    of its vector. Only vectors of one length meet; empty ones have score 0.
    Empty tables give no rows. All columns but the three named are left aside.
    """
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    coded = source.mapInArrow(_coded, "id bigint, label bigint, vec binary, key binary")
    rows = write_table(coded.groupBy("id").agg(F.min(F.struct("label", "vec", "key")).alias("r")).select("id", "r.*"), "negatives-rows")
    n = rows.count()
    parts = max(1, -(-n // (BLOCK_ROWS * GROUP_BLOCKS)))
    order: list[str | Column] = ["label", F.length("vec"), "key", "id"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "label", "vec")
    blocks = write_table(placed.mapInArrow(_blocks, _BLOCK), "negatives-blocks")
    drop_table(rows)
    zones = blocks.select("group", "block", "dims", "low_label", "high_label", "low_id", "low", "high")
    tile_of = max(1, TILE_ANCHORS * anchor_every // (BLOCK_ROWS * GROUP_BLOCKS))
    seeded = blocks.select("group", "dims", "ids", "labels", "vecs").mapInArrow(_seeded(anchor_every, positives, tile_of), "part bigint, " + _ANCHOR)
    seeded = write_table(seeded, "negatives-anchors")
    most = seeded.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    split = max(1, -(-most[0] // TILE_ANCHORS))
    tiles = (most[1] + 1) * split
    tile = F.col("part") * split + F.pmod(F.xxhash64("anchor"), F.lit(split))
    anchors = seeded.withColumn("tile", tile).drop("part")
    zone_sets = max(1, -(-parts // ZONE_GROUPS))
    by_zone = zones.withColumn("zone", F.pmod(F.xxhash64("group"), F.lit(zone_sets))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))

    def choose(wanted: DataFrame, same: bool, best_only: bool = False) -> DataFrame:
        asked = wanted.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(zone_sets - 1)).cast("array<bigint>")))
        return by_zone.groupBy("tile", "zone").cogroup(asked.groupBy("tile", "zone")).applyInArrow(_choose(same, best_only), _CHOICE)

    def read(choice: DataFrame, same: bool, k: int) -> DataFrame:
        wanted = choice.groupBy(F.col("tile").alias("for_tile"), F.col("group").alias("of_group")).agg(F.bit_or("mask").alias("mask"))
        chosen = blocks.join(wanted, F.col("group") == F.col("of_group")).where("shiftright(mask, block) & 1 = 1")
        chosen = chosen.select(F.col("for_tile").alias("tile"), *blocks.columns)
        found = chosen.groupBy("tile", "group").cogroup(choice.groupBy("tile", "group")).applyInArrow(_read(same, k), "anchor bigint, window int, id bigint, score bigint")
        return _ranked(found, k)

    choice = write_table(choose(anchors, True), "negatives-choice")
    found = write_table(read(choice, True, positives).select("anchor", F.col("rank").alias("window"), "id", "score"), "negatives-positives")
    drop_table(choice)
    whole = lambda x, up: f"({x} + pmod(-({x}), 100L)) div 100" if up else f"({x} - pmod({x}, 100L)) div 100"
    spans = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "score"))).alias("p"))  # at most ``positives`` each
    spans = spans.select(
        "anchor",
        F.expr(f"transform(p, x -> {whole(f'{low_percent}L * x.score', True)})").alias("lows"),
        F.expr(f"transform(p, x -> {whole(f'{high_percent}L * x.score', False)})").alias("highs"),
        F.expr(f"transform(p, x -> {_NONE}L)").alias("kths"),
        F.expr(f"transform(p, x -> {_FAR}L)").alias("kth_ids"),
    )
    asking = write_table(anchors.select("tile", "anchor", "label", "vec").join(spans, "anchor"), "negatives-asking")
    likely = choose(asking, False, best_only=True)
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("upper"), "low_id", "group"))
    likely = write_table(likely.withColumn("rank", first).where("rank = 1").drop("rank"), "negatives-likely")
    kth = read(likely, False, negatives).where(F.col("rank") == negatives).groupBy("anchor").agg(F.collect_list(F.struct("window", "score", "id")).alias("k"))
    at = "filter(k, y -> y.window = i)"
    kth = write_table(kth, "negatives-kth")
    known = asking.join(kth, "anchor", "left").select(
        *[c for c in asking.columns if c not in ("kths", "kth_ids")],
        F.expr(f"transform(kths, (x, i) -> coalesce(get({at}, 0).score, x))").alias("kths"),
        F.expr(f"transform(kth_ids, (x, i) -> coalesce(get({at}, 0).id, x))").alias("kth_ids"),
    )
    choice = write_table(choose(known, False), "negatives-choice")
    hard = read(choice, False, negatives).select("anchor", (F.col("window") + 1).alias("window"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    positive = found.select("anchor", "window", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    result = write_table(positive.join(hard, ["anchor", "window"]).select("anchor", "positive", "rank", "negative", "positive_score", "negative_score"), "negatives-result")
    for table in (blocks, seeded, found, asking, likely, kth, choice):
        drop_table(table)
    return result
