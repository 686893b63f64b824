"""Exact nearest neighbours of binary codes by multi-index hashing with growing search radii."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import drop_table, write_bucketed, write_table

NEIGHBOURS = 10

#: Bytes of a segment, and the leading bits of its value by which postings are dealt.
SEGMENT_BYTES = 2
PREFIX_BITS = 3

#: Postings of one group, about; a larger group is dealt over several by the hash of the code.
GROUP_ROWS = 20_000

#: Groups of a bucket of the table, about; more where there would be too many buckets.
GROUPS_PER_BUCKET, MOST_BUCKETS = 4, 4096


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): the sign bits of each vector, most significant first, padded with zeros to whole segments.

    Null and empty vectors and those with null or NaN components have the code null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for values in batch.column(1).to_pylist():
                x = np.array(values or [], np.float64) if values and None not in values else None
                if x is None or np.isnan(x).any():
                    codes.append(None)
                    continue
                bits = np.packbits(x > 0)
                codes.append(bits.tobytes().ljust(-(-len(bits) // SEGMENT_BYTES) * SEGMENT_BYTES, b"\0"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, code binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment of a code: segment number and the leading bits of its value."""
    for batch in batches:
        segment, prefix, code, low, n = [], [], [], [], []
        for c, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            values = np.frombuffer(c, ">u2")
            segment += range(len(values))
            prefix += (values >> (16 - PREFIX_BITS)).tolist()
            code += [c] * len(values)
            low += [a] * len(values)
            n += [b] * len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(segment, pa.int32()), pa.array(prefix, pa.int32()), pa.array(code, pa.binary()), pa.array(low, pa.int64()), pa.array(n, pa.int64())],
            ["segment", "prefix", "code", "low", "n"],
        )


@lru_cache(maxsize=256)
def _masks(bits: int, ones: int) -> np.ndarray:
    """All values of ``bits`` bits of which just ``ones`` are set."""
    return np.array([sum(1 << bit for bit in chosen) for chosen in combinations(range(bits), ones)], np.uint16)


def probed(values: np.ndarray, asked: np.ndarray, prefix: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places in ``values``) of the buckets at just ``radius`` from the segment of each query.

    ``values`` are sorted and have the leading bits ``prefix``; those of a
    bucket are found by binary search for each mask, no others are looked at.
    """
    low_bits = 8 * SEGMENT_BYTES - PREFIX_BITS
    buckets, first = np.unique(values, return_index=True)
    end = np.append(first[1:], len(values))
    for q, value in enumerate(asked):
        spent = ((int(value) >> low_bits) ^ prefix).bit_count()
        if not 0 <= radius - spent <= low_bits:
            continue
        wanted = (prefix << low_bits | int(value) & ((1 << low_bits) - 1)) ^ _masks(low_bits, radius - spent)
        at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
        hit = at[buckets[at] == wanted]
        if len(hit):
            size = end[hit] - first[hit]
            yield q, np.repeat(first[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _verify(radius: int, wanted: int):
    """For each query of a group: read the buckets at just this radius from its segment, verify whole codes, keep the best."""

    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "code": [], "distance": [], "low": [], "n": []}
        if postings.num_rows and queries.num_rows:
            codes = postings["code"].to_pylist()
            segment, prefix = postings["segment"][0].as_py(), postings["prefix"][0].as_py()
            for width in {len(q) for q in queries["query"].to_pylist()}:
                asked = [q for q in queries["query"].to_pylist() if len(q) == width]
                same = np.array([i for i, c in enumerate(codes) if len(c) == width], np.int64)
                if not len(same):
                    continue
                table = np.frombuffer(b"".join(codes[i] for i in same), np.uint8).reshape(len(same), width)
                order = np.argsort(table.view(">u2")[:, segment], kind="stable")
                same, table = same[order], table[order]
                low, n = postings["low"].to_numpy()[same], postings["n"].to_numpy()[same]
                values = table.view(">u2")[:, segment].astype(np.uint16)
                probe = np.frombuffer(b"".join(asked), np.uint8).reshape(len(asked), width)
                for q, found in probed(values, probe.view(">u2")[:, segment].astype(np.uint16), prefix, radius):
                    distance = np.bitwise_count(table[found] ^ probe[q]).sum(axis=1, dtype=np.int64)
                    best = np.lexsort((low[found], distance))[:wanted]
                    rows = found[best]
                    out["query"] += [asked[q]] * len(best)
                    out["code"] += [codes[i] for i in same[rows]]
                    out["distance"] += distance[best].tolist()
                    out["low"] += low[rows].tolist()
                    out["n"] += n[rows].tolist()
        kinds = {"query": pa.binary(), "code": pa.binary(), "distance": pa.int64(), "low": pa.int64(), "n": pa.int64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest rows of ``codes`` by Hamming distance for each row of ``queries``, but for the row itself.

    Both have (id, code binary). The result is (query_id, neighbour_id,
    distance, rank): exact, by distance and then id, fewer where there are
    fewer rows.

    Codes are cut into segments of 16 bits. A round of radius r takes, for each
    segment, the codes whose segment differs from the query's in just r bits and
    verifies their whole distance. After it every code within
    segments * (r + 1) - 1 bits has been met, for one that differs in more bits
    in every segment is further away; a query ends when its kth verified
    distance is within that. Equal codes are one entry with its k + 1 smallest
    ids, equal queries are asked once. Postings are dealt by segment and leading
    bits of its value; groups over GROUP_ROWS are dealt further by the code's
    hash, so a value that a third of the codes share stays in bounded groups.
    The groups are a bucketed table, which rounds read without a shuffle; only
    queries are shuffled. A query goes only to groups whose leading bits are
    within the radius, reads there the buckets at just this radius, found by
    binary search, and gets at most k + 1 codes of a group.

    Null codes and null ids neither ask nor answer; a query finds only codes of
    its own length. Rows that repeat an id count as one.
    """
    spark = codes.sparkSession
    wanted = k + 1
    by_code = Window.partitionBy("code").orderBy("id")
    rows = codes.where("id is not null and code is not null").select("id", "code").distinct()
    kept = rows.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= wanted)
    index = write_table(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-index")
    asking = write_table(queries.where("id is not null and code is not null").select("id", "code").distinct(), "topk-queries")
    entries = index.select("code", F.element_at("ids", 1).alias("low"), F.size("ids").cast("bigint").alias("n"))
    postings = write_table(entries.mapInArrow(_postings, "segment int, prefix int, code binary, low bigint, n bigint"), "topk-postings")
    sizes = postings.groupBy("segment", "prefix").count().withColumn("deals", F.ceil(F.col("count") / F.lit(GROUP_ROWS)).cast("int"))
    counts = [tuple(r) for r in sizes.select("segment", "prefix", "deals").collect()]  # segments x 2^PREFIX_BITS rows at most
    deals = lambda: F.broadcast(spark.createDataFrame(counts, "segment int, prefix int, deals int"))
    group = ["segment", "prefix", "deal"]
    dealt = postings.join(deals(), ["segment", "prefix"]).withColumn("deal", F.pmod(F.xxhash64("code"), F.col("deals")).cast("int"))
    groups = sum(c[2] for c in counts)
    buckets = min(max(1, -(-groups // GROUPS_PER_BUCKET)), MOST_BUCKETS)
    dealt, forget = write_bucketed(dealt.select(*group, "code", "low", "n"), "topk-buckets", buckets, group)
    drop_table(postings)
    asked = active = write_table(asking.select(F.col("code").alias("query")).distinct(), "topk-asked")
    best = spark.createDataFrame([], "query binary, code binary, distance bigint, low bigint, n bigint, done boolean")
    masks = [(m, m.bit_count()) for m in range(1 << PREFIX_BITS)]
    for radius in range(8 * SEGMENT_BYTES + 1):
        if not active.limit(1).count():
            break
        near = F.array(*[F.lit(m) for m, bits in masks if bits <= radius])
        parts = active.select("query", F.posexplode(F.expr(f"transform(sequence(0, length(query) div {SEGMENT_BYTES} - 1), i -> conv(hex(substring(query, i * {SEGMENT_BYTES} + 1, {SEGMENT_BYTES})), 16, 10))")).alias("segment", "value"))
        own = F.shiftright(F.col("value").cast("int"), 16 - PREFIX_BITS)
        probes = parts.select("query", "segment", own.alias("own"), F.explode(near).alias("mask"))
        probes = probes.select("query", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("prefix")).join(deals(), ["segment", "prefix"])
        probes = probes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        found = dealt.groupBy(*group).cogroup(probes.groupBy(*group)).applyInArrow(
            _verify(radius, wanted), "query binary, code binary, distance bigint, low bigint, n bigint"
        )
        merged = best.select("query", "code", "distance", "low", "n").union(found).dropDuplicates(["query", "code"])
        order = Window.partitionBy("query").orderBy("distance", "low", "code")
        upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        covered = F.col("distance") <= (F.length("query") / SEGMENT_BYTES) * (radius + 1) - 1
        ranked = merged.withColumn("place", F.row_number().over(order)).withColumn("done", (upto >= wanted) & covered)
        before, best = best, write_table(ranked.where(F.col("place") <= wanted).drop("place"), "topk-best")
        drop_table(before)
        active = asked.join(best.where("done").select("query").distinct(), "query", "left_anti")
    answers = best.join(index, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    by_query = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    answers = answers.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= wanted)
    answers = write_table(answers.select("query", "distance", "neighbour_id"), "topk-answers")
    forget()
    for table in (index, asked, best):
        drop_table(table)
    each = asking.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(answers, "query")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return (
        each.where("query_id <> neighbour_id")
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= k)
        .select("query_id", "neighbour_id", "distance", "rank")
    )
