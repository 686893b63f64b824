"""The library tags nearest to each query tag, by an exact pigeonhole index over interleaved segments of their bases."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import drop_table, join_sized, write_table

TAG_LENGTH, CHUNK = 96, 16
BASES = 2 * TAG_LENGTH

#: Bases of R1 in which tags must agree.
GROUP = slice(8, 14)

#: A list of a segment with more library tags than this is parted by a second segment, one of two segments is dealt out.
LONGEST_LIST = 4096

#: Postings of a bucket, about, and pairs that are compared at once.
BUCKET_POSTINGS, PAIRS = 1 << 16, 1 << 18

_U = np.uint64
_NIBBLE = np.zeros(256, np.uint8)
for _code, _base in enumerate("ACMGRSVTWYHKDBN", 1):  # each letter for a set of bases is a number of its own; all other characters are one
    _NIBBLE[[ord(_base), ord(_base.lower())]] = _code
_WEIGHTS = np.random.default_rng(20_240_611).integers(1, 1 << 63, BASES + 1, np.uint64) | _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def packed_tags(tags: pa.Array) -> np.ndarray:
    """Rows of nibbles of tags, each cut or padded with A to BASES."""
    text = b"".join(t.encode("ascii", "replace")[:BASES].ljust(BASES, b"A") for t in tags.to_pylist())
    return _NIBBLE[np.frombuffer(text, np.uint8)].reshape(-1, BASES)


def segment_keys(nibbles: np.ndarray, segments: int) -> np.ndarray:
    """Hashes, a column each, of the bases i, i + segments, .. of a tag with its group's bases."""
    weighed = (nibbles + _U(1)) * _WEIGHTS[:BASES]
    group = _mixed(weighed[:, GROUP].sum(axis=1))
    return np.column_stack([_mixed(weighed[:, i::segments].sum(axis=1) ^ group) + _WEIGHTS[i] for i in range(segments)])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bases of rows of packed words, 16 bases each."""
    d = a ^ b
    d |= d >> _U(1)
    d |= d >> _U(2)
    return np.bitwise_count(d & _U(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _words(nibbles: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(nibbles[:, 0::2] << 4 | nibbles[:, 1::2]).view(_U)


_POSTING = "key bigint, id string, words binary"


def _postings(segments: int):
    """(key, id, words): a row for each segment of a tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                nibbles = packed_tags(part.column(1))
                keys = segment_keys(nibbles, segments).view(np.int64)
                words = pa.array([w.tobytes() for w in _words(nibbles)], pa.binary())
                row = pa.array(np.repeat(np.arange(len(keys)), segments))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(row), words.take(row)], ["key", "id", "words"])

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, words) of tags for each two of their segments whose lists are long."""
    for batch in batches:
        keys, rows = [], []
        for i, own in enumerate(batch.column(2).to_pylist()):
            for a, b in combinations(sorted(own), 2):
                keys.append((a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + 1) % (1 << 64))
                rows.append(i)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, _U).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["key", "id", "words"])


def _close(max_diff: int):
    """(query_id, library_id, diff) of the pairs of a bucket's lists that are close and of one group."""
    mask = np.zeros((1, BASES), np.uint8)
    mask[:, GROUP] = 15
    group = _words(mask)

    def run(query: pa.Table, library: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if query.num_rows and library.num_rows:
            words = [np.frombuffer(b"".join(t["words"].to_pylist()), _U).reshape(t.num_rows, -1) for t in (query, library)]
            keys = library["key"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, asked = keys[order], query["key"].to_numpy()
            begin, end = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            sums = np.concatenate(([0], np.cumsum(end - begin)))
            row = 0
            while row < len(asked):
                stop = max(row + 1, int(np.searchsorted(sums, sums[row] + PAIRS, "right")) - 1)
                size = (end - begin)[row:stop]
                q = np.repeat(np.arange(row, stop), size)
                at = order[np.arange(len(q)) - np.repeat(np.cumsum(size) - size - begin[row:stop], size)]
                diff = differing(words[0][q], words[1][at])
                good = np.flatnonzero(diff <= max_diff)
                good = good[(((words[0][q[good]] ^ words[1][at[good]]) & group) == 0).all(axis=1)]
                found.append((q[good], at[good], diff[good]))
                row = stop
        q, at, diff = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"query_id": query["id"].take(pa.array(q)), "library_id": library["id"].take(pa.array(at)), "diff": pa.array(diff, pa.int32())})

    return run


def _pieces(end: int) -> Column:
    places = F.slice(F.sequence(F.lit(0), F.lit(TAG_LENGTH // CHUNK - 1)), F.lit(1), F.least(F.floor(F.col(f"r{end}_len") / CHUNK), F.lit(TAG_LENGTH // CHUNK)).cast("int"))
    return F.transform(places, lambda i: F.substring(f"tag_r{end}", i * CHUNK + 1, F.lit(CHUNK)))


def _prepared(tags: DataFrame) -> DataFrame:
    """(id, tag, group, chunks), one row an id: its whole pieces of CHUNK bases of both reads, by its greatest lengths."""
    one = tags.where("id is not null").groupBy("id").agg(*[F.max(c).alias(c) for c in ("tag_r1", "tag_r2", "r1_len", "r2_len")])
    whole = F.concat(*[F.rpad(F.coalesce(f"tag_r{e}", F.lit("")), TAG_LENGTH, "A") for e in (1, 2)])
    chunks = F.array_distinct(F.concat(*[F.coalesce(_pieces(e), F.array().cast("array<string>")) for e in (1, 2)]))
    return one.select(F.col("id").cast("string").alias("id"), whole.alias("tag"), F.substring("tag_r1", GROUP.start + 1, GROUP.stop - GROUP.start).alias("group"), chunks.alias("chunks"))


def match_tags(query: DataFrame, library: DataFrame, max_diff: int = 7, most_tags: int | None = None) -> DataFrame:
    """The library tags nearest to each query tag: (query_id, library_id, diff), all with the least difference, at most ``max_diff``.

    Both have ``id``, tags and lengths. Tags meet if bases 9 to 14 of R1 are
    equal and a whole piece of 16 bases of one is a piece of the other.

    The search is exact: tags are cut into max_diff + 2 interleaved segments, of
    which two close tags have at least two in common. A tag is posted under
    each of its segments; the lists of segments that few library tags have are
    compared as they are. Where a pair shares long lists only, it meets in the
    list of two such segments. Lists are compared in buckets of bounded size by
    packed words; long ones of two segments are dealt over several by the
    library's tags. Only close pairs are rows.

    With ``most_tags`` pieces that more library tags of a group hold are no
    evidence, as some pipelines have it; without it none is left out. Rows that
    share an id are one tag, of its greatest lengths; null ids have no match.
    Equal tags should be collapsed first.
    """
    segments = max_diff + 2
    asked, held = write_table(_prepared(query), "tags-query"), write_table(_prepared(library), "tags-library")
    post = lambda tags, what: write_table(tags.select("id", "tag").mapInArrow(_postings(segments), _POSTING), what)
    sides = [post(asked, "tags-asked"), post(held, "tags-posted")]
    long = write_table(sides[1].groupBy("key").count().where(F.col("count") > LONGEST_LIST).select("key"), "tags-long")
    any_long = long.limit(1).count() > 0
    scratch = [asked, held, *sides, long]
    lists = sides
    if any_long:
        marked = [join_sized(s, long.withColumn("long", F.lit(True)), ["key"]) for s in sides]
        lists = []
        for rows in marked:
            both = rows.where("long").groupBy("id", "words").agg(F.collect_list("key").alias("own"))  # at most one a segment
            lists.append(rows.where("long is null").select("key", "id", "words").unionByName(both.mapInArrow(_paired, "key bigint, id string, words binary")))
        lists = [write_table(s, "tags-lists") for s in lists]
        scratch += lists
    sizes = lists[1].groupBy("key").count().where(F.col("count") > LONGEST_LIST)
    sizes = write_table(sizes.select("key", F.ceil(F.col("count") / LONGEST_LIST).cast("int").alias("deals")), "tags-sizes")
    scratch.append(sizes)
    deals = F.coalesce("deals", F.lit(1))
    buckets = max(1, -(-lists[1].count() // BUCKET_POSTINGS))
    bucket = F.pmod(F.xxhash64("key", "deal"), F.lit(buckets))
    posted = join_sized(lists[1], sizes, ["key"]).withColumn("deal", F.pmod(F.xxhash64("id"), deals).cast("int"))
    wanted = join_sized(lists[0], sizes, ["key"]).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
    # a query's own list must not meet another deal's, so the deal is part of the key within a bucket
    placed = [s.select(bucket.alias("bucket"), F.xxhash64("key", "deal").alias("key"), "id", "words") for s in (wanted, posted)]
    close = placed[0].groupBy("bucket").cogroup(placed[1].groupBy("bucket")).applyInArrow(_close(max_diff), "query_id string, library_id string, diff int")
    close = write_table(close.dropDuplicates(["query_id", "library_id"]), "tags-close")
    scratch.append(close)
    evidence = held.select(F.col("id").alias("library_id"), F.col("chunks").alias("held"))
    if most_tags is not None:
        pieces = held.select("id", "group", F.explode("chunks").alias("chunk"))
        common = pieces.groupBy("group", "chunk").count().where(F.col("count") > most_tags)
        rare = pieces.join(common, ["group", "chunk"], "left_anti").groupBy("id").agg(F.collect_set("chunk").alias("held"))
        evidence = rare.select(F.col("id").alias("library_id"), "held")
    rows = close.join(evidence, "library_id").join(asked.select(F.col("id").alias("query_id"), "chunks"), "query_id")
    rank = F.rank().over(Window.partitionBy("query_id").orderBy("diff"))
    best = rows.where(F.arrays_overlap("held", "chunks")).withColumn("r", rank).where("r = 1").select("query_id", "library_id", "diff")
    result = write_table(best, "tags-matches")
    for table in scratch:
        drop_table(table)
    return result
