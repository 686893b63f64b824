"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import forest_edges, slices, utf8
from seqloom.llm.components import connected_components
from seqloom.plans.session import drop_table, join_sized, write_table

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
BYTES = 8

#: Two fingerprints at most MAX_BITS apart share at least this many of their eight bytes.
MIN_SHARED = BYTES - MAX_BITS

#: A task holds posting lists up to this length; longer ones are parted.
LONGEST_LIST = 1 << 12
_ALL = 1 << 16


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the word shingles of a text; of the whole sequence if it is shorter, none if it has no words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return [digest(joined, HASH_SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-SHINGLE_WORDS] + 1).tolist()]
    return [digest(joined[s:e], HASH_SEED) for s, e in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]


def fingerprints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each text of a UTF-8 buffer: the bits set in over half of its shingle hashes."""
    out = np.zeros(len(starts) - 1, np.uint64)
    for first, end in slices(starts):
        per_text = [shingle_hashes(data[starts[i] : starts[i + 1]].tobytes()) for i in range(first, end)]
        sizes = np.array([len(x) for x in per_text])
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        hashes = np.array([h for x in per_text for h in x], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        at = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = (2 * ones > sizes[some][:, None]).astype(np.uint8)
        out[first + some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) of every row; a null text counts as empty and has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id bigint, fp bigint")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A posting for each choice of MIN_SHARED byte positions: the key holds the choice and its bytes."""
    choices = list(combinations(range(BYTES), MIN_SHARED))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for first in range(0, len(fp), 4096):
            part = fp[first : first + 4096]
            byte = [(part >> np.uint64(8 * i)) & np.uint64(255) for i in range(BYTES)]
            for number, choice in enumerate(choices):
                key = np.full(len(part), number, np.uint64)
                for i in choice:
                    key = (key << np.uint64(8)) | byte[i]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.view(np.int64))], ["key", "fp"])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (fp, key) of long lists again, by the halves of the bytes that their key leaves open.

    Of those eight halves two linked fingerprints share at least four, as they
    do of bytes. A key and four halves settle 48 bits, so no list is longer than 2^16.
    """
    taken = np.array(list(combinations(range(BYTES), MIN_SHARED)))
    left = np.array([np.setdiff1d(np.arange(BYTES), t) for t in taken])
    for batch in batches:
        fp, key = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        for first in range(0, len(fp), 4096):
            part, own = fp[first : first + 4096], key[first : first + 4096]
            shift = 8 * left[(own >> np.uint64(8 * MIN_SHARED)).astype(np.int64)]
            half = [(part >> (shift[:, i // 2] + 4 * (i % 2)).astype(np.uint64)) & np.uint64(15) for i in range(BYTES)]
            for number, choice in enumerate(taken):
                new = (own << np.uint64(7)) | np.uint64(number)
                for i in choice:
                    new = (new << np.uint64(4)) | half[i]
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(part.view(np.int64))], ["key", "fp"])


def _linked(one: np.ndarray | np.uint64, many: np.ndarray) -> np.ndarray:
    """Which of a posting list, whose tally of shared bytes its key grants, differ in few enough bits."""
    return np.bitwise_count(many ^ one) <= MAX_BITS


def _list_edges(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of one posting list: search outward, each member against the unreached ones."""
    members = np.unique(members)
    left, right = [], []
    waiting = members
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        at = 0
        while at < len(reached) and len(waiting):
            near = _linked(reached[at], waiting)
            reached.extend(waiting[near])
            waiting = waiting[~near]
            at += 1
        if len(reached) > 1:
            a, b = forest_edges(np.array(reached, np.uint64))
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _edges(longest: int):
    """Edges (a, b, null) within the posting lists of a partition that is sorted by key; a list may span batches.

    Members of lists of more than ``longest`` are passed on as they come, as (fp, null, key).
    """

    def pack(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def pass_on(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], ["a", "b", "key"])

    def within(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(key)) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(key)])))
        value = fp.view(np.uint64)
        two = first[size == 2]
        if len(two):
            a, b = value[two], value[two + 1]
            near = _linked(a, b) & (a != b)
            yield pack(a[near], b[near])
        held = (size > 2) & (size <= longest)
        many = [_list_edges(value[s : s + n]) for s, n in zip(first[held], size[held], strict=True)]
        if many:
            yield pack(np.concatenate([x for x, _ in many]), np.concatenate([x for _, x in many]))
        for s, n in zip(first[size > longest], size[size > longest], strict=True):
            yield pass_on(key[s : s + n], fp[s : s + n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key_left, fp_left, long_key = none, none, -1
        for batch in batches:
            key = np.concatenate((key_left, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp_left, batch.column(1).to_numpy(zero_copy_only=False)))
            more = int(np.searchsorted(key, long_key, side="right"))
            if more:
                yield pass_on(key[:more], fp[:more])
            key, fp = key[more:], fp[more:]
            last = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            if last:
                yield from within(key[:last], fp[:last])
            key_left, fp_left = key[last:], fp[last:]
            if len(key_left) > longest:
                long_key = int(key_left[0])
                yield pass_on(key_left, fp_left)
                key_left, fp_left = none, none
        if len(key_left):
            yield from within(key_left, fp_left)

    return run


def _searched(postings: DataFrame, longest: int) -> DataFrame:
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(_edges(longest), "a bigint, b bigint, key bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest_list: int = LONGEST_LIST) -> DataFrame:
    """Near-duplicate groups of texts by SimHash: (id, fp, component) for every row of ``docs``.

    Words are runs of other characters than the six ASCII white spaces, with
    A-Z lower-cased; 4-word shingles, repeats included, are hashed with XXH64
    (seed 42) and a fingerprint has the bits set in over half of them. Two
    fingerprints at most 4 bits apart are linked, ``component`` is the smallest
    id that links reach.

    Equal fingerprints are one vertex from the start, so groups of copies cost
    nothing. Four differing bits spoil at most four of eight bytes, so a link
    shares the bytes of at least four positions. The inverted index departs
    here from lists by single bytes: a list of one byte at one position holds a
    256th of all fingerprints, and the pairs to tally grow with the square of
    that. Each distinct fingerprint is posted instead under its 70 choices of
    four positions, a 32-bit key that chance seldom repeats: two fingerprints
    meet in a list if and only if their tally of shared positional bytes
    reaches four, so the count filter is the key itself. Bits are verified in
    the list, and only a spanning forest of it leaves the task, never all its
    pairs. Lists hold distinct fingerprints that agree in four bytes, streamed
    from a partition sorted by key. Lists of over ``longest_list`` are not held
    but dealt out once more by the same rule, for the halves of the other four
    bytes: such lists have 2^16 members at most, so neither the memory nor the
    work of a task grows with a crowded region of fingerprints.

    Null or empty texts and texts of white space have fingerprint zero and link
    like any other. A null id takes part but never names a component: it is
    null where all members' ids are null. Repeated rows return repeated rows.
    """
    return _with_groups(docs, id_col, text_col, longest_list).select("id", "fp", "component")


def _with_groups(docs: DataFrame, id_col: str, text_col: str, longest_list: int = LONGEST_LIST) -> DataFrame:
    """Rows of :func:`simhash_groups` with ``root``, a fingerprint that only their group has."""
    printed = write_table(with_fingerprint(docs, id_col, text_col), "simhash-prints")
    vertices = write_table(printed.groupBy("fp").agg(F.min("id").alias("low_id")), "simhash-vertices")
    postings = vertices.select("fp").mapInArrow(_postings, "key bigint, fp bigint")
    found = write_table(_searched(postings, longest_list), "simhash-found")
    parted = found.where("b is null").select("a", "key").mapInArrow(_parted, "key bigint, fp bigint")
    links = found.where("b is not null").select("a", "b").union(_searched(parted, _ALL).select("a", "b"))
    members = connected_components(links)
    grouped = vertices.join(members, vertices["fp"] == members["node"], "left").select("fp", "low_id", F.col("component").alias("root"))
    grouped = write_table(grouped, "simhash-grouped")
    linked = grouped.where("root is not null")
    lowest = write_table(linked.groupBy("root").agg(F.min("low_id").alias("component")), "simhash-lowest")
    alone = grouped.where("root is null").select("fp", F.col("low_id").alias("component"), F.col("fp").alias("root"))
    named = write_table(join_sized(linked, lowest, ["root"], "inner").select("fp", "component", "root").union(alone), "simhash-named")
    for table in (vertices, found, members, grouped, lowest):
        drop_table(table)
    return printed.join(named, "fp").select("id", "fp", "component", "root")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group, one whose id names it; rows without an id stay, for nothing names them.

    Null and empty texts and those of white space are one group, like other equal texts: the one of the smallest id stays.
    Where rows share an id their texts are told apart: each group has a row of
    its own, that with the least fingerprint, text and then other columns.
    Texts are shuffled once, by id; fingerprints are made again only for rows that share one.
    """
    groups = write_table(_with_groups(docs, id_col, text_col), "simhash-groups")
    named = groups.where(F.col("id") == F.col("component"))
    keepers = named.groupBy("root").agg(F.min("id").alias("id"), F.min("fp").alias("fp"))
    shared = named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("shared"))
    keepers = write_table(keepers.join(shared, "id", "left").select("id", "fp", "shared"), "simhash-keepers")
    present = docs.where(F.col(id_col).isNotNull())
    of = lambda rows: rows.select(F.col("id").alias(id_col)).distinct()
    alone = present.join(of(keepers.where("shared is null")), id_col, "left_semi")
    repeated = keepers.where("shared")
    kept = alone
    if repeated.limit(1).count():
        rows = write_table(present.join(of(repeated), id_col, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "simhash-repeated")
        printed = with_fingerprint(rows, "__row", text_col).select(F.col("id").alias("__row"), F.col("fp").alias("__fp"))
        wanted = repeated.select(F.col("id").alias(id_col), F.col("fp").alias("__fp"))
        told = rows.join(printed, "__row").join(wanted, [id_col, "__fp"])
        order = [F.col(text_col), *[F.to_json(F.struct(c)) for c in docs.columns if c not in (id_col, text_col)]]
        first = F.row_number().over(Window.partitionBy(id_col, "__fp").orderBy(*order))
        kept = kept.unionByName(told.withColumn("__place", first).where("__place = 1").select(*docs.columns))
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
