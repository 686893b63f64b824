"""Sequences, reads and k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.bases import count_base, decode_kmer, has_bad_base, has_n, phred, total
from seqloom.plans.session import drop_table, write_table

#: Start positions of k-mers in one row of a cut sequence, and rows that a task takes at once.
CHUNK = 1 << 16
ROWS = 32


def base_composition(seqs: DataFrame) -> DataFrame:
    """Share of each base and of C and G together over the full length; null for empty sequences."""
    share = lambda n: F.round(F.try_divide(n, F.length("seq")), 6)
    counts = {b: count_base(F.col("seq"), b) for b in "ACGT"}
    return seqs.select("seq_id", *[share(counts[b]).alias(f"p_{b.lower()}") for b in "ACGT"], share(counts["C"] + counts["G"]).alias("gc"))


def gc_content(seqs: DataFrame) -> DataFrame:
    return base_composition(seqs).select("seq_id", "gc")


def base_checks(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", has_n(F.col("seq")).alias("has_n"), has_bad_base(F.col("seq")).alias("has_bad"))


def assembly_stats(seqs: DataFrame) -> DataFrame:
    """Number, total length, N50 (the length at which the longest sequences hold over half of it) and L50 (how many they are).

    A histogram by powers of two tells in which the half is crossed; only its
    lengths are divided further, by 1,024 at a time, down to one length. So
    nothing is sorted and no task sees more than its share of the lengths.
    Without sequences there are none, of total length null.
    """
    spark = seqs.sparkSession
    lengths = write_table(seqs.where("seq is not null").groupBy(F.length("seq").cast("bigint").alias("len")).agg(F.count("*").alias("n")), "lengths")
    power = F.when(F.col("len") > 0, F.floor(F.log2(F.col("len").cast("double")))).otherwise(-1).cast("int")
    counted = lambda rows, part: sorted(((r[0], r[1], r[2]) for r in rows.groupBy(part.alias("part")).agg(F.sum("n"), F.sum(F.col("len") * F.col("n"))).collect()), reverse=True)
    hist = counted(lengths, power)
    n_seqs, total = sum(h[1] for h in hist), sum(h[2] for h in hist)
    many = upto = 0
    low = high = None

    def crossing(parts: list[tuple[int, int, int]]) -> int | None:
        nonlocal many, upto
        for part, n, bases in parts:
            if upto + bases > total // 2:
                return part
            many, upto = many + n, upto + bases
        return None

    part = crossing(hist)
    if part is not None:
        low, high = (1 << part, 2 << part) if part >= 0 else (0, 1)
        while high - low > 1:
            width = max(1, (high - low) // 1024)
            own = lengths.where((F.col("len") >= low) & (F.col("len") < high))
            low += width * crossing(counted(own, F.floor((F.col("len") - low) / width)))
            high = low + width
        many += (total // 2 - upto) // low + 1
    drop_table(lengths)
    row = (n_seqs, total if hist else None, low, many if low is not None else None)
    return spark.createDataFrame([row], "n_seqs bigint, total bigint, n50 bigint, l50 bigint")


def sort_sequences(seqs: DataFrame, by: str = "seq_id", descending: bool = False) -> DataFrame:
    key = {"seq_id": F.col("seq_id"), "length": F.length("seq"), "description": F.col("description") if "description" in seqs.columns else F.col("seq_id").cast("string"), "number": F.col("description").try_cast("decimal(38,9)") if "description" in seqs.columns else F.col("seq_id")}[by]
    return seqs.orderBy(key.desc() if descending else key.asc(), "seq_id")


def _chunks(seqs: DataFrame, k: int, chunk: int) -> DataFrame:
    """Rows (seq_id, at, part): sequences as parts of ``chunk`` start positions of k-mers, which overlap by k - 1 bases.

    They are dealt anew, a byte a base: their k-mers, many bytes a base, are
    then made by all tasks however few files or sequences there are.
    """
    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - k) / chunk)))
    cut = seqs.where(F.length("seq") >= k).select("seq_id", "seq", number.alias("n"))
    return cut.select("seq_id", (F.col("n") * chunk).alias("at"), F.substring("seq", F.col("n") * chunk + 1, F.lit(chunk + k - 1)).alias("part")).repartition("seq_id", "at")


def _codes(parts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of parts: row, place in it, and 2-bit code (A0 C1 G2 T3) of each k-mer of A, C, G and T."""
    text, starts = np.frombuffer("".join(parts.to_pylist()).encode("ascii", "replace"), np.uint8), np.concatenate(([0], np.cumsum(pc.utf8_length(parts).to_numpy(zero_copy_only=False))))
    base = _BASE[text].astype(np.int64)
    n = max(len(base) - k + 1, 0)
    code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        digit = base[i : i + n]
        code = code << 2 | digit & 3
        bad |= digit > 3
    at = np.arange(n)
    row = np.searchsorted(starts, at, "right") - 1
    good = ~bad & (at + k <= starts[row + 1])
    return row[good], (at - starts[row])[good], code[good]


_BASE = np.full(256, 4, np.uint8)
_BASE[[65, 67, 71, 84]] = range(4)


def kmer_codes(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, pos, code) of all k-mers of A, C, G and T, k at most 32, pos from 0; a code has 2 bits a base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                row, place, code = _codes(batch.column(2), k)
                pos = batch.column(1).to_numpy()[row] + place
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos), pa.array(code)], ["seq_id", "pos", "code"])

    chunks = _chunks(seqs, k, chunk)
    return chunks.mapInArrow(run, T.StructType([chunks.schema["seq_id"], T.StructField("pos", T.LongType()), T.StructField("code", T.LongType())]))


def kmers(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, pos, kmer) of all k-mers of A, C, G and T, pos from 0."""
    return kmer_codes(seqs, k, chunk).select("seq_id", "pos", decode_kmer(F.col("code"), k).alias("kmer"))


def read_quality(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Mean quality, cut to a whole number, and the element at half the length of the sorted qualities; null for empty strings."""
    q = phred(F.col("qual"), offset)
    size = F.length("qual")
    mean = F.floor(F.try_divide(total(q), size)).cast("int")
    return reads.select("read_id", F.when(size > 0, mean).alias("mean_q"), F.when(size > 0, F.get(F.sort_array(q), F.floor(size / 2).cast("int"))).alias("median_q"))


def rescale_quality(reads: DataFrame, old: int = 33, new: int = 64) -> DataFrame:
    """Quality strings reversed, and in another scale; empty ones stay empty."""
    each = F.filter(F.split("qual", ""), lambda c: c != "")  # an empty string is split into one empty string
    other = F.array_join(F.transform(each, lambda c: F.char(F.ascii(c) - old + new)), "")
    return reads.select("read_id", F.reverse("qual").alias("reversed"), other.alias("rescaled"))


def sample_reads(reads: DataFrame, start: int, n: int, least_start: int = 100_000, most: int = 1_000_000) -> DataFrame:
    """Reads by record number: ``n``, at most ``most``, after the first ``start``, at least ``least_start``."""
    first = max(start, least_start)
    return reads.where(F.col("record").between(first, first + min(n, most) - 1))


def coverage(reads: DataFrame, genome_size: int) -> DataFrame:
    """Sequencing coverage of each taxon: pairs / genome size * read length * 2."""
    return reads.groupBy("taxon").agg(F.count("*").alias("n_reads"), F.min(F.length("seq")).alias("read_len")).select(
        "taxon", "n_reads", "read_len", F.round(F.col("n_reads") / F.lit(genome_size) * F.col("read_len") * 2, 6).alias("coverage")
    )
