"""Text formats of reads, alignments, pileups and depths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases of a row of a long sequence; a multiple of the length of its lines as they are written.
FASTA_CHUNK = 60 * 1024

ALIGNMENT = "Query string, Chromosome string, StartPos int, EndPos int, Strand int, MappingQuality int, MatchNumber int, EditDistance int, IfPerfectMatch int"


def _lines(spark: SparkSession, path: str, name: str = "f") -> DataFrame:
    return spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias(name))


def read_pileup(spark: SparkSession, path: str, taxon: str) -> DataFrame:
    """``samtools mpileup`` text of one or more BAMs of a taxon: depths summed, bases joined."""
    f = _lines(spark, path)
    places = F.sequence(F.lit(3), F.size("f") - 1, F.lit(3))
    depth = F.aggregate(F.transform(places, lambda i: F.get("f", i).cast("int")), F.lit(0), lambda a, x: a + x)
    bases = F.array_join(F.transform(places, lambda i: F.when(F.get("f", i) == "0", "").otherwise(F.get("f", i + 1))), "")
    return f.select(F.lit(taxon).alias("taxon"), F.col("f")[0].cast("int").alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.upper(F.col("f")[2]).alias("ref"), depth.alias("depth"), bases.alias("bases"))


def read_depth(spark: SparkSession, path: str, taxon: str) -> DataFrame:
    """``samtools depth`` text: the BAMs' depths of a taxon summed."""
    f = _lines(spark, path)
    depth = F.aggregate(F.slice("f", 3, F.size("f")), F.lit(0), lambda a, x: a + x.cast("int"))
    return f.select(F.lit(taxon).alias("taxon"), F.col("f")[0].cast("int").alias("chrom"), F.col("f")[1].cast("int").alias("pos"), depth.alias("depth"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: (query, flag, chrom, start_pos, mapq, cigar, seq, qual, tags); chrom and start are null where unmapped."""
    f = spark.read.text(path).where("value <> '' AND NOT startswith(value, '@')").select(F.split("value", "\t").alias("f"))
    c = lambda i: F.col("f")[i]
    mapped = c(5) != "*"
    return f.select(
        c(0).alias("query"), c(1).cast("int").alias("flag"), F.when(mapped, c(2)).alias("chrom"), F.when(mapped, c(3).cast("int")).alias("start_pos"),
        c(4).cast("int").alias("mapq"), c(5).alias("cigar"), c(9).alias("seq"), c(10).alias("qual"), F.slice("f", 12, F.size("f")).alias("tags"),
        F.regexp_extract(F.get(F.filter(F.slice("f", 12, F.size("f")), lambda t: t.startswith("MD:")), F.lit(0)), r"MD:Z:(.*)", 1).alias("md"),
    )


def read_bowtie2(spark: SparkSession, path: str) -> DataFrame:
    """SAM of another aligner with the edit distance from its NM tag, wherever it stands."""
    nm = F.regexp_extract(F.get(F.filter("tags", lambda t: t.startswith("NM:")), F.lit(0)), r"NM:i:(\d+)", 1).try_cast("int")
    return read_sam(spark, path).withColumn("edit", nm)


def read_blast(spark: SparkSession, path: str, max_evalue: float, read_len: int) -> DataFrame:
    """BLAST tabular text with comments: hits up to an e-value, and queries without any as rows without a hit.

    On the minus strand start and end are swapped; a hit is perfect if it is of
    full length and all alike.
    """
    lines = spark.read.text(path)
    asked = lines.where(F.col("value").startswith("# Query:")).select(F.trim(F.regexp_extract("value", r"^# Query:\s*(\S+)", 1)).alias("query")).distinct()
    f = lines.where("value <> '' AND NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    c = lambda i: F.col("f")[i]
    start, end = c(8).cast("int"), c(9).cast("int")
    hits = f.where(c(10).cast("double") <= max_evalue).select(
        c(0).alias("query"), c(1).alias("chrom"), F.least(start, end).alias("start_pos"), F.greatest(start, end).alias("last_pos"), F.when(start > end, 0).otherwise(1).alias("strand"),
        c(3).cast("int").alias("match"), ((c(3).cast("int") == read_len) & (c(2).cast("double") == 100)).alias("perfect"),
    )
    return asked.join(hits, "query", "left")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=ALIGNMENT)


def write_alignments(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def _numbered(lines: DataFrame, before: dict[str, Column]) -> DataFrame:
    """Lines of :func:`_placed_lines` with, for each named 0/1 column, its sum over all lines of the splits before theirs.

    Only a row for each split of a file is summed in one task.
    """
    split = ["file", "block"]
    sizes = lines.groupBy(*split).agg(F.min("id").alias("first"), *[F.sum(c).cast("bigint").alias(n) for n, c in before.items()])
    order = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, "first", *[F.coalesce(F.sum(n).over(order), F.lit(0)).alias(n) for n in before])
    return lines.join(offsets, split)


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, id): lines, the split of a file that they are read from, and ids that follow their order within it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, n, left, name) of each split from its lines (file, block, head, description, long) in order: headers, the bases since the last one, and that."""
    at, n, left, name, out = None, 0, 0, None, []
    for batch in batches:
        file, block, head, described, long = batch.columns
        blocks, heads, longs = block.to_numpy(), head.to_numpy(zero_copy_only=False), long.to_numpy().astype(np.int64)
        files = file.dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1]), [True]))) if len(files) else []
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            here = file[int(begin)].as_py(), int(blocks[begin])
            if here != at:
                out += [(*at, n, left, name)] if at else []
                at, n, left, name = here, 0, 0, None
            found = np.flatnonzero(heads[begin:end])
            if len(found):
                begin += found[-1]
                n, left, name = n + len(found), 0, described[int(begin)].as_py()
            left += int(longs[begin:end].sum())
    out += [(*at, n, left, name)] if at else []
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "n", "left", "name"])


def _cut(size: int, wanted: bool) -> Callable:
    """(seq_id, description, chunk, at, part) of chunks that lie in one split, or else the parts of others, from lines (split, before, carry, name, head, description, bases) in order.

    The last chunk of a record is known to lie in a split when the next header does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seq_id, name, start, opened = None, 0, None, 0, False
        held, out = bytearray(), []

        def put(part: bytes, ended: bool) -> None:
            if (ended and start % size == 0 and (start > 0 or opened)) == wanted:
                out.append((seq_id, name, start // size, start, part))

        def close(ended: bool) -> None:
            if seq_id and (held or start == 0 and opened):
                put(bytes(held), ended)
            held.clear()

        for batch in batches:
            splits, before, carry, names, head, described, bases = batch.columns
            splits, heads = splits.to_numpy(), head.to_numpy(zero_copy_only=False)
            data = bases.cast(pa.large_binary())
            ends, text = np.frombuffer(data.buffers()[1], np.int64)[data.offset :].tolist(), memoryview(data.buffers()[2] or b"")
            edge = np.append(np.flatnonzero(np.concatenate(([True], splits[1:] != splits[:-1])) | heads), len(splits)).tolist() if len(splits) else []
            for begin, end in zip(edge[:-1], edge[1:], strict=True):
                if splits[begin] != split:
                    close(False)
                    split, seq_id, name, start, opened = splits[begin], before[begin].as_py(), names[begin].as_py(), carry[begin].as_py(), False
                if heads[begin]:
                    close(True)
                    seq_id, name, start, opened = seq_id + 1, described[begin].as_py(), 0, True
                held += text[ends[begin] : ends[end]]
                place = 0
                while len(held) - place >= (take := size - start % size):
                    put(bytes(held[place : place + take]), True)
                    start, place = start + take, place + take
                del held[:place]
            yield rows(out)
        close(False)
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*(r for r in out if r[0]), strict=True)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seq_id", "description", "chunk", "at", "part"])

    return run


def read_fasta_chunks(spark: SparkSession, path: str, size: int = FASTA_CHUNK) -> DataFrame:
    """(seq_id, description, chunk, offset, seq), plain or gzipped: the bases of each record in upper case, ``size`` to a row; ids count from 1 in the order of files.

    A line that begins with ``>`` describes a record, the lines up to the next
    one are its bases; a record without any has one empty row. A first pass
    gives each split of a file the number of headers before it and what is open
    where it begins, a row a split. Then each split is cut by itself; only
    chunks that lie in several, at its ends, are shuffled. So files are read in
    parallel, and no row or task ever holds a record.
    """
    head = F.col("value").startswith(">")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    described = F.when(head, F.substring("value", 2, 1 << 30)).alias("description")
    bases = F.when(~head, F.upper(F.regexp_replace("value", r"\s", ""))).alias("bases")
    kept = lines.select("file", "block", head.alias("head"), described, F.coalesce(F.octet_length(bases), F.lit(0)).alias("long"))
    ends = kept.mapInArrow(_split_ends, "file string, block bigint, n bigint, left bigint, name string")
    order = Window.orderBy("file", "block")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = ends.select("*", F.row_number().over(order).alias("split"), F.coalesce(F.sum("n").over(until), F.lit(0)).alias("before"), F.last("name", True).over(until).alias("opened"))
    open_record = Window.partitionBy(F.col("before") + F.col("n")).orderBy("file", "block")
    carried = splits.withColumn("held", F.sum("left").over(open_record)).withColumn("carry", F.coalesce(F.lag("held").over(order), F.lit(0)))
    placed = lines.join(F.broadcast(carried.select("file", "block", "split", "before", "carry", "opened")), ["file", "block"])
    rows = placed.select("split", "before", "carry", "opened", head.alias("head"), described, bases)
    schema = "seq_id bigint, description string, chunk bigint, at bigint, part binary"
    whole = rows.mapInArrow(_cut(size, True), schema).withColumn("seq", F.col("part").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("at", F.col("part").cast("string").alias("part"))))
    joined = rows.mapInArrow(_cut(size, False), schema).groupBy("seq_id", "chunk").agg(F.max("description").alias("description"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("seq"))
    columns = ["seq_id", "description", "chunk", (F.col("chunk") * size).alias("offset"), "seq"]
    return whole.select(columns).unionByName(joined.select(columns))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, description, seq) with each record in one row, for records that a row can hold; see :func:`read_fasta_chunks`."""
    return whole_sequences(read_fasta_chunks(spark, path))


def whole_sequences(chunks: DataFrame) -> DataFrame:
    """Chunks of sequences put together."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "seq")))
    return chunks.groupBy("seq_id", "description").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """Records as text; of a table of chunks, whose sizes must be a multiple of ``width``, only first chunks have a header."""
    body = F.rtrim(F.regexp_replace("seq", "(.{%d})" % width, "$1\n"), F.lit("\n"))
    header = F.concat(F.lit(">"), "description", F.when(F.col("seq") == "", "").otherwise("\n"))
    header = F.when(F.col("chunk") == 0, header).otherwise("") if "chunk" in df.columns else header
    return df.select(*[c for c in ("chrom", "seq_id", "chunk") if c in df.columns], F.concat(header, body).alias("value"))


def write_fasta(df: DataFrame, path: str, by_chrom: bool = False, codec: str = "none") -> None:
    """Records with lines of 60 bases; with ``by_chrom`` a folder for each ``description``; ``codec`` gzip takes a third of the room or less.

    Of chunks (seq_id, description, chunk, offset, seq) a record's follow each
    other in order, within files and from one file to the next.
    """
    lines = fasta_lines(df.withColumn("chrom", F.col("description")) if by_chrom else df)
    if "chunk" in df.columns:
        lines = lines.repartitionByRange("seq_id", "chunk").sortWithinPartitions("seq_id", "chunk")
    if by_chrom:
        lines.select("chrom", "value").write.partitionBy("chrom").text(path, codec)
    else:
        lines.select("value").write.text(path, codec)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(record, id, seq, des, qual) of 4-line records, plain or gzipped, records numbered from 1 in the order of files."""
    counted = _numbered(_placed_lines(spark, path), {"lines": F.lit(1)})
    lines = counted.select((F.col("lines") + F.col("id") - F.col("first")).alias("n"), "value")
    part = lambda i: F.max(F.when(F.col("n") % 4 == i, F.col("value")))
    rows = lines.groupBy((F.floor(F.col("n") / 4) + 1).alias("record")).agg(*[part(i).alias(c) for i, c in enumerate(("id", "seq", "des", "qual"))])
    return rows.where("id IS NOT NULL AND id <> ''")


def phred_offset(reads: DataFrame) -> int:
    """33 if one of the first 10 reads has a quality byte under 65, else 64."""
    low = reads.where("record <= 10").agg(F.min(F.array_min(F.transform(F.split("qual", ""), F.ascii)))).first()[0]
    return 33 if low is not None and low < 65 else 64


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select("record", F.concat_ws("\n", "id", "seq", "des", "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str) -> None:
    fastq_lines(reads).repartitionByRange("record").sortWithinPartitions("record").select("value").write.text(path)


def fastq_to_fasta(reads: DataFrame, path: str) -> None:
    rows = reads.select("record", F.concat(F.lit(">"), F.regexp_replace("id", "^@", ""), F.lit("\n"), "seq").alias("value"))
    rows.repartitionByRange("record").sortWithinPartitions("record").select("value").write.text(path)
