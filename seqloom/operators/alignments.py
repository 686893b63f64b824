"""Read alignments: flags, CIGAR, pairs, and the differences of a read from the reference."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.bases import total
from seqloom.plans.session import join_sized, write_table

# Bits of a SAM flag.
FLAG_BITS = {
    "multi_segment": 0, "proper_pair": 1, "unmapped": 2, "mate_unmapped": 3, "reverse": 4, "mate_reverse": 5,
    "first": 6, "second": 7, "secondary": 8, "duplicate": 10, "supplementary": 11,
}
MIN_MAPQ = 30
MOST_INSERT = 1000

#: Positions by which reads meet SNPs, and reads of a stretch in one group, about.
STRETCH, MOST_READS = 100_000, 1 << 18


def flag(name: str, column: str = "flag") -> Column:
    return F.col(column).bitwiseAND(1 << FLAG_BITS[name]) != 0


def flag_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({f"is_{name}": flag(name) for name in FLAG_BITS})


def _lengths(operations: str) -> Column:
    numbers = F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{operations}]"), 1)
    return total(F.transform(numbers, lambda x: x.cast("bigint"))).cast("int")


def cigar_end(df: DataFrame) -> DataFrame:
    """Add ``end_pos``, exclusive: start plus the lengths of M, D, N, = and X; null where unmapped (``*``)."""
    return df.withColumn("end_pos", F.when(F.col("cigar") != "*", F.col("start_pos") + _lengths("MDN=X")))


def cigar_match(df: DataFrame) -> DataFrame:
    """Add the aligned bases of M, the length on the reference, and the strand 1 or 0; nulls where unmapped."""
    mapped = F.col("cigar") != "*"
    return df.withColumns(
        {
            "match": F.when(mapped, _lengths("M")),
            "align_len": F.when(mapped, _lengths("MDN=X")),
            "strand": F.when(mapped, F.when(flag("reverse"), 0).otherwise(1)),
        }
    )


def edit_columns(df: DataFrame) -> DataFrame:
    """Add edit distance, its share of matched bases and whether the match is perfect, from ``tags`` and ``cigar``."""
    nm = F.regexp_extract(F.get(F.filter("tags", lambda t: t.startswith("NM:")), F.lit(0)), r"NM:i:(\d+)", 1).try_cast("int")
    rows = cigar_match(df).withColumn("edit", nm)
    return rows.withColumn("edit_ratio", F.round(F.try_divide("edit", "match"), 6)).withColumn(
        "perfect", F.coalesce(F.col("cigar").rlike(r"^\d+M$") & (F.col("edit") == 0), F.lit(False))
    )


def primary(df: DataFrame, drop_secondary: bool = True) -> DataFrame:
    rows = df.where(~flag("supplementary"))
    return rows.where(~flag("secondary")) if drop_secondary else rows


#: Columns that settle the order of records of one query at one place.
_TIES = ("flag", "mapq", "cigar")


def sort_by_hit(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "start_pos", "query", *[c for c in _TIES if c in df.columns])


def sort_by_query(df: DataFrame) -> DataFrame:
    return df.orderBy("query", "chrom", "start_pos", *[c for c in _TIES if c in df.columns])


def queries(df: DataFrame) -> DataFrame:
    return df.select("query").distinct()


def hits(df: DataFrame) -> DataFrame:
    """Distinct chromosomes with an alignment."""
    return df.where("cigar <> '*'").select("chrom").distinct()


def count_by_hit(df: DataFrame) -> DataFrame:
    return df.where("cigar <> '*'").groupBy("chrom").agg(F.count("*").alias("n"))


def count_by_query(df: DataFrame) -> DataFrame:
    """Alignments of each query; a query without any has 0."""
    return df.groupBy("query").agg(F.count_if(F.col("cigar") != "*").alias("n"))


def from_position(df: DataFrame, chrom: int, start: int) -> DataFrame:
    return df.where((F.col("chrom") == chrom) & (F.col("start_pos") >= start) & (F.col("cigar") != "*"))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("query").startswith(prefix))


def query_classes(df: DataFrame) -> DataFrame:
    """What each query's alignments are, from ``perfect``: matched, with just one perfect one, and that one the only one at all."""
    mapped = F.col("cigar") != "*"
    return df.groupBy("query").agg(F.count_if(mapped).alias("n"), F.count_if(mapped & F.col("perfect")).alias("p")).select(
        "query", (F.col("n") > 0).alias("matched"), (F.col("p") == 1).alias("one_perfect"), ((F.col("n") == 1) & (F.col("p") == 1)).alias("unique_perfect")
    )


def pair_alignments(df: DataFrame, fields: tuple[str, ...] = ("chrom", "start_pos", "end_pos", "mapq", "strand")) -> DataFrame:
    """One row a query with the fields of its first and second mate (suffixes _f and _b), in one grouping; supplementary ones left out.

    Unmapped mates have null fields. Of several records of a mate the lowest by
    the fields in their order stands.
    """
    mate = F.struct(*fields)
    use = primary(df).where("cigar <> '*'")
    both = use.groupBy("query").agg(F.min(F.when(flag("first"), mate)).alias("f"), F.min(F.when(flag("second"), mate)).alias("b"))
    every = primary(df).select("query").distinct()
    return every.join(both, "query", "left").select("query", *[F.col(f"{m}.{c}").alias(f"{c}_{m}") for m in "fb" for c in fields])


def insert_size(pairs: DataFrame) -> DataFrame:
    """Add ``insert_size`` of pairs on one chromosome: from the first read's start to the second one's end."""
    size = F.when(F.col("start_pos_f") <= F.col("start_pos_b"), F.col("end_pos_b") - F.col("start_pos_f")).otherwise(F.col("end_pos_f") - F.col("start_pos_b"))
    return pairs.withColumn("insert_size", F.when(F.col("chrom_f") == F.col("chrom_b"), size))


def fragment_size(pairs: DataFrame) -> DataFrame:
    """Add ``fragment_size`` of mates on opposite strands, ends included: -1 where they do not face each other or lie on one strand."""
    last_f, last_b = F.col("end_pos_f") - 1, F.col("end_pos_b") - 1
    plus = F.when(F.col("start_pos_f") > last_b, -1).otherwise(last_b - F.col("start_pos_f") + 1)
    minus = F.when(last_f < F.col("start_pos_b"), -1).otherwise(last_f - F.col("start_pos_b") + 1)
    facing = (F.col("chrom_f") == F.col("chrom_b")) & (F.col("strand_f") != F.col("strand_b"))
    return pairs.withColumn("fragment_size", F.when(facing, F.when(F.col("strand_f") == 1, plus).otherwise(minus)).otherwise(-1))


def pair_ratios(pairs: DataFrame) -> DataFrame:
    """Shares of pairs with both, one and no mate mapped."""
    f, b = F.col("chrom_f").isNotNull(), F.col("chrom_b").isNotNull()
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return pairs.agg(F.count("*").alias("n_pairs"), share(f & b).alias("both"), share(f != b).alias("one"), share(~f & ~b).alias("none"))


def pair_edit_ratios(pairs: DataFrame) -> DataFrame:
    """Edit distance by aligned matches of each mate and of both ends together; null where a mate, or both, lack them.

    ``pairs`` are those of :func:`pair_alignments` with the fields edit and match.
    """
    ratio = lambda edit, match: F.round(F.try_divide(edit, match), 6)
    both = [F.coalesce(F.col(f"{c}_f"), F.lit(0)) + F.coalesce(F.col(f"{c}_b"), F.lit(0)) for c in ("edit", "match")]
    return pairs.select("query", ratio(F.col("edit_f"), F.col("match_f")).alias("ratio_f"), ratio(F.col("edit_b"), F.col("match_b")).alias("ratio_b"), ratio(*both).alias("ratio_both"))


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_MD = re.compile(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])")


def walk_variants(start: int, cigar: str, md: str, seq: str) -> list[tuple[int, str, str]]:
    """(position, reference base, alternative) of the differences of one read, in order.

    Substitutions show their base, a deletion D at its first base, an insertion
    I at the base before it. Clipped ends are left out.
    """
    aligned, found, pos, at = [], [], start, 0
    for number, op in _CIGAR.findall(cigar):
        n = int(number)
        if op in "M=X":
            aligned.append(seq[at : at + n])
            pos, at = pos + n, at + n
        elif op == "I":
            found.append((pos - 1, seq[at - 1] if at else "N", "I"))
            at += n
        elif op in "DN":
            pos += n
        elif op == "S":
            at += n
    bases, pos, at = "".join(aligned), start, 0
    for number, deleted, other in _MD.findall(md):
        if number:
            pos, at = pos + int(number), at + int(number)
        elif deleted:
            found.append((pos, deleted[0].upper(), "D"))
            pos += len(deleted)
        else:
            found.append((pos, other.upper(), bases[at]))
            pos, at = pos + 1, at + 1
    return sorted(found)


def walk_alleles(start: int, cigar: str, seq: str, reverse: bool, snps: list[tuple[int, str, str]]) -> list[tuple[int, str, str, int]]:
    """(SNP position, allele, base, place in read from 1) at known SNPs (position, ref, alts) that a read covers.

    I and D only where the SNP knows that allele. At a base equal to the
    reference, a SNP with an insertion allele that the read does not have shows
    the reference. Places and bases of reverse reads count from the read's
    other end, bases complemented.
    """
    known = {p: (ref, alts.split(",")) for p, ref, alts in snps}
    found: dict[int, tuple[str, str, int]] = {}
    pos, at = start, 0
    for number, op in _CIGAR.findall(cigar):
        n = int(number)
        if op in "M=X":
            for p in [p for p in known if pos <= p < pos + n]:
                place = at + p - pos
                found[p] = (seq[place], seq[place], place + 1)
            pos, at = pos + n, at + n
        elif op == "I":
            if at and pos - 1 in known and "I" in known[pos - 1][1] and at < len(seq):
                found[pos - 1] = ("I", seq[at], at + 1)
            at += n
        elif op in "DN":
            if at and pos in known and "D" in known[pos][1]:
                found[pos] = ("D", seq[at - 1], at)
            pos += n
        elif op == "S":
            at += n
    turn = str.maketrans("ACGT", "TGCA")
    out = []
    for p in sorted(found):
        allele, base, place = found[p]
        out.append((p, allele, base.translate(turn), len(seq) - place + 1) if reverse else (p, allele, base, place))
    return out


def _structs(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of tuples as an Arrow array of lists of structs."""
    columns = list(zip(*(one for row in rows for one in row), strict=True)) or [()] * len(kinds)
    flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(row) for row in rows]))), pa.int32()), flat)


def read_variants(df: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """(query, chrom, pos, ref, alt) of the differences of mapped reads (query, chrom, start_pos, mapq, cigar, md, seq)."""

    @F.arrow_udf("array<struct<pos:int,ref:string,alt:string>>")
    def walk(start: pa.Array, cigar: pa.Array, md: pa.Array, seq: pa.Array) -> pa.Array:
        found = [walk_variants(*row) for row in zip(*(c.to_pylist() for c in (start, cigar, md, seq)), strict=True)]
        return _structs(found, {"pos": pa.int32(), "ref": pa.string(), "alt": pa.string()})

    rows = df.where((F.col("cigar") != "*") & (F.col("mapq") >= min_mapq) & F.col("md").isNotNull())
    found = rows.select("query", "chrom", F.explode(walk("start_pos", "cigar", "md", "seq")).alias("v"))
    return found.select("query", "chrom", "v.pos", "v.ref", "v.alt")


def read_alleles(df: DataFrame, snps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """(query, chrom, pos, allele, base, read_pos) at the SNPs (chrom, pos, ref, alts by commas) that mapped reads cover.

    Reads meet SNPs by number and place alone: both are grouped by STRETCH
    positions of a chromosome, a crowded stretch being dealt over several
    groups, and found there by binary search. What a read covers is then joined
    to its bases by the read's number, and only such reads are walked along.
    """

    @F.arrow_udf("array<struct<pos:int,allele:string,base:string,read_pos:int>>")
    def walk(start: pa.Array, cigar: pa.Array, seq: pa.Array, reverse: pa.Array, at: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (start, cigar, seq, reverse, at)), strict=True)
        found = [walk_alleles(s, c, q, r, [(x["pos"], x["ref"], x["alts"]) for x in k]) for s, c, q, r, k in rows]
        return _structs(found, {"pos": pa.int32(), "allele": pa.string(), "base": pa.string(), "read_pos": pa.int32()})

    used = cigar_end(df.where((F.col("cigar") != "*") & (F.col("mapq") >= min_mapq) & F.col("chrom").isNotNull()))
    rows = write_table(used.withColumn("rid", F.monotonically_increasing_id()).select("rid", "query", "chrom", "start_pos", "end_pos", "cigar", "seq", "flag"), "reads")
    # an insertion before the last base counts at the base before it, within the range
    stretches = F.sequence(F.floor(F.col("start_pos") / STRETCH), F.floor((F.col("end_pos") - 1) / STRETCH))
    placed = rows.where("start_pos < end_pos").select("rid", "chrom", "start_pos", "end_pos", F.explode(stretches).alias("stretch"))
    crowded = placed.groupBy("chrom", "stretch").count().where(F.col("count") > MOST_READS)
    crowded = write_table(crowded.select("chrom", "stretch", F.ceil(F.col("count") / MOST_READS).cast("int").alias("deals")), "reads-crowded")
    deals = F.coalesce("deals", F.lit(1))
    dealt = join_sized(placed, crowded, ["chrom", "stretch"]).withColumn("deal", F.pmod(F.xxhash64("rid"), deals).cast("int")).drop("deals")
    known = snps.select("chrom", "pos", "ref", "alts").where("pos is not null").withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    copies = join_sized(known, crowded, ["chrom", "stretch"]).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    key = ["chrom", "stretch", "deal"]
    met = dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_covered, "rid bigint, at array<struct<pos:int,ref:string,alts:string>>")
    reverse = F.col("flag").bitwiseAND(16) != 0
    found = rows.join(met, "rid").select("query", "chrom", F.explode(walk("start_pos", "cigar", "seq", reverse, "at")).alias("v"))
    return found.select("query", "chrom", "v.pos", "v.allele", "v.base", "v.read_pos")


def _covered(reads: pa.Table, snps: pa.Table) -> pa.Table:
    """(rid, at): the SNPs within each read of a stretch that covers any, in order."""
    snps = snps.sort_by([("pos", "ascending"), ("ref", "ascending"), ("alts", "ascending")])
    pos = snps["pos"].to_numpy()
    begin, end = np.searchsorted(pos, reads["start_pos"].to_numpy(), "left"), np.searchsorted(pos, reads["end_pos"].to_numpy(), "left")
    some = np.flatnonzero(begin < end)
    size = (end - begin)[some]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[some], size)
    parts = snps.select(["pos", "ref", "alts"]).take(pa.array(at)).combine_chunks()
    columns = [parts[c].combine_chunks() if isinstance(parts[c], pa.ChunkedArray) else parts[c] for c in ("pos", "ref", "alts")]
    flat = pa.StructArray.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], ["pos", "ref", "alts"])
    return pa.table({"rid": reads["rid"].take(pa.array(some)), "at": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat)})


def qc_summary(pairs: DataFrame, mito: int = 11, chloro: int = 12, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """For each taxon: the most frequent insert size (0 to 1000, on ties the smallest) of well mapped pairs, and the organelles' shares of all pairs' first mates."""
    sized = insert_size(pairs)
    good = sized.where((F.col("mapq_f") >= min_mapq) & (F.col("mapq_b") >= min_mapq) & F.col("insert_size").between(0, MOST_INSERT))
    counted = good.groupBy("taxon", "insert_size").count()
    order = Window.partitionBy("taxon").orderBy(F.desc("count"), "insert_size")
    mode = counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("taxon", F.col("insert_size").alias("insert_mode"))
    share: Callable[[int], Column] = lambda c: F.round(F.count_if(F.col("chrom_f") == c) / F.count("*"), 6)
    shares = pairs.groupBy("taxon").agg(F.count("*").alias("n_pairs"), share(mito).alias("mito"), share(chloro).alias("chloro"))
    return shares.join(mode, "taxon", "left")
