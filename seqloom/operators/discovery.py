"""From pileups to variants of each taxon, and to a library of variants over all taxa."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

#: Codes of alleles by their place; equal counts go to the higher code.
ALLELES = "ACGTDI"
DELETION, INSERTION = 4, 5
MAX_INDEL_LENGTH = 63
BIN_SIZE = 5_000_000


@dataclass(frozen=True)
class Params:
    """Thresholds of variant discovery."""

    min_depth: int = 2
    min_depth_ratio: float = 0.2
    max_depth_ratio: float = 3.0
    hom_ratio: float = 0.8
    het_ratio: float = 0.35
    third_ratio: float = 0.2
    max_indel_types: int = 1


_BODY = re.compile(r"\^.|[-+](\d+)")


def _count_bases(bases: str) -> tuple[list[int], int, list[int], list[int], list[str]]:
    """Counts by code, reference count, insertion lengths, deletion lengths and indel sequences of one pileup string."""
    inserted, deleted, bodies, kept, at = [], [], [], [], 0
    for m in _BODY.finditer(bases):
        if m.start() < at:
            continue
        kept.append(bases[at : m.start()])
        at = m.end()
        if m[1]:
            length = int(m[1])
            bodies.append(("I" if m[0][0] == "+" else "D") + bases[at : at + length].upper())
            (inserted if m[0][0] == "+" else deleted).append(length)
            at += length
    plain = ("".join(kept) + bases[at:]).upper()
    counts = [plain.count(b) for b in "ACGT"] + [len(deleted), len(inserted)]
    return counts, plain.count(".") + plain.count(","), inserted, deleted, bodies


def pileup_allele_counts(pileup: DataFrame) -> DataFrame:
    """Allele counts of (taxon, chrom, pos, ref, depth, bases) rows.

    Adds ``counts`` of A C G T, deletions and insertions (both strands),
    ``ref_n`` of ``.`` and ``,``, the distinct lengths ``ins_lens`` and
    ``del_lens`` and the distinct ``indel_seqs``. Bodies of indels, of any
    length, and the quality sign after ``^`` are not bases; ``*``, ``$`` and
    others are not counted. Null bases count as empty. Rows that only agree
    with the reference, most of a pileup, are counted by built-in functions and
    their bases do not reach a Python worker.
    """
    schema = "struct<counts:array<int>,ref_n:int,ins_lens:array<int>,del_lens:array<int>,indel_seqs:array<string>>"

    @F.arrow_udf(schema)
    def parse(bases: pa.Array) -> pa.Array:
        rows = [_count_bases(text or "") for text in bases.to_pylist()]
        counts, ref, *sets = zip(*rows, strict=True) if rows else ((),) * 5
        lists = [[sorted(set(values)) if values else values for values in column] for column in sets]
        ints = pa.list_(pa.int32())
        columns = [pa.array(counts, ints), pa.array(ref, pa.int32()), *(pa.array(x, t) for x, t in zip(lists, (ints, ints, pa.list_(pa.string())), strict=True))]
        return pa.StructArray.from_arrays(columns, ["counts", "ref_n", "ins_lens", "del_lens", "indel_seqs"])

    alike = F.coalesce(F.translate("bases", ".,", "") == "", F.lit(True))
    parsed = pileup.withColumn("__p", parse(F.when(alike, None).otherwise(F.col("bases"))))
    size = F.coalesce(F.length("bases"), F.lit(0))
    ref = F.when(alike, size).otherwise(F.col("__p.ref_n"))
    return parsed.select(*pileup.columns, "__p.counts", ref.alias("ref_n"), "__p.ins_lens", "__p.del_lens", "__p.indel_seqs")


def merge_bams(pileup: DataFrame) -> DataFrame:
    """One row a taxon and site from several BAMs: depths summed, bases joined in order of ``bam_no``."""
    parts = F.array_sort(F.collect_list(F.struct("bam_no", "bases")))
    return pileup.groupBy("taxon", "chrom", "pos").agg(
        F.max("ref").alias("ref"), F.sum("depth").alias("depth"), F.array_join(F.transform(parts, lambda x: x["bases"]), "").alias("bases")
    )


def symbol_sites(symbols: DataFrame) -> DataFrame:
    """(taxon, chrom, pos, depth, alleles, indel_types) from symbol counts.

    ``alleles`` is an array of (n, code, indel_len) of all but the reference,
    summed over indel lengths for n and sorted downward; an indel shows its
    most frequent length, on ties the longest.
    """
    by_code = symbols.groupBy("taxon", "chrom", "pos", "code").agg(
        F.sum("n").alias("n"), F.max_by("indel_len", F.struct("n", "indel_len")).alias("indel_len"), F.count_distinct("indel_len").alias("lengths")
    )
    other = F.col("code") >= 0
    return by_code.groupBy("taxon", "chrom", "pos").agg(
        F.sum("n").alias("depth"),
        F.sort_array(F.collect_list(F.when(other, F.struct("n", "code", "indel_len"))), asc=False).alias("alleles"),
        F.coalesce(F.sum(F.when(F.col("code") >= DELETION, F.col("lengths"))), F.lit(0)).alias("indel_types"),
    )


def discover_variants(sites: DataFrame, taxa: DataFrame, p: Params = Params()) -> DataFrame:
    """The variant a taxon shows at a site: (taxon, chrom, pos, allele, indel_len), by filters within the row.

    ``sites`` are those of :func:`symbol_sites`, with ``ref`` if there is one:
    sites whose reference is not A, C, G or T are dropped. ``taxa`` (taxon,
    coverage) is a sample sheet, broadcast behind a count.
    """
    top, second = F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1))
    rows = sites.where(F.col("ref").isin(*"ACGT")) if "ref" in sites.columns else sites
    share = top["n"] / F.col("depth")
    cover = F.col("depth") / F.col("coverage")
    keep = (
        (F.col("depth") >= max(1, p.min_depth))
        & cover.between(p.min_depth_ratio, p.max_depth_ratio)
        & (F.size("alleles") > 0)
        & (F.col("indel_types") <= p.max_indel_types)
        & (share >= p.het_ratio)
        & ~((share > 1 - p.het_ratio) & (share < p.hom_ratio))
        & F.coalesce(second["n"] / F.col("depth") <= p.third_ratio, F.lit(True))
    )
    return (
        join_sized(rows, taxa.select("taxon", "coverage"), ["taxon"], "inner")
        .where(keep)
        .select("taxon", "chrom", "pos", top["code"].alias("allele"), top["indel_len"].alias("indel_len"))
    )


def build_library(ing: DataFrame, mao: int = 2, max_alt: int = 2, by_seq: bool = False) -> DataFrame:
    """(chrom, pos, alts): the alleles that most taxa show at a position, at most ``max_alt`` and in ``mao`` taxa or more.

    An allele is its code and its indel length, cut to MAX_INDEL_LENGTH, with
    ``by_seq`` its ``indel_seq`` as well. Equal counts: higher code, then longer
    indel first; with ``by_seq`` longer indel, then higher code, then sequence.
    Counting combines before its shuffle, then only counted alleles are ranked.
    """
    key = ["allele", "indel_len", *(["indel_seq"] if by_seq else [])]
    cut = ing.withColumn("indel_len", F.least("indel_len", F.lit(MAX_INDEL_LENGTH)))
    counted = cut.groupBy("chrom", "pos", *key).agg(F.count("*").alias("taxa"))
    ties = [F.desc("indel_len"), F.desc("allele"), F.asc("indel_seq")] if by_seq else [F.desc("allele"), F.desc("indel_len")]
    rank = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(F.desc("taxa"), *ties))
    best = counted.withColumn("rank", rank).where((F.col("rank") <= max_alt) & (F.col("taxa") >= mao))
    rows = F.array_sort(F.collect_list(F.struct("rank", *key, "taxa")))
    return best.groupBy("chrom", "pos").agg(rows.alias("alts")).select("chrom", "pos", F.transform("alts", lambda a: F.struct(*[a[k].alias(k) for k in (*key, "taxa")])).alias("alts"))


def merge_libraries(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """The positions of several libraries, of parts of the genome that do not overlap, in order."""
    out = first
    for lib in rest:
        out = out.unionByName(lib)
    return out.orderBy("chrom", "pos")


def customize_library(library: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The library at listed positions, and the listed positions that it lacks."""
    wanted = positions.select("chrom", "pos").distinct()
    return library.join(wanted, ["chrom", "pos"], "left_semi"), wanted.join(library, ["chrom", "pos"], "left_anti")


def library_text(library: DataFrame) -> DataFrame:
    """A library as text: alleles and indel lengths, each joined by commas."""
    letter = lambda a: F.substring(F.lit(ALLELES), a["allele"] + 1, 1)
    return library.select(
        "chrom", "pos", F.array_join(F.transform("alts", letter), ",").alias("alts"),
        F.array_join(F.transform("alts", lambda a: a["indel_len"].cast("string")), ",").alias("indel_lens"),
    )


def slice_region(df: DataFrame, region: str) -> DataFrame:
    """Rows of ``chrom`` or ``chrom:start,end``, both ends included."""
    chrom, _, ends = region.partition(":")
    rows = df.where(F.col("chrom") == int(chrom))
    if ends:
        start, end = ends.split(",")
        rows = rows.where(F.col("pos").between(int(start), int(end)))
    return rows


def with_bin(df: DataFrame, start: int = 1, size: int = BIN_SIZE) -> DataFrame:
    """Add ``bin``, the number of the half-open stretch of ``size`` positions from ``start`` on."""
    return df.withColumn("bin", F.floor((F.col("pos") - start) / size).cast("int"))


def ing_text(ing: DataFrame) -> DataFrame:
    """Variants of each taxon as text: position, base and indel length by tabs."""
    base = F.substring(F.lit(ALLELES), F.col("allele") + 1, 1)
    return ing.select("taxon", "chrom", "pos", F.concat_ws("\t", "pos", base, "indel_len").alias("line"))


@dataclass(frozen=True)
class JointParams:
    """Thresholds of the caller that looks at all taxa of a site together; ``max_p`` 1 lets every site pass."""

    min_ratio: float = 0.4
    min_depth_ratio: float = 0.2
    max_depth_ratio: float = 3.0
    third_ratio: float = 0.2
    max_p: float = 1.0
    min_taxa: int = 2


def joint_call(symbols: DataFrame, taxa: DataFrame, p: JointParams = JointParams()) -> DataFrame:
    """Sites that vary over all taxa: (chrom, pos, alts array of code, dp, ad, ap, nz, pv).

    Filters, in order: at most one indel type over all taxa; an alternative
    allele needs a taxon with a depth within the ratios of its coverage and over
    ``min_ratio`` of it; with two or more, the third most frequent symbol of no
    taxon may exceed ``third_ratio`` of its depth; not all of them may have
    chi-square p over ``max_p``; and with one alternative both alleles, with
    more the second most widespread, must occur in ``min_taxa`` taxa. Alleles
    go by total depth, then code. Two levels of grouping, by allele and by
    site, keep a site's row as small as its alleles.
    """
    reads = symbols.groupBy("taxon", "chrom", "pos", "code").agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("code") >= DELETION, F.col("indel_len"))).alias("lens"))
    per_taxon = reads.groupBy("taxon", "chrom", "pos").agg(
        F.sum("n").alias("depth"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"), F.collect_list(F.struct("code", "n", "lens")).alias("seen")
    )
    rows = join_sized(per_taxon, taxa.select("taxon", "coverage"), ["taxon"], "inner")
    third = F.coalesce(F.get("ns", F.lit(2)), F.lit(0)) / F.col("depth")
    fair = (F.col("depth") / F.col("coverage")).between(p.min_depth_ratio, p.max_depth_ratio)
    cells = rows.select("chrom", "pos", "taxon", "depth", third.alias("third"), fair.alias("fair"), F.posexplode("seen").alias("i", "s")).select(
        "chrom", "pos", "taxon", "depth", "third", "fair", "i", "s.*"
    )
    chi = F.sum(F.pow(F.col("n"), 2) / F.col("depth"))
    alleles = cells.groupBy("chrom", "pos", "code").agg(
        F.sum("n").alias("ad"), F.count("*").alias("ap"), F.bool_or(F.col("fair") & (F.col("n") / F.col("depth") > p.min_ratio)).alias("good"),
        F.array_distinct(F.flatten(F.collect_set("lens"))).alias("lens"), F.max("third").alias("third"), chi.alias("square"),
        F.count_if(F.col("i") == 0).alias("first"),  # the taxa whose first symbol it is; each has one
    )
    item = F.struct(F.col("ad"), F.col("code"), F.col("ap"), F.col("good"), F.col("third"), F.col("square"))
    site = alleles.groupBy("chrom", "pos").agg(F.sort_array(F.collect_list(item), asc=False).alias("all"), F.sum(F.size("lens")).alias("indel_types"), F.sum("ad").alias("dp"), F.sum("first").alias("nz"))
    site = site.withColumn("alts", F.filter("all", lambda a: (a["code"] >= 0) & a["good"])).withColumn("ref", F.get(F.filter("all", lambda a: a["code"] == -1), F.lit(0)))
    presence = F.sort_array(F.transform("alts", lambda a: a["ap"]), asc=False)
    ref_ap = F.coalesce(F.col("ref.ap"), F.lit(0))
    site = site.where(
        (F.col("indel_types") <= 1)
        & (F.size("alts") > 0)
        & ((F.size("alts") < 2) | ~F.exists("all", lambda a: a["third"] > p.third_ratio))
        & F.when(F.size("alts") == 1, F.least(ref_ap, F.get(presence, F.lit(0))) >= p.min_taxa).otherwise(
            F.get(F.sort_array(F.concat(presence, F.array(ref_ap)), asc=False), F.lit(1)) >= p.min_taxa
        )
    )
    site = site.withColumn("pv", chi_square_p(site_statistic(F.col("alts"), F.col("dp")), F.col("nz") - 1))
    if p.max_p < 1:
        site = site.where(F.exists("pv", lambda x: x <= p.max_p))
    pick = lambda field: F.transform("alts", lambda a: a[field])
    return site.select("chrom", "pos", pick("code").alias("alts"), "dp", "nz", pick("ad").alias("ad"), pick("ap").alias("ap"), "pv")


def site_statistic(alts: Column, depth: Column) -> Column:
    """Chi-square of each allele's reads against all others over the taxa.

    For a taxon with n of d reads and the share q = ad / dp of all taxa it sums
    (n - q d)^2 / (q (1 - q) d), which is (sum n^2 / d - q ad) / (q (1 - q)).
    """
    share = lambda a: a["ad"] / depth
    return F.transform(alts, lambda a: F.try_divide(a["square"] - a["ad"] * share(a), share(a) * (1 - share(a))))


def chi_square_p(statistics: Column, freedom: Column) -> Column:
    """Upper tail of the chi-square distribution for each statistic of an array; 1 without freedom or for a null."""

    @F.pandas_udf("array<double>")
    def tail(values: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([[upper_gamma(0.5 * n, 0.5 * v) if v is not None and v == v and n > 0 else 1.0 for v in (vs if vs is not None else [])] for vs, n in zip(values, k, strict=True)])

    return tail(statistics, freedom.cast("double"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
