"""Genotype tables in long form, (taxon, chrom, pos, a1, a2) with 0, 1 or null: predicates, statistics, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

#: Bits of what an allele can be at a site.
ROLES = {"reference": 1, "alternative": 2, "alternative2": 4, "major": 8, "minor": 16, "minor2": 32, "ancestral": 64, "derived": 128}

_SITE = ["chrom", "pos"]


def _missing() -> Column:
    return F.col("a1").isNull() | F.col("a2").isNull()


def _dosage() -> Column:
    return F.col("a1") + F.col("a2")


def classify(gt: DataFrame) -> DataFrame:
    """Add boolean columns of what a cell is; all but ``missing`` are false where it is missing."""
    no = F.lit(False)
    flag = lambda c: F.coalesce(c, no)
    a1, a2 = F.col("a1"), F.col("a2")
    return gt.withColumns(
        {
            "missing": _missing(),
            "het": flag(a1 != a2),
            "hom": flag(a1 == a2),
            "phase1_alt": flag((a1 == 1) & ~_missing()),
            "phase2_alt": flag((a2 == 1) & ~_missing()),
            "phase1_ref": flag((a1 == 0) & ~_missing()),
            "phase2_ref": flag((a2 == 0) & ~_missing()),
        }
    )


def genotype_bases(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """Add the two letters of a cell, ``NN`` where missing, and its code (first base << 4) + second, -1 where missing."""
    joined = gt.join(sites.select("chrom", "pos", "ref", "alt"), _SITE)
    base = lambda a: F.when(a == 1, F.col("alt")).otherwise(F.col("ref"))
    numbered = joined.withColumn("b1", base(F.col("a1"))).withColumn("b2", base(F.col("a2")))
    first, second = F.expr("position(b1 IN 'ACGTDI') - 1"), F.expr("position(b2 IN 'ACGTDI') - 1")
    return numbered.select(
        *gt.columns,
        F.when(_missing(), "NN").otherwise(F.concat("b1", "b2")).alias("bases"),
        F.when(_missing(), -1).otherwise(F.shiftleft(first, 4) + second).cast("int").alias("code"),
    )


def _cell_counts() -> list[Column]:
    called = ~_missing()
    het = F.count_if(called & (F.col("a1") != F.col("a2")))
    return [
        F.count_if(_missing()).alias("missing"),
        F.count_if(called).alias("called"),
        het.alias("het"),
        F.count_if(called & (F.col("a1") == F.col("a2"))).alias("hom"),
        F.round(F.try_divide(het, F.count_if(called)), 6).alias("het_prop"),
    ]


def site_stats(gt: DataFrame) -> DataFrame:
    """Missing, called, heterozygous and homozygous taxa of each site, its alternative alleles and the taxa with any."""
    alt = [F.coalesce(F.sum(_dosage()), F.lit(0)).alias("alt_alleles"), F.count_if(_dosage() > 0).alias("alt_taxa")]
    return gt.groupBy(*_SITE).agg(*_cell_counts(), *alt)


def taxon_stats(gt: DataFrame) -> DataFrame:
    """Missing, called, heterozygous and homozygous sites of each taxon. Few keys, combined before the shuffle."""
    return gt.groupBy("taxon").agg(*_cell_counts())


def allele_freq(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """Frequencies over called taxa, and which base is minor: alt below one half, else ref; nulls where none is called."""
    alt = F.try_divide(F.sum(_dosage()), 2 * F.count_if(~_missing()))
    freq = gt.groupBy(*_SITE).agg(alt.alias("f"))
    rare = F.col("f") < 0.5
    minor = F.least("f", 1 - F.col("f"))
    return freq.join(sites.select("chrom", "pos", "ref", "alt"), _SITE).select(
        *_SITE,
        F.round("f", 6).alias("alt_freq"),
        F.round(1 - F.col("f"), 6).alias("ref_freq"),
        F.round(minor, 6).alias("maf"),
        F.round(1 - minor, 6).alias("major_freq"),
        F.when(rare, F.col("alt")).when(~rare, F.col("ref")).alias("minor_base"),
        F.when(rare, F.col("ref")).when(~rare, F.col("alt")).alias("major_base"),
    )


def with_roles(df: DataFrame, roles: dict[str, Column], name: str = "roles") -> DataFrame:
    """Add a bit mask with the bit of each role whose condition holds; a null condition does not."""
    mask = F.lit(0)
    for role, holds in roles.items():
        mask = mask.bitwiseOR(F.when(holds, ROLES[role]).otherwise(0))
    return df.withColumn(name, mask)


def has_role(role: str, name: str = "roles") -> Column:
    return F.col(name).bitwiseAND(ROLES[role]) != 0


def site_stats_ad(calls: DataFrame, n_alleles: int = 3) -> DataFrame:
    """Statistics of sites with several alleles from calls (g1, g2, ad): taxa missing and called, depths, presence, genotypes.

    ``maf`` is the share of allele 1 folded to at most one half.
    """
    g1, g2 = F.col("g1"), F.col("g2")
    count = lambda c: F.count_if(c)
    depth = [F.coalesce(F.sum(F.get("ad", F.lit(i)).cast("bigint")), F.lit(0)) for i in range(n_alleles)]
    here = [count(F.get("ad", F.lit(i)) > 0) for i in range(n_alleles)]
    pairs = [count((g1 == i) & (g2 == j)) for i in range(n_alleles) for j in range(i, n_alleles)]
    share = F.try_divide(count(g1 == 1) + count(g2 == 1), 2 * count(g1.isNotNull()))
    total = depth[0]
    for d in depth[1:]:
        total = total + d
    return calls.groupBy(*_SITE).agg(
        count(g1.isNull()).alias("missing"), count(g1.isNotNull()).alias("called"), F.concat_ws(",", *depth).alias("allele_depth"),
        total.alias("depth"), F.concat_ws(",", *here).alias("presence"), F.concat_ws(",", *pairs).alias("genotypes"),
        count(g1 != g2).alias("het"), F.round(F.least(share, 1 - share), 6).alias("maf"),
    )


def drop_taxa(gt: DataFrame, taxa: DataFrame) -> DataFrame:
    return join_sized(gt, taxa.select("taxon").distinct(), ["taxon"], "left_anti")


def override(gt: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells of ``patch`` (taxon, chrom, pos, a1, a2) instead of those of ``gt``, null ones too; cells that gt lacks are not added."""
    new = patch.select("taxon", "chrom", "pos", F.struct("a1", "a2").alias("new"))
    joined = gt.join(new, ["taxon", "chrom", "pos"], "left")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("taxon", "chrom", "pos", pick("a1"), pick("a2"))


def subset_sites(gt: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells at listed sites. The list may be long: the engine chooses how to join."""
    return gt.join(sites.select(*_SITE).distinct(), _SITE, "left_semi")


def subset_taxa(gt: DataFrame, taxa: DataFrame) -> DataFrame:
    return join_sized(gt, taxa.select("taxon").distinct(), ["taxon"], "left_semi")


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    if left.join(right, keys, "left_anti").limit(1).count() or right.join(left, keys, "left_anti").limit(1).count():
        raise ValueError(f"the tables differ in {' and '.join(keys)}")


def merge_by_site(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sites of two tables over the same taxa; an error if the taxa differ."""
    _same_keys(a, b, ["taxon"])
    return a.unionByName(b)


def merge_by_taxon(a: DataFrame, b: DataFrame) -> DataFrame:
    """The taxa of two tables over the same sites; an error if the sites differ."""
    _same_keys(a, b, _SITE)
    return a.unionByName(b)


def sort_sites(df: DataFrame) -> DataFrame:
    return df.orderBy(*_SITE)


def sort_taxa(df: DataFrame) -> DataFrame:
    return df.orderBy("taxon", *_SITE, *[c for c in ("a1", "a2") if c in df.columns])


def with_site_index(sites: DataFrame) -> DataFrame:
    """Add ``idx``, the place of a site in the order of (chrom, pos), from 0.

    Sites are numbered within stretches of 2^20 positions of a chromosome, and
    the few stretches' running totals are added, so no task sorts a chromosome.
    """
    keyed = sites.withColumn("__stretch", F.shiftright("pos", 20))
    sizes = keyed.groupBy("chrom", "__stretch").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("chrom", "__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("chrom", "__stretch", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("chrom", "__stretch").orderBy("pos")) - 1
    return keyed.withColumn("__place", place).join(offsets, ["chrom", "__stretch"]).withColumn("idx", F.col("__before") + F.col("__place")).drop("__stretch", "__place", "__before")


def chrom_bounds(sites: DataFrame) -> DataFrame:
    """First index, index after the last, and number of sites of each chromosome."""
    sizes = sites.groupBy("chrom").agg(F.count("*").alias("n_sites"))
    last = F.sum("n_sites").over(Window.orderBy("chrom"))
    return sizes.withColumn("end_idx", last).select("chrom", (F.col("end_idx") - F.col("n_sites")).alias("start_idx"), "end_idx", "n_sites")


def polarise(gt: DataFrame, sites: DataFrame, ancestral: DataFrame, pops: DataFrame) -> DataFrame:
    """Cells with the population of their taxon and their derived alleles, where the ancestral base is ref or alt.

    ``ancestral`` (chrom, pos, anc), ``pops`` (taxon, pop) is a sample sheet.
    """
    known = sites.join(ancestral, _SITE).where("anc = ref OR anc = alt").select(*_SITE, (F.col("anc") == F.col("ref")).alias("ref_is_anc"))
    return join_sized(gt.join(known, _SITE), pops, ["taxon"], "inner").select(
        "taxon", "pop", *_SITE, F.when(F.col("ref_is_anc"), _dosage()).otherwise(2 - _dosage()).alias("derived")
    )
