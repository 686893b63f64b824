"""Genotypes from allele counts by maximum likelihood, and summaries of sites."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.05
MAX_DEPTH = 150
#: Taxa of a sheet that is broadcast, at most.
MOST_TAXA = 200_000
MAX_COUNT = 32767

#: log10 of n! for n up to MAX_DEPTH.
_LOG_FACTORIALS = [math.lgamma(n + 1) / math.log(10) for n in range(MAX_DEPTH + 1)]


def genotype_pairs(n_alleles: int) -> list[tuple[int, int]]:
    """Pairs i <= j in the order in which equal likelihoods are decided."""
    return [(i, j) for i in range(n_alleles) for j in range(i, n_alleles)]


def likelihood_order(n_alleles: int) -> list[tuple[int, int]]:
    """Pairs i <= j in the order of a GL field, in which (i, j) is at j * (j + 1) / 2 + i."""
    return [(i, j) for j in range(n_alleles) for i in range(j + 1)]


def allele_counts(depths: DataFrame, n_alleles: int = 3) -> DataFrame:
    """(taxon, chrom, pos, counts): depth of each allele 0 .. n_alleles - 1 at a site, 0 where it has none."""
    sums = [F.coalesce(F.sum(F.when(F.col("allele") == i, F.col("depth"))), F.lit(0)).cast("int") for i in range(n_alleles)]
    return depths.groupBy("taxon", "chrom", "pos").agg(F.array(*sums).alias("counts"))


def call_genotypes(counts: DataFrame, n_alleles: int = 3, err: float = ERROR_RATE) -> DataFrame:
    """Add g1, g2, gt, ad and gl to rows with ``counts`` of alleles, by row-wise expressions without a shuffle.

    The genotype i/j has the smallest negative log10 likelihood, on ties the
    first in (0,0), (0,1), ..; without reads it is missing: null g1 and g2,
    ``./.`` and null gl. Above MAX_DEPTH reads the counts are scaled down for
    the likelihood alone; ``ad`` shows them as they are. Shorter arrays than
    ``n_alleles`` leave out the genotypes of alleles they lack.
    """
    raw = [F.get("counts", F.lit(i)) for i in range(n_alleles)]
    here = [F.size("counts") > i for i in range(n_alleles)]
    depth = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    deep = F.col("__depth") > MAX_DEPTH
    df = counts.withColumn("__depth", depth)
    scaled = [F.when(deep, F.floor(c * F.lit(MAX_DEPTH) / F.col("__depth"))).otherwise(c).cast("int") for c in raw]
    df = df.withColumns({f"__n{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(scaled)})
    df = df.withColumn("__total", F.least(F.col("__depth"), F.lit(MAX_DEPTH)).cast("int"))
    same, mixed, other = (math.log10(x) for x in (1 - 0.75 * err, 0.5 - err / 4, err / 4))
    n = [F.col(f"__n{i}") for i in range(n_alleles)]
    total = F.col("__total")

    def cost(i: int, j: int) -> Column:
        fits = n[i] * F.lit(same) if i == j else (n[i] + n[j]) * F.lit(mixed)
        rest = total - n[i] if i == j else total - n[i] - n[j]
        return F.when(here[j] & (total > 0), -(fits + rest * F.lit(other)))

    pairs = genotype_pairs(n_alleles)
    df = df.withColumns({f"__c{i}{j}": cost(i, j) for i, j in pairs})
    factorials = F.array(*map(F.lit, _LOG_FACTORIALS))
    log = lambda c: F.element_at(factorials, c + 1)
    ways = log(total) - reduce(lambda a, b: a + b, (log(c) for c in n))
    least = F.least(*(F.col(f"__c{i}{j}") for i, j in pairs))
    first, second = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, j in reversed(pairs):
        hit = F.col(f"__c{i}{j}") == least
        first, second = F.when(hit, i).otherwise(first), F.when(hit, j).otherwise(second)
    df = df.withColumn("g1", first).withColumn("g2", second).withColumn("__ways", ways)
    shown = [F.floor(F.round(F.col(f"__c{i}{j}") - F.col("__ways"), 9) + 0.5).cast("bigint") for i, j in likelihood_order(n_alleles)]
    gl = F.when(total > 0, F.filter(F.array(*shown), lambda x: x.isNotNull()))
    gt = F.when(F.col("g1").isNull(), "./.").otherwise(F.concat_ws("/", "g1", "g2"))
    return df.withColumns({"gl": gl, "gt": gt, "ad": F.col("counts")}).select(*counts.columns, "g1", "g2", "gt", "ad", "gl")


def site_info(calls: DataFrame, n_alleles: int = 3, alt_only_ac: bool = False) -> DataFrame:
    """One row a site: dp, nz, ad, ac, gn, ht and maf, by one aggregation that combines before the shuffle.

    ``nz`` counts called taxa, ``ac`` the occurrences of each allele (without
    the reference if ``alt_only_ac``), ``gn`` the genotypes in the order 00, 01,
    .., 11, .., and maf is the share of allele 0, folded to at most 1/2; null
    where no taxon is called.
    """
    one = lambda c: F.count_if(c)
    g1, g2 = F.col("g1"), F.col("g2")
    depth = [F.coalesce(F.sum(F.get("ad", F.lit(i)).cast("bigint")), F.lit(0)) for i in range(n_alleles)]
    occurs = [one(g1 == i) + one(g2 == i) for i in range(n_alleles)]
    pairs = [one((g1 == i) & (g2 == j)) for i, j in genotype_pairs(n_alleles)]
    share = F.try_divide(occurs[0], one(g1.isNotNull()) * 2)
    return calls.groupBy("chrom", "pos").agg(
        reduce(lambda a, b: a + b, depth).alias("dp"),
        one(g1.isNotNull()).alias("nz"),
        F.concat_ws(",", *depth).alias("ad"),
        F.concat_ws(",", *occurs[1 if alt_only_ac else 0 :]).alias("ac"),
        F.concat_ws(",", *pairs).alias("gn"),
        one(g1 != g2).alias("ht"),
        F.round(F.least(share, 1 - share), 6).alias("maf"),
    )


def vcf_rows(sites: DataFrame, info: DataFrame, calls: DataFrame) -> DataFrame:
    """VCF body rows: id ``chrom-pos``, INFO, FORMAT GT:AD:GL and the sample columns, taxa in order of name.

    ``sites`` (chrom, pos, ref, alts array). Calls of a site meet in one row,
    which is as wide as there are taxa.
    """
    cell = F.when(F.col("g1").isNull(), F.lit("./.")).otherwise(F.concat_ws(":", "gt", F.array_join("ad", ","), F.array_join("gl", ",")))
    cells = calls.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("taxon", cell.alias("cell")))).alias("cells"))
    text = F.concat(
        F.lit("DP="), "dp", F.lit(";NZ="), "nz", F.lit(";AD="), "ad", F.lit(";AC="), "ac", F.lit(";GN="), "gn", F.lit(";HT="), "ht",
        F.lit(";MAF="), F.coalesce(F.format_string("%.6f", "maf"), F.lit(".")),
    )
    return (
        sites.join(info, ["chrom", "pos"])
        .join(cells, ["chrom", "pos"])
        .select(
            "chrom", "pos", F.concat_ws("-", "chrom", "pos").alias("id"), "ref", F.array_join("alts", ",").alias("alt"), text.alias("info"),
            F.lit("GT:AD:GL").alias("format"), F.array_join(F.transform("cells", lambda x: x["cell"]), "\t").alias("samples"),
        )
    )


def _every_taxon(sites: DataFrame, found: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxon, chrom, pos, counts) for each of ``sites`` and each taxon of a sample sheet, null where ``found`` has none.

    The cells of a site meet in one row, and those of the missing taxa are made
    there: the grid of sites by taxa is never shuffled. The sheet is one row,
    broadcast if it names at most MOST_TAXA; the engine chooses beyond that.
    """
    listed = taxa.select("taxon").distinct()
    sheet = listed.agg(F.collect_list("taxon").alias("sheet"))
    if listed.limit(MOST_TAXA + 1).count() <= MOST_TAXA:
        sheet, listed = F.broadcast(sheet), F.broadcast(listed)
    cells = found.join(listed, "taxon", "left_semi").groupBy("chrom", "pos").agg(F.collect_list(F.struct("taxon", "counts")).alias("cells"))
    rows = sites.select("chrom", "pos").join(cells, ["chrom", "pos"], "left").crossJoin(sheet)  # a row each: the sheet is a single row
    have = F.coalesce("cells", F.array().cast(cells.schema["cells"].dataType))
    none = F.transform(F.array_except("sheet", F.transform(have, lambda c: c["taxon"])), lambda t: F.struct(t.alias("taxon"), F.lit(None).cast("array<int>").alias("counts")))
    return rows.select("chrom", "pos", F.explode(F.concat(have, none)).alias("c")).select("c.taxon", "chrom", "pos", "c.counts")


def scan_counts(library: DataFrame, symbols: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxon, chrom, pos, counts): reads of the reference and of each alternative allele at every library position.

    ``library`` (chrom, pos, alts array of (allele, indel_len)), ``symbols``
    (taxon, chrom, pos, code, indel_len, n) with code -1 for the reference.
    Reads that match no alternative count as reference, as depth less the
    alternatives'. Null counts where a taxon has no reads; a count is capped at
    MAX_COUNT. ``taxa`` is a sample sheet; reads meet the library, and each
    other, by site.
    """
    alts = library.select("chrom", "pos", "alts")
    read = F.struct("code", "indel_len", "n")
    seen = symbols.join(alts, ["chrom", "pos"]).groupBy("chrom", "pos", "taxon").agg(F.collect_list(read).alias("reads"), F.first("alts").alias("alts"))

    def of(alt: Column) -> Column:
        mine = F.filter("reads", lambda r: (r["code"] == alt["allele"]) & (r["indel_len"] == alt["indel_len"]))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, r: a + r["n"])

    depth = F.aggregate("reads", F.lit(0).cast("bigint"), lambda a, r: a + r["n"])
    hits = F.transform("alts", of)
    rest = depth - F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x)
    counts = F.transform(F.concat(F.array(rest), hits), lambda x: F.least(x, F.lit(MAX_COUNT)).cast("int"))
    return _every_taxon(alts, seen.select("taxon", "chrom", "pos", counts.alias("counts")), taxa)


def hap_scan(pos_alleles: DataFrame, pileup: DataFrame, taxa: DataFrame) -> DataFrame:
    """Allele counts at given alleles from pileup counts, without discovery: (taxon, chrom, pos, counts).

    ``pos_alleles`` (chrom, pos, ref, alts array of A, C, G, T, D or I) and
    ``pileup`` (taxon, chrom, pos, ref_n, counts array of A C G T D I). The
    reference count is that of ``.`` and ``,`` less the indels, for each indel
    follows a base that was counted; it is not less than 0. Null counts where a
    taxon has no reads at the site.
    """
    code = F.create_map(*[F.lit(x) for pair in zip("ACGTDI", range(6), strict=True) for x in pair])
    seen = pileup.select("taxon", "chrom", "pos", "ref_n", F.col("counts").alias("seen")).where("ref_n IS NOT NULL").join(pos_alleles.select("chrom", "pos", "alts"), ["chrom", "pos"])
    alts = F.transform("alts", lambda a: F.coalesce(F.get("seen", code[a]), F.lit(0)).cast("int"))
    reference = F.greatest(F.col("ref_n") - F.get("seen", F.lit(4)) - F.get("seen", F.lit(5)), F.lit(0)).cast("int")
    return _every_taxon(pos_alleles, seen.select("taxon", "chrom", "pos", F.concat(F.array(reference), alts).alias("counts")), taxa)


def counts_text(counts: DataFrame) -> DataFrame:
    """Allele counts as text, ``n0,n1,..`` or a dot for missing ones."""
    return counts.select("taxon", "chrom", "pos", F.coalesce(F.array_join("counts", ","), F.lit(".")).alias("counts"))
