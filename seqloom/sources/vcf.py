"""VCF text as tables, and tables as VCF text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

FIXED = 9


def vcf_taxa(lines: DataFrame) -> DataFrame:
    """(idx, taxon) from the ``#CHROM`` line; one row for each sample column."""
    head = lines.where(F.col("value").startswith("#CHROM")).select(F.split("value", "\t").alias("f"))
    return head.select(F.posexplode(F.slice("f", FIXED + 1, F.size("f")))).toDF("idx", "taxon")


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path)
    body = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    record = body.select(
        F.col("f")[0].cast("int").alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.slice("f", FIXED + 1, F.size("f")).alias("cells"),
    )
    return record, vcf_taxa(lines)


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sites (chrom, pos, ref, alt) and genotypes (taxon, chrom, pos, a1, a2) of a VCF, plain or gzipped.

    REF and ALT show their first character. A genotype that begins with a dot
    is missing; else its first and third character make phases, 1 for ``1`` and
    0 for all others. The header's taxa are broadcast behind a count.
    """
    record, taxa = _records(spark, path)
    sites = record.select("chrom", "pos", F.substring("ref", 1, 1).alias("ref"), F.substring("alt", 1, 1).alias("alt"))
    cells = record.select("chrom", "pos", F.posexplode("cells").alias("idx", "cell"))
    here = ~F.col("cell").startswith(".")
    phase = lambda at: F.when(here, (F.substring("cell", at, 1) == "1").cast("int"))
    genotypes = join_sized(cells, taxa, ["idx"], "inner").select("taxon", "chrom", "pos", phase(1).alias("a1"), phase(3).alias("a2"))
    return sites, genotypes


def read_vcf_ad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sites (chrom, pos, ref, alts) and genotypes (taxon, chrom, pos, a1, a2, ad) with allele numbers and depths, the second FORMAT field.

    Genotypes may be phased (``|``) or not (``/``); a missing one has nulls.
    """
    record, taxa = _records(spark, path)
    sites = record.select("chrom", "pos", "ref", F.split("alt", ",").alias("alts"))
    cells = record.select("chrom", "pos", F.posexplode("cells").alias("idx", "cell"))
    parts = F.split("cell", ":")
    alleles = F.split(parts[0], r"[|/]")
    genotypes = join_sized(cells, taxa, ["idx"], "inner").select(
        "taxon", "chrom", "pos", F.get(alleles, F.lit(0)).try_cast("int").alias("a1"), F.get(alleles, F.lit(1)).try_cast("int").alias("a2"),
        F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda x: x.try_cast("int")).alias("ad"),
    )
    return sites, genotypes.withColumn("ad", F.when(F.col("a1").isNotNull(), F.col("ad")))


def genotype_rows(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """One line of text a site, taxa in order of name: (chrom, pos, value)."""
    text = F.when(F.col("a1").isNull(), "./.").otherwise(F.concat_ws("/", "a1", "a2"))
    cells = genotypes.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("taxon", text.alias("gt")))).alias("cells"))
    samples = F.array_join(F.transform("cells", lambda c: c["gt"]), "\t")
    return sites.join(cells, ["chrom", "pos"]).select(
        "chrom", "pos", F.concat_ws("\t", "chrom", "pos", F.concat_ws("-", "chrom", "pos"), "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), samples).alias("value")
    )


def write_vcf(sites: DataFrame, genotypes: DataFrame, path: str, notes: tuple[str, ...] = ("fileformat=VCFv4.2",)) -> None:
    """Annotation lines, the header and a line for each site in order; part files in their order are one VCF.

    Rows are ranged by position over many files. The header, a bounded number
    of lines, sorts before all positions.
    """
    spark = sites.sparkSession
    taxa = sorted(r[0] for r in genotypes.select("taxon").distinct().collect())
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *taxa]
    head = [(-1, i, f"##{n}") for i, n in enumerate(notes)] + [(-1, len(notes), "\t".join(columns))]
    rows = spark.createDataFrame(head, "chrom int, pos int, value string").union(genotype_rows(sites, genotypes).select(F.col("chrom").cast("int"), F.col("pos").cast("int"), "value"))
    rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.text(path)
