"""Delimited tables, ranges, sample sheets, gene models and matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.session import join_sized

RANGES = "Chr int, Start int, End int"
GERMPLASM = "gid string, accession string, chinese_name string, english_name string, taxa_name string, contamination string, seed_storage string"


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table with header, plain or gzipped; all columns are text."""
    return spark.read.csv(path, sep=sep, header=True)


def write_table_text(df: DataFrame, path: str, keep: Column | None = None, sep: str = "\t", gzip: bool = False) -> None:
    rows = df.where(keep) if keep is not None else df
    rows.write.csv(path, sep=sep, header=True, compression="gzip" if gzip else "none")


def read_ranges(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """``Chr Start End [Value [Strand]]`` files as (chrom, start_pos, end_pos[, value[, strand]])."""
    schema = RANGES + ", Value double" * (columns > 3) + ", Strand tinyint" * (columns > 4)
    return spark.read.csv(path, sep="\t", header=True, schema=schema).toDF(*["chrom", "start_pos", "end_pos", "value", "strand"][:columns])


def write_ranges(df: DataFrame, path: str, keep: Column | None = None) -> None:
    names = ["Chr", "Start", "End", "Value", "Strand"][: len(df.columns)]
    (df.where(keep) if keep is not None else df).toDF(*names).write.csv(path, sep="\t", header=True)


def read_taxa_map(spark: SparkSession, path: str, kind: str = "coverage") -> DataFrame:
    """A sample sheet: (taxon, coverage | reference, bams array); ``kind`` is coverage, reference or bams. Taxa must be unique."""
    f = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("f"))
    f = f.where(F.lower(F.col("f")[0]) != "taxa")
    second = {"coverage": [F.col("f")[1].cast("double").alias("coverage")], "reference": [F.col("f")[1].alias("reference")], "bams": []}[kind]
    sheet = f.select(F.col("f")[0].alias("taxon"), *second, F.slice("f", 2 + len(second), F.size("f")).alias("bams"))
    return checked_taxa(sheet)


def checked_taxa(sheet: DataFrame) -> DataFrame:
    twice = sheet.groupBy("taxon").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"taxon {twice[0][0]} is listed more than once")
    return sheet


def taxa_totals(sheet: DataFrame) -> DataFrame:
    return sheet.agg(F.count("*").alias("n_taxa"), F.sum(F.size("bams")).alias("n_bams"))


def gbs_samples(barcodes: DataFrame, fastq_map: DataFrame) -> DataFrame:
    """Samples of libraries whose FASTQ files exist: (sample, library_key, barcode_r1, barcode_r2, fastq_r1, fastq_r2)."""
    key = F.concat_ws("_", "flowcell", "lane", "library")
    have = fastq_map.where("fastq_r1 <> 'NA' AND fastq_r2 <> 'NA'").select(key.alias("library_key"), "fastq_r1", "fastq_r2")
    return join_sized(barcodes.withColumn("library_key", key), have, ["library_key"], "inner").select(
        F.concat_ws("_", "sample", "library_key", "well").alias("sample"), "library_key", "barcode_r1", "barcode_r2", "fastq_r1", "fastq_r2"
    )


def read_germplasm(spark: SparkSession, path: str) -> DataFrame:
    """A germplasm bank in order of GID."""
    return spark.read.csv(path, sep="\t", header=True, schema=GERMPLASM).orderBy("gid")


def write_depth_stats(df: DataFrame, path: str) -> None:
    """A folder for each chromosome, rows in order of position within files."""
    df.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").csv(path, sep="\t", header=True)


def write_matrix(table: DataFrame, path: str) -> None:
    """A distance matrix (Dxy, distances by tabs) as text with the header ``Dxy`` and the taxa."""
    names = [r[0] for r in table.select("Dxy").orderBy("Dxy").collect()]
    head = table.sparkSession.createDataFrame([("", "Dxy\t" + "\t".join(names))], "k string, value string")
    head.union(table.select("Dxy", F.concat_ws("\t", "Dxy", "distances"))).orderBy("k").select("value").write.text(path)


_GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"
_KINDS = {"five_prime_UTR": "5UTR", "CDS": "CDS", "three_prime_UTR": "3UTR"}


def _gff_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=_GFF, comment="#").where("seqid RLIKE '^[0-9]'")


def _attribute(name: str) -> Column:
    return F.regexp_extract("attributes", rf"(?:^|;){name}=([^;]*)", 1)


def read_gff(spark: SparkSession, path: str, dialect: str = "wheat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes, transcripts and features of a GFF3: half-open ends, strand 1 for ``+`` and 0 else.

    Lines whose first character is a digit count, but exons and chromosomes.
    The maize dialect has ``gene:`` and ``transcript:`` before ids.
    """
    rows = _gff_lines(spark, path).where("type NOT IN ('exon', 'chromosome')")
    bare = lambda c: F.regexp_replace(c, "^(gene|transcript|CDS):", "") if dialect == "maize" else c
    base = [F.col("seqid").cast("int").alias("chrom"), F.col("start").alias("start_pos"), (F.col("end") + 1).alias("end_pos"), (F.col("strand") == "+").cast("int").alias("strand")]
    genes = rows.where("type = 'gene'").select(bare(_attribute("ID")).alias("gene"), *base)
    transcripts = rows.where("type IN ('mRNA', 'transcript')").select(bare(_attribute("Parent")).alias("gene"), bare(_attribute("ID")).alias("transcript"), *base)
    kind = reduce(lambda a, x: a.when(F.col("type") == x[0], x[1]), _KINDS.items(), F.when(F.lit(False), ""))
    features = rows.where(F.col("type").isin(*_KINDS)).select(bare(_attribute("Parent")).alias("transcript"), kind.alias("kind"), *base[:3])
    return genes, transcripts, features


def gff_gene_table(spark: SparkSession, path: str) -> DataFrame:
    """Flat table of genes: gene, biotype, chrom, start, end, strand and description, ``NA`` where absent."""
    or_na = lambda c: F.when(c == "", "NA").otherwise(c)
    return _gff_lines(spark, path).where("type = 'gene'").select(
        F.regexp_replace(_attribute("ID"), "^gene:", "").alias("gene"), or_na(_attribute("biotype")).alias("biotype"), F.col("seqid").alias("chrom"),
        F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.when(F.col("strand") == "+", 1).otherwise(0).alias("strand"), or_na(_attribute("description")).alias("description"),
    )


def gff_rename_organelles(lines: DataFrame) -> DataFrame:
    """GFF3 text lines (value) without scaffolds ``B73*``, their sequence regions included; Mt becomes 11, Pt 12."""
    kept = lines.where(~F.col("value").startswith("B73") & ~F.col("value").rlike(r"^##sequence-region\s+B73"))
    value = F.col("value")
    for old, new in (("Mt", "11"), ("Pt", "12")):
        value = F.regexp_replace(F.regexp_replace(value, rf"^{old}\t", f"{new}\t"), rf"^(##sequence-region\s+){old}\b", "${1}" + new)
    return kept.select(value.alias("value"))


def gene_model_text(models: DataFrame) -> DataFrame:
    """Nested gene models as text: gene, then transcript:start:end[kind start end ..] by tabs."""
    feature = lambda f: F.concat_ws(" ", f["kind"], f["start_pos"], f["end_pos"])
    part = lambda t: F.concat(F.concat_ws(":", t["transcript"], t["t_start"], t["t_end"]), F.lit("["), F.array_join(F.transform(F.coalesce(t["features"], F.array()), feature), ","), F.lit("]"))
    return models.select(F.concat_ws("\t", "gene", "chrom", "start_pos", "end_pos", "strand", F.array_join(F.transform(F.coalesce("transcripts", F.array()), part), ";")).alias("value"))


def write_gene_models(models: DataFrame, path: str) -> None:
    models.write.parquet(path)
