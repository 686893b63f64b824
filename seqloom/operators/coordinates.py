"""Coordinates of a wheat genome whose chromosomes are kept in two parts each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Length of the first part and of the whole of each chromosome, and its centromere.
CHROMOSOMES = (
    ("chr1A", 471304005, 594102056, 210200000, 215800000),
    ("chr1B", 438720154, 689851870, 237700000, 243500000),
    ("chr1D", 452179604, 495453186, 166200000, 173800000),
    ("chr2A", 462376173, 780798557, 326300000, 327000000),
    ("chr2B", 453218924, 801256715, 344400000, 351300000),
    ("chr2D", 462216879, 651852609, 264400000, 272500000),
    ("chr3A", 454103970, 750843639, 316900000, 319900000),
    ("chr3B", 448155269, 830829764, 345800000, 347000000),
    ("chr3D", 476235359, 615552423, 237100000, 243200000),
    ("chr4A", 452555092, 744588157, 264100000, 267900000),
    ("chr4B", 451014251, 673617499, 303900000, 304400000),
    ("chr4D", 451004620, 509857067, 182300000, 188200000),
    ("chr5A", 453230519, 709773743, 252500000, 255100000),
    ("chr5B", 451372872, 713149757, 198900000, 202500000),
    ("chr5D", 451901030, 566080677, 185600000, 188700000),
    ("chr6A", 452440856, 618079260, 283300000, 288700000),
    ("chr6B", 452077197, 720988478, 323000000, 327500000),
    ("chr6D", 450509124, 473592718, 211900000, 217400000),
    ("chr7A", 450046986, 736706236, 360200000, 363800000),
    ("chr7B", 453822637, 750620385, 308000000, 310100000),
    ("chr7D", 453812268, 638686055, 336300000, 341700000),
)


def chrom_info(spark: SparkSession) -> DataFrame:
    """Length, length of the first part, centromere and subgenome of each chromosome; 21 rows."""
    rows = [(*c, c[0][-1]) for c in CHROMOSOMES]
    return spark.createDataFrame(rows, "chromosome string, first_len int, chrom_len int, cen_start int, cen_end int, subgenome string")


def part_info(spark: SparkSession) -> DataFrame:
    """Parts 1 to 42: the chromosome, where the part begins on it, its length and its subgenome."""
    rows = []
    for i, (name, first, whole, *_) in enumerate(CHROMOSOMES):
        rows += [(2 * i + 1, name, 0, first, name[-1]), (2 * i + 2, name, first, whole - first, name[-1])]
    return spark.createDataFrame(rows, "part int, chromosome string, part_start int, part_len int, subgenome string")


def subgenome(spark: SparkSession, letter: str) -> DataFrame:
    """Chromosomes and parts of a subgenome."""
    return part_info(spark).where(F.col("subgenome") == letter)


def to_chromosome(df: DataFrame) -> DataFrame:
    """Add chromosome and chrom_pos to rows (part, pos); rows of unknown parts are dropped."""
    info = F.broadcast(part_info(df.sparkSession).select("part", "chromosome", "part_start"))
    return df.join(info, "part").withColumn("chrom_pos", F.col("pos") + F.col("part_start")).drop("part_start")


def to_part(df: DataFrame) -> DataFrame:
    """Add part and part_pos to rows (chromosome, chrom_pos): positions over the first part's length are in the second."""
    info = part_info(df.sparkSession).groupBy("chromosome").agg(F.min("part").alias("__p"), F.max("part_start").alias("__cut"))
    second = F.col("chrom_pos") > F.col("__cut")
    return (
        df.join(F.broadcast(info), "chromosome")
        .withColumn("part", F.col("__p") + second.cast("int"))
        .withColumn("part_pos", F.when(second, F.col("chrom_pos") - F.col("__cut")).otherwise(F.col("chrom_pos")))
        .drop("__p", "__cut")
    )
