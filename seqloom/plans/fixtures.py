"""Genomic tables derived from the given ones by SQL that Spark and DuckDB both run unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SITE = "CAST(p_partkey % 5 + 1 AS INT) AS chrom, CAST(FLOOR(p_partkey / 5.0) * 61 + p_size AS INT) AS pos"
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACG"
TAXON = "'T' || lpad(CAST({} AS STRING), 2, '0')"
GENE = "'G' || lpad(CAST({} AS STRING), 7, '0')"

#: Derived tables; {g} is what DuckDB needs as a fourth argument to replace every match.
TABLES: dict[str, str] = {
    "sites": f"SELECT {SITE}, substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS ref, substr('ACGT', CAST((p_size + 1 + p_partkey % 3) % 4 + 1 AS INT), 1) AS alt FROM part",
    "taxa": f"SELECT {TAXON.format('s_suppkey')} AS taxon, CAST(8 + s_suppkey % 5 AS DOUBLE) AS coverage FROM supplier WHERE s_suppkey < 16",
    "chrom_lengths": "SELECT CAST(n_nationkey + 1 AS INT) AS chrom, 1000000 AS chrom_len FROM nation WHERE n_nationkey < 5",
    "genotypes": f"SELECT taxon, chrom, pos, CASE WHEN g = 10 THEN NULL WHEN g IN (7,8,9) THEN 1 ELSE 0 END AS a1, CASE WHEN g = 10 THEN NULL WHEN g IN (5,6,8,9) THEN 1 ELSE 0 END AS a2 FROM (SELECT {TAXON.format('t.s_suppkey')} AS taxon, {SITE}, (p_partkey * 7 + t.s_suppkey * 13 + p_size * t.s_suppkey) % 11 AS g FROM part CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 16) t) x",
    "depths": f"SELECT {TAXON.format('l_suppkey % 16')} AS taxon, {SITE}, CASE WHEN l_linenumber <= 4 THEN 0 WHEN l_linenumber <= 6 THEN 1 ELSE 2 END AS allele, CAST(SUM(l_quantity) AS INT) AS depth FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2,3,4",
    "symbols": f"SELECT {TAXON.format('l_suppkey % 16')} AS taxon, {SITE}, CAST(CASE WHEN l_linenumber <= 2 THEN -1 WHEN l_linenumber = 3 THEN (p_size + 1) % 6 ELSE p_size % 6 END AS INT) AS code, CAST(CASE WHEN l_linenumber = 3 AND (p_size + 1) % 6 >= 4 THEN 1 + p_partkey % 3 WHEN l_linenumber > 3 AND p_size % 6 >= 4 THEN 1 + (p_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 3 ELSE 0 END AS INT) AS indel_len, CAST(SUM(FLOOR(l_quantity)) AS INT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2,3,4,5",
    "positions": "SELECT CAST(user_id % 5 + 1 AS INT) AS chrom, CAST((event_id * 7919) % 1000000 + 1 AS INT) AS pos, value FROM events",
    "ranges": "SELECT CAST(o_custkey % 5 + 1 AS INT) AS chrom, CAST((o_orderkey * 7) % 100000 + 1 AS INT) AS start_pos, CAST((o_orderkey * 7) % 100000 + 2 + o_custkey % 500 AS INT) AS end_pos, o_totalprice AS value FROM orders",
    "genes": f"SELECT {GENE.format('o_orderkey')} AS gene, CAST(o_custkey % 5 + 1 AS INT) AS chrom, CAST(o_orderkey * 50 % 990000 + 1 AS INT) AS start_pos, CAST(o_orderkey * 50 % 990000 + 1 + 200 + o_custkey % 900 AS INT) AS end_pos, CAST(o_orderkey % 2 AS INT) AS strand FROM orders",
    "transcripts": f"SELECT {GENE.format('o_orderkey')} AS gene, {GENE.format('o_orderkey')} || '.' || CAST(k AS STRING) AS transcript, CAST(o_custkey % 5 + 1 AS INT) AS chrom, CAST(o_orderkey * 50 % 990000 + 1 AS INT) AS start_pos, CAST(o_orderkey * 50 % 990000 + 1 + 100 + (o_custkey * k) % 97 AS INT) AS end_pos, CAST(o_orderkey % 2 AS INT) AS strand FROM orders CROSS JOIN (SELECT r_regionkey + 1 AS k FROM region WHERE r_regionkey < 3) t WHERE k <= 1 + o_orderkey % 3",
    "features": f"SELECT {GENE.format('l_orderkey')} || '.1' AS transcript, CASE WHEN l_linenumber = 1 THEN '5UTR' WHEN l_linenumber = 7 THEN '3UTR' ELSE 'CDS' END AS kind, CAST(o_custkey % 5 + 1 AS INT) AS chrom, CAST(l_orderkey * 50 % 990000 + l_linenumber * 20 AS INT) AS start_pos, CAST(l_orderkey * 50 % 990000 + l_linenumber * 20 + 3 + FLOOR(MAX(l_quantity) / 5) AS INT) AS end_pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_custkey",
    "seqs": f"SELECT doc_id AS seq_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N'{{g}}) AS seq FROM documents",
    "alignments": "SELECT 'Q' || CAST(l_orderkey AS STRING) AS query, CAST(l_linenumber AS INT) AS ln, CAST(l_partkey % 12 + 1 AS INT) AS chrom, CAST(l_suppkey * 100 + l_linenumber * 7 AS INT) AS start_pos, CAST(l_quantity AS INT) AS mapq, CAST(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 64 WHEN l_linenumber = 2 THEN 128 ELSE 2048 END + CASE WHEN l_discount = 0 THEN 4 ELSE 0 END AS INT) AS flag, CASE WHEN l_discount = 0 THEN '*' ELSE CAST(CAST(l_quantity AS INT) AS STRING) || 'M' || CAST(l_linenumber AS STRING) || 'D' || CAST(CAST(ROUND(l_tax * 100) AS INT) + 1 AS STRING) || 'S' END AS cigar FROM lineitem",
    "tags": f"SELECT 'S' || lpad(CAST(l_suppkey % 16 AS STRING), 2, '0') AS sample, rpad(substr(repeat(translate(CAST(l_partkey AS STRING), '0123456789', 'ACGTACGTGT'), 20), 1, CAST(20 + l_partkey % 60 AS INT)), 96, 'A') AS tag_r1, rpad(substr(repeat(translate(CAST(l_partkey * 7 AS STRING), '0123456789', 'TGCATGCACA'), 20), 1, CAST(20 + l_partkey % 50 AS INT)), 96, 'A') AS tag_r2, CAST(20 + l_partkey % 60 AS INT) AS r1_len, CAST(20 + l_partkey % 50 AS INT) AS r2_len, CAST(l_quantity AS INT) AS read_count FROM lineitem",
    "barcodes": f"SELECT {TAXON.format('n_nationkey')} AS taxon, substr('ACGT', CAST(n_nationkey % 4 + 1 AS INT), 1) || substr('ACGT', CAST(FLOOR(n_nationkey / 4.0) % 4 + 1 AS INT), 1) || substr('ACGT', CAST(FLOOR(n_nationkey / 16.0) % 4 + 1 AS INT), 1) || CASE WHEN n_nationkey % 2 = 0 THEN 'CA' ELSE 'C' END AS barcode_r1, substr('TGCA', CAST(n_nationkey % 4 + 1 AS INT), 1) || substr('TGCA', CAST(FLOOR(n_nationkey / 4.0) % 4 + 1 AS INT), 1) || 'GG' AS barcode_r2 FROM nation",
    "read_pairs": "SELECT seq_id AS read_id, b.barcode_r1 || substr(seq, 1, 120) AS seq_r1, b.barcode_r2 || substr(seq, 121, 120) AS seq_r2, translate(substr(seq, 1, 120), 'ACGTN', 'I?5+!') AS qual_r1 FROM seqs s JOIN barcodes b ON CAST(substr(b.taxon, 2) AS INT) = s.seq_id % 25",
}

#: Derived tables that a derived table reads.
NEEDS = {"read_pairs": ("seqs", "barcodes")}
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


#: Bytes of files between which a table is dealt over the cores before anything is derived from it.
DEALT_FROM, DEALT_UPTO = 1 << 18, 1 << 30


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of small files dealt over all cores.

    A row group is read by one task, and a small file is often one row group, so
    that all other cores would wait for what is derived from it. Larger tables have
    row groups enough and stay as they are read.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if DEALT_FROM < size < DEALT_UPTO else df


class Tables:
    """The derived tables over one folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, dealt: bool = True) -> DataFrame:
        """A table; with ``dealt`` false as it is read, for what is shuffled at once and would be moved twice."""
        if name in SOURCES:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return _dealt(table) if dealt else table
        text = TABLES[name].format(g="") if "{g}" in TABLES[name] else TABLES[name]
        inner = {n: self(n, dealt) for n in (*SOURCES, *NEEDS.get(name, ())) if n in text}
        for n in inner:
            text = _named(text, n)
        return self.spark.sql(text, **inner)


def _named(text: str, table: str) -> str:
    """``FROM table`` and ``JOIN table`` as references to a DataFrame of that name."""
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)


def duckdb(select: str, *names: str) -> str:
    """DuckDB SQL of a select over derived tables."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    if not wanted:
        return select
    parts = ", ".join(f"{n} AS ({TABLES[n].format(g=", 'g'") if '{g}' in TABLES[n] else TABLES[n]})" for n in wanted)
    body = select.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"


Build = Callable[[Tables], DataFrame]
