"""Queries over the fixtures for calling, discovery, genotype tables and distances, each with its DuckDB counterpart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import calling, discovery, distance, genotypes
from seqloom.operators.tables import number_rows
from seqloom.plans.fixtures import Build, Tables, duckdb

Entry = tuple[Build, str | None]


def _log(x: float) -> str:
    return f"({math.log10(x)!r}e0)"


_E = calling.ERROR_RATE
_SAME, _MIX, _REST = _log(1 - 0.75 * _E), _log(0.5 - _E / 4), _log(_E / 4)
_LG = "lgamma({}+1)/ln(10e0)"

#: Genotype calls of the depths fixture, in SQL.
CALLS = f"""
raw AS (SELECT taxon, chrom, pos, CAST(SUM(CASE WHEN allele = 0 THEN depth ELSE 0 END) AS BIGINT) r0, CAST(SUM(CASE WHEN allele = 1 THEN depth ELSE 0 END) AS BIGINT) r1,
  CAST(SUM(CASE WHEN allele = 2 THEN depth ELSE 0 END) AS BIGINT) r2 FROM depths GROUP BY 1, 2, 3),
total AS (SELECT *, r0 + r1 + r2 AS d FROM raw),
cut AS (SELECT *, least(d, 150) AS t, CASE WHEN d > 150 THEN CAST(floor(r0 * 150 / d) AS BIGINT) ELSE r0 END AS n0, CASE WHEN d > 150 THEN CAST(floor(r1 * 150 / d) AS BIGINT) ELSE r1 END AS n1,
  CASE WHEN d > 150 THEN CAST(floor(r2 * 150 / d) AS BIGINT) ELSE r2 END AS n2 FROM total),
lik AS (SELECT *, -(n0 * {_SAME} + (t - n0) * {_REST}) AS c00, -(n1 * {_SAME} + (t - n1) * {_REST}) AS c11, -(n2 * {_SAME} + (t - n2) * {_REST}) AS c22,
  -((n0 + n1) * {_MIX} + (t - n0 - n1) * {_REST}) AS c01, -((n0 + n2) * {_MIX} + (t - n0 - n2) * {_REST}) AS c02, -((n1 + n2) * {_MIX} + (t - n1 - n2) * {_REST}) AS c12,
  {_LG.format('t')} - {_LG.format('n0')} - {_LG.format('n1')} - {_LG.format('n2')} AS ways FROM cut),
best AS (SELECT *, least(c00, c01, c02, c11, c12, c22) AS b FROM lik),
calls AS (SELECT taxon, chrom, pos, r0, r1, r2, d,
  CASE WHEN t = 0 THEN NULL WHEN c00 = b OR c01 = b OR c02 = b THEN 0 WHEN c11 = b OR c12 = b THEN 1 ELSE 2 END AS g1,
  CASE WHEN t = 0 THEN NULL WHEN c00 = b THEN 0 WHEN c01 = b THEN 1 WHEN c02 = b THEN 2 WHEN c11 = b THEN 1 WHEN c12 = b THEN 2 ELSE 2 END AS g2,
  concat_ws(',', r0, r1, r2) AS ad,
  concat_ws(',', {', '.join(f"CAST(floor(round({c} - ways, 9) + 0.5) AS BIGINT)" for c in ('c00', 'c01', 'c11', 'c02', 'c12', 'c22'))}) AS gl FROM best)
"""
_GT = "CASE WHEN g1 IS NULL THEN './.' ELSE concat_ws('/', g1, g2) END"


def _calls_sql(select: str, *more: str) -> str:
    return duckdb(f"WITH {CALLS.strip()} {select}", "depths", *more)


def _calls(t: Tables) -> DataFrame:
    return calling.call_genotypes(calling.allele_counts(t("depths")))


def _info_columns(ac: str) -> str:
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    occurs = [f"COUNT(*) FILTER (g1 = {i}) + COUNT(*) FILTER (g2 = {i})" for i in range(3)]
    share = f"({occurs[0]}) / nullif(2.0 * COUNT(g1), 0)"
    return (
        f"CAST(SUM(d) AS BIGINT) AS dp, COUNT(g1) AS nz, concat_ws(',', CAST(SUM(r0) AS BIGINT), CAST(SUM(r1) AS BIGINT), CAST(SUM(r2) AS BIGINT)) AS ad, "
        f"concat_ws(',', {', '.join(occurs[1 if ac == 'alt' else 0:])}) AS ac, concat_ws(',', {', '.join(f'COUNT(*) FILTER (g1 = {i} AND g2 = {j})' for i, j in pairs)}) AS gn, "
        f"COUNT(*) FILTER (g1 <> g2) AS ht, round(least({share}, 1 - {share}), 6) AS maf"
    )


def _symbols_library(t: Tables) -> DataFrame:
    return discovery.build_library(_ing(t))


def _ing(t: Tables) -> DataFrame:
    return discovery.discover_variants(discovery.symbol_sites(t("symbols")), t("taxa").withColumn("coverage", F.col("coverage") * 10))


ING = """
by_code AS (SELECT taxon, chrom, pos, code, CAST(SUM(n) AS BIGINT) AS n, COUNT(DISTINCT indel_len) AS lengths FROM symbols GROUP BY 1, 2, 3, 4),
longest AS (SELECT taxon, chrom, pos, code, indel_len FROM (SELECT *, row_number() OVER (PARTITION BY taxon, chrom, pos, code ORDER BY n DESC, indel_len DESC) AS k FROM symbols) x WHERE k = 1),
site AS (SELECT taxon, chrom, pos, CAST(SUM(n) AS BIGINT) AS depth, SUM(CASE WHEN code >= 4 THEN lengths ELSE 0 END) AS types FROM by_code GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY taxon, chrom, pos ORDER BY n DESC, code DESC) AS k FROM by_code WHERE code >= 0),
ing AS (SELECT s.taxon, s.chrom, s.pos, a.code AS allele, l.indel_len FROM site s JOIN taxa t ON s.taxon = t.taxon JOIN placed a ON a.taxon = s.taxon AND a.chrom = s.chrom AND a.pos = s.pos AND a.k = 1
  JOIN longest l ON l.taxon = s.taxon AND l.chrom = s.chrom AND l.pos = s.pos AND l.code = a.code
  LEFT JOIN placed b ON b.taxon = s.taxon AND b.chrom = s.chrom AND b.pos = s.pos AND b.k = 2
  WHERE depth >= 2 AND depth / (10 * coverage) BETWEEN 0.2 AND 3 AND types <= 1 AND a.n / depth >= 0.35 AND NOT (a.n / depth > 1 - 0.35e0 AND a.n / depth < 0.8) AND COALESCE(b.n / depth <= 0.2, true))
"""
LIBRARY = ING.strip() + """,
taxa_of AS (SELECT chrom, pos, allele, indel_len, COUNT(*) AS taxa FROM ing GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY taxa DESC, allele DESC, indel_len DESC) AS k FROM taxa_of),
library AS (SELECT * FROM ranked WHERE k <= 2 AND taxa >= 2)
"""
_LIB_TEXT = "SELECT chrom, pos, string_agg(substr('ACGTDI', allele + 1, 1), ',' ORDER BY k) AS alts, string_agg(CAST(indel_len AS STRING), ',' ORDER BY k) AS indel_lens FROM library GROUP BY chrom, pos"


def _ing_sql(select: str, *more: str) -> str:
    return duckdb(f"WITH {ING.strip()} {select}", "symbols", "taxa", *more)


def _lib_sql(select: str, *more: str) -> str:
    return duckdb(f"WITH {LIBRARY.strip()} {select}", "symbols", "taxa", *more)


def _scan_text(t: Tables) -> DataFrame:
    return calling.counts_text(calling.scan_counts(_symbols_library(t), t("symbols"), t("taxa")))


_SCAN = """
SELECT taxon, chrom, pos, CASE WHEN MAX(depth) IS NULL THEN '.' ELSE concat_ws(',', CAST(MAX(depth) - SUM(hit) AS BIGINT), string_agg(CAST(hit AS STRING), ',' ORDER BY k)) END AS counts FROM (
  SELECT t.taxon, l.chrom, l.pos, l.k, d.depth, CAST(COALESCE(s.n, 0) AS BIGINT) AS hit FROM library l CROSS JOIN taxa t
  LEFT JOIN (SELECT taxon, chrom, pos, CAST(SUM(n) AS BIGINT) AS depth FROM symbols GROUP BY 1, 2, 3) d ON d.taxon = t.taxon AND d.chrom = l.chrom AND d.pos = l.pos
  LEFT JOIN symbols s ON s.taxon = t.taxon AND s.chrom = l.chrom AND s.pos = l.pos AND s.code = l.allele AND s.indel_len = l.indel_len) x GROUP BY taxon, chrom, pos
"""


def _seq_ing(t: Tables) -> DataFrame:
    return _ing(t).withColumn("indel_seq", F.when(F.col("indel_len") > 0, F.repeat(F.lit("A"), F.col("indel_len") + F.col("chrom") % 2)).otherwise(""))


def _joint(t: Tables) -> DataFrame:
    called = discovery.joint_call(t("symbols"), t("taxa").withColumn("coverage", F.col("coverage") * 10))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return called.select("chrom", "pos", join("alts"), "dp", "nz", join("ad"), join("ap"))


_JOINT = """
WITH by_code AS (SELECT taxon, chrom, pos, code, CAST(SUM(n) AS BIGINT) AS n FROM symbols GROUP BY 1, 2, 3, 4),
cell AS (SELECT *, SUM(n) OVER (PARTITION BY taxon, chrom, pos) AS depth, nth_value(n, 3) OVER (PARTITION BY taxon, chrom, pos ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM by_code),
types AS (SELECT chrom, pos, COUNT(DISTINCT code * 100 + indel_len) AS types FROM symbols WHERE code >= 4 GROUP BY 1, 2),
alleles AS (SELECT chrom, pos, code, CAST(SUM(n) AS BIGINT) AS ad, COUNT(*) AS ap, bool_or(depth / (10 * coverage) BETWEEN 0.2 AND 3 AND n / depth > 0.4) AS good, MAX(COALESCE(third, 0) / depth) AS third
  FROM cell c JOIN taxa t ON c.taxon = t.taxon GROUP BY 1, 2, 3),
site AS (SELECT chrom, pos, CAST(SUM(depth) AS BIGINT) AS dp, COUNT(*) AS nz FROM (SELECT DISTINCT taxon, chrom, pos, depth FROM cell) x GROUP BY 1, 2),
alts AS (SELECT chrom, pos, COUNT(*) AS k, string_agg(CAST(code AS STRING), ',' ORDER BY ad DESC, code DESC) AS alts, string_agg(CAST(ad AS STRING), ',' ORDER BY ad DESC, code DESC) AS ad,
  string_agg(CAST(ap AS STRING), ',' ORDER BY ad DESC, code DESC) AS ap FROM alleles WHERE code >= 0 AND good GROUP BY 1, 2),
worst AS (SELECT chrom, pos, MAX(third) AS third FROM alleles GROUP BY 1, 2),
present AS (SELECT chrom, pos, ap, row_number() OVER (PARTITION BY chrom, pos ORDER BY ap DESC) AS k FROM (SELECT chrom, pos, ap FROM alleles WHERE (code >= 0 AND good) UNION ALL
  SELECT s.chrom, s.pos, COALESCE(a.ap, 0) FROM site s LEFT JOIN alleles a ON a.chrom = s.chrom AND a.pos = s.pos AND a.code = -1) y),
second AS (SELECT chrom, pos, ap AS second FROM present WHERE k = 2)
SELECT a.chrom, a.pos, a.alts, s.dp, s.nz, a.ad, a.ap FROM alts a JOIN site s ON a.chrom = s.chrom AND a.pos = s.pos JOIN worst w ON w.chrom = a.chrom AND w.pos = a.pos
JOIN second p ON p.chrom = a.chrom AND p.pos = a.pos LEFT JOIN types y ON y.chrom = a.chrom AND y.pos = a.pos
WHERE COALESCE(y.types, 0) <= 1 AND (a.k < 2 OR w.third <= 0.2) AND p.second >= 2
"""


def _pileup(t: Tables) -> DataFrame:
    """Two BAMs a taxon and site, from lineitem: bases of a letter for each line."""
    line = t("lineitem")
    bases = F.repeat(F.substring(F.lit("ACGT.,*"), F.col("l_linenumber"), F.lit(1)), F.col("l_linenumber"))
    return line.select(
        F.concat(F.lit("T"), F.lpad((F.col("l_suppkey") % 16).cast("string"), 2, "0")).alias("taxon"), (F.col("l_partkey") % 5 + 1).cast("int").alias("chrom"),
        F.col("l_partkey").cast("int").alias("pos"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("bam_no"), F.lit("A").alias("ref"), F.col("l_linenumber").alias("depth"), bases.alias("bases"),
    )


_V2 = """
SELECT 'T' || lpad(CAST(l_suppkey % 16 AS STRING), 2, '0') AS taxon, CAST(l_partkey % 5 + 1 AS INT) AS chrom, CAST(l_partkey AS INT) AS pos, CAST(SUM(l_linenumber) AS BIGINT) AS depth,
  string_agg(repeat(substr('ACGT.,*', l_linenumber, 1), l_linenumber), '' ORDER BY l_orderkey || ':' || l_linenumber) AS bases FROM lineitem GROUP BY 1, 2, 3
"""


def _hap_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Alleles of the sites, and counts by code from symbols with code -1 as reference."""
    counts = [F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0)).cast("int") for c in range(6)]
    pile = t("symbols").groupBy("taxon", "chrom", "pos").agg(F.coalesce(F.sum(F.when(F.col("code") == -1, F.col("n"))), F.lit(0)).cast("int").alias("ref_n"), F.array(*counts).alias("counts"))
    return t("sites").select("chrom", "pos", "ref", F.array("alt", F.lit("D")).alias("alts")), pile


_HAP = """
SELECT t.taxon, s.chrom, s.pos, CASE WHEN COUNT(y.n) = 0 THEN '.' ELSE concat_ws(',', greatest(CAST(COALESCE(SUM(n) FILTER (code = -1), 0) - COALESCE(SUM(n) FILTER (code IN (4, 5)), 0) AS BIGINT), 0),
  CAST(COALESCE(SUM(n) FILTER (code >= 0 AND substr('ACGTDI', code + 1, 1) = alt), 0) AS BIGINT), CAST(COALESCE(SUM(n) FILTER (code = 4), 0) AS BIGINT)) END AS counts
FROM sites s CROSS JOIN taxa t LEFT JOIN symbols y ON y.taxon = t.taxon AND y.chrom = s.chrom AND y.pos = s.pos GROUP BY t.taxon, s.chrom, s.pos, s.alt
"""

V: dict[str, Entry] = {
    "V2": (lambda t: discovery.merge_bams(_pileup(t)).drop("ref"), _V2),
    "V3": (_ing, _ing_sql("SELECT taxon, chrom, pos, allele, indel_len FROM ing")),
    "V4": (lambda t: _symbols_library(t).select("chrom", "pos", F.array_join(F.transform("alts", lambda a: F.concat_ws(":", a["allele"], a["indel_len"], a["taxa"])), ",").alias("alts")),
           _lib_sql("SELECT chrom, pos, string_agg(concat_ws(':', allele, indel_len, taxa), ',' ORDER BY k) AS alts FROM library GROUP BY chrom, pos")),
    "V5": (lambda t: discovery.build_library(_seq_ing(t), by_seq=True).select("chrom", "pos", F.array_join(F.transform("alts", lambda a: F.concat_ws(":", a["allele"], a["indel_seq"], a["taxa"])), ",").alias("alts")),
           _ing_sql("SELECT chrom, pos, string_agg(concat_ws(':', allele, indel_seq, taxa), ',' ORDER BY k) AS alts FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY taxa DESC, indel_len DESC, allele DESC, indel_seq) AS k FROM (SELECT chrom, pos, allele, indel_len, CASE WHEN indel_len > 0 THEN repeat('A', indel_len + chrom % 2) ELSE '' END AS indel_seq, COUNT(*) AS taxa FROM ing GROUP BY 1, 2, 3, 4, 5) x) y WHERE k <= 2 AND taxa >= 2 GROUP BY chrom, pos")),
    "V6": (lambda t: number_rows(discovery.merge_libraries(discovery.library_text(_symbols_library(t).where("chrom > 2")), discovery.library_text(_symbols_library(t).where("chrom <= 2")))), _lib_sql(f"SELECT *, row_number() OVER (ORDER BY chrom, pos) AS place FROM ({_LIB_TEXT}) z")),
    "V7": (lambda t: _customized(t), _lib_sql("SELECT p.chrom, p.pos, l.chrom IS NULL AS missing FROM (SELECT DISTINCT chrom, pos FROM sites) p LEFT JOIN (SELECT DISTINCT chrom, pos FROM library) l ON p.chrom = l.chrom AND p.pos = l.pos", "sites")),
    "V8": (lambda t: discovery.library_text(_symbols_library(t)), _lib_sql(_LIB_TEXT)),
    "V9": (lambda t: discovery.slice_region(t("symbols"), "2:100,9000"), duckdb("SELECT * FROM symbols WHERE chrom = 2 AND pos BETWEEN 100 AND 9000", "symbols")),
    "V10": (lambda t: discovery.with_bin(t("positions"), 1, 50_000).groupBy("chrom", "bin").agg(F.count("*").alias("n")), duckdb("SELECT chrom, CAST(floor((pos - 1) / 50000) AS INT) AS bin, COUNT(*) AS n FROM positions GROUP BY 1, 2", "positions")),
    "V11": (_joint, duckdb(_JOINT, "symbols", "taxa")),
    "V12": (_scan_text, _lib_sql(_SCAN)),
    "V13": (lambda t: _calls(t).select("taxon", "chrom", "pos", "gt", F.array_join("ad", ",").alias("ad"), F.array_join("gl", ",").alias("gl")), _calls_sql(f"SELECT taxon, chrom, pos, {_GT} AS gt, ad, CASE WHEN g1 IS NOT NULL THEN gl END AS gl FROM calls")),
    "V14": (lambda t: calling.site_info(_calls(t)), _calls_sql(f"SELECT chrom, pos, {_info_columns('all')} FROM calls GROUP BY chrom, pos")),
    "V15": (lambda t: calling.vcf_rows(t("sites").select("chrom", "pos", "ref", F.array("alt").alias("alts")), calling.site_info(_calls(t)), _calls(t)).select("chrom", "pos", "id", "ref", "alt", "format", "samples"),
            _calls_sql(f"SELECT s.chrom, s.pos, s.chrom || '-' || s.pos AS id, ref, alt, 'GT:AD:GL' AS format, string_agg(CASE WHEN g1 IS NULL THEN './.' ELSE {_GT} || ':' || c.ad || ':' || gl END, chr(9) ORDER BY taxon) AS samples FROM sites s JOIN calls c ON s.chrom = c.chrom AND s.pos = c.pos GROUP BY s.chrom, s.pos, ref, alt", "sites")),
    "V16": (lambda t: calling.counts_text(calling.hap_scan(*_hap_inputs(t), t("taxa"))), duckdb(_HAP, "symbols", "taxa", "sites")),
    "V17": (lambda t: calling.site_info(_calls(t), alt_only_ac=True), _calls_sql(f"SELECT chrom, pos, {_info_columns('alt')} FROM calls GROUP BY chrom, pos")),
    "V18": (lambda t: discovery.ing_text(_ing(t)), _ing_sql("SELECT taxon, chrom, pos, concat_ws(chr(9), pos, substr('ACGTDI', allele + 1, 1), indel_len) AS line FROM ing")),
    "V19": (lambda t: calling.counts_text(calling.allele_counts(t("depths"))), _calls_sql("SELECT taxon, chrom, pos, ad AS counts FROM calls")),
}


def _customized(t: Tables) -> DataFrame:
    kept, missing = discovery.customize_library(_symbols_library(t), t("sites"))
    return kept.select("chrom", "pos", F.lit(False).alias("missing")).union(missing.select("chrom", "pos", F.lit(True)))


_CELL = "COUNT(*) FILTER (a1 IS NULL) AS missing, COUNT(a1) AS called, COUNT(*) FILTER (a1 <> a2) AS het, COUNT(*) FILTER (a1 = a2) AS hom, round(COUNT(*) FILTER (a1 <> a2) / nullif(COUNT(a1), 0), 6) AS het_prop"
_CODE = "strpos('ACGTDI', {}) - 1"
_PATCH = "SELECT taxon, chrom, pos, 1 AS a1, CASE WHEN pos % 2 = 0 THEN 1 END AS a2 FROM genotypes WHERE taxon = 'T03'"


def _patch(t: Tables) -> DataFrame:
    return t("genotypes").where("taxon = 'T03'").select("taxon", "chrom", "pos", F.lit(1).alias("a1"), F.when(F.col("pos") % 2 == 0, 1).alias("a2"))


def _roles(t: Tables) -> DataFrame:
    freq = genotypes.allele_freq(t("genotypes"), t("sites")).join(t("sites"), ["chrom", "pos"])
    marked = genotypes.with_roles(freq, {"alternative": F.lit(True), "minor": F.col("alt_freq") < 0.5, "major": F.col("alt_freq") >= 0.5, "ancestral": F.col("alt") == "A", "derived": F.col("alt") != "A"})
    return marked.select("chrom", "pos", "roles", genotypes.has_role("minor").alias("is_minor"))


_DX = "(x.a1 + x.a2)", "(y.a1 + y.a2)"
_DIST = {"grid": "({0} * (2 - {1}) + {1} * (2 - {0})) / 4.0".format(*_DX), "rows": "abs({0} - {1}) / 2.0".format(*_DX)}
_BOTH = "FROM genotypes x JOIN genotypes y ON x.chrom = y.chrom AND x.pos = y.pos AND x.a1 IS NOT NULL AND y.a1 IS NOT NULL"


def _matrix_sql(kind: str, sites: str = "") -> str:
    return f"SELECT x.taxon AS taxon1, y.taxon AS taxon2, COUNT(*) AS n, CASE WHEN x.taxon = y.taxon THEN 0.0 ELSE round(AVG({_DIST[kind]}), 6) END AS dxy {_BOTH} {sites} GROUP BY 1, 2"


_QUICK = """WITH s AS (SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS idx, COUNT(*) OVER () AS n FROM (SELECT DISTINCT chrom, pos FROM genotypes) z),
chosen AS (SELECT chrom, pos FROM s WHERE idx % greatest(1, n // 10000) = 0 AND idx / greatest(1, n // 10000) < 10000) """

G: dict[str, Entry] = {
    "G1": (lambda t: genotypes.classify(t("genotypes")).groupBy("taxon").agg(*[F.count_if(c).alias(c) for c in ("missing", "het", "hom", "phase1_alt", "phase2_alt", "phase1_ref", "phase2_ref")]),
           duckdb("SELECT taxon, COUNT(*) FILTER (a1 IS NULL) AS missing, COUNT(*) FILTER (a1 <> a2) AS het, COUNT(*) FILTER (a1 = a2) AS hom, COUNT(*) FILTER (a1 = 1) AS phase1_alt, COUNT(*) FILTER (a2 = 1) AS phase2_alt, COUNT(*) FILTER (a1 = 0) AS phase1_ref, COUNT(*) FILTER (a2 = 0) AS phase2_ref FROM genotypes GROUP BY taxon", "genotypes")),
    "G2": (lambda t: genotypes.genotype_bases(t("genotypes"), t("sites")).select("taxon", "chrom", "pos", "bases", "code"),
           duckdb(f"SELECT taxon, g.chrom, g.pos, CASE WHEN a1 IS NULL THEN 'NN' ELSE CASE a1 WHEN 1 THEN alt ELSE ref END || CASE a2 WHEN 1 THEN alt ELSE ref END END AS bases, CAST(CASE WHEN a1 IS NULL THEN -1 ELSE ({_CODE.format('CASE a1 WHEN 1 THEN alt ELSE ref END')}) * 16 + {_CODE.format('CASE a2 WHEN 1 THEN alt ELSE ref END')} END AS INT) AS code FROM genotypes g JOIN sites s ON g.chrom = s.chrom AND g.pos = s.pos", "genotypes", "sites")),
    "G3": (lambda t: genotypes.site_stats(t("genotypes")).select("chrom", "pos", "missing", "called"), duckdb("SELECT chrom, pos, COUNT(*) FILTER (a1 IS NULL) AS missing, COUNT(a1) AS called FROM genotypes GROUP BY 1, 2", "genotypes")),
    "G4": (lambda t: genotypes.site_stats(t("genotypes")).select("chrom", "pos", "het", "hom", "het_prop"), duckdb(f"SELECT chrom, pos, het, hom, het_prop FROM (SELECT chrom, pos, {_CELL} FROM genotypes GROUP BY 1, 2) x", "genotypes")),
    "G5": (lambda t: genotypes.site_stats(t("genotypes")).select("chrom", "pos", "alt_alleles", "alt_taxa"), duckdb("SELECT chrom, pos, CAST(COALESCE(SUM(a1 + a2), 0) AS BIGINT) AS alt_alleles, COUNT(*) FILTER (a1 + a2 > 0) AS alt_taxa FROM genotypes GROUP BY 1, 2", "genotypes")),
    "G6": (lambda t: genotypes.taxon_stats(t("genotypes")), duckdb(f"SELECT taxon, {_CELL} FROM genotypes GROUP BY 1", "genotypes")),
    "G7": (lambda t: genotypes.allele_freq(t("genotypes"), t("sites")),
           duckdb("SELECT s.chrom, s.pos, round(f, 6) AS alt_freq, round(1 - f, 6) AS ref_freq, round(least(f, 1 - f), 6) AS maf, round(1 - least(f, 1 - f), 6) AS major_freq, CASE WHEN f < 0.5 THEN alt WHEN f >= 0.5 THEN ref END AS minor_base, CASE WHEN f < 0.5 THEN ref WHEN f >= 0.5 THEN alt END AS major_base FROM sites s JOIN (SELECT chrom, pos, SUM(a1 + a2) / nullif(2.0 * COUNT(a1), 0) AS f FROM genotypes GROUP BY 1, 2) q ON s.chrom = q.chrom AND s.pos = q.pos", "genotypes", "sites")),
    "G8": (_roles, duckdb("SELECT s.chrom, s.pos, CAST(2 + CASE WHEN f < 0.5 THEN 16 WHEN f >= 0.5 THEN 8 ELSE 0 END + CASE WHEN alt = 'A' THEN 64 ELSE 128 END AS INT) AS roles, COALESCE(f < 0.5, false) AS is_minor FROM sites s JOIN (SELECT chrom, pos, round(SUM(a1 + a2) / nullif(2.0 * COUNT(a1), 0), 6) AS f FROM genotypes GROUP BY 1, 2) q ON s.chrom = q.chrom AND s.pos = q.pos", "genotypes", "sites")),
    "G9": (lambda t: genotypes.site_stats_ad(_calls(t)),
           _calls_sql("SELECT chrom, pos, COUNT(*) FILTER (g1 IS NULL) AS missing, COUNT(g1) AS called, concat_ws(',', CAST(SUM(r0) AS BIGINT), CAST(SUM(r1) AS BIGINT), CAST(SUM(r2) AS BIGINT)) AS allele_depth, CAST(SUM(d) AS BIGINT) AS depth, concat_ws(',', COUNT(*) FILTER (r0 > 0), COUNT(*) FILTER (r1 > 0), COUNT(*) FILTER (r2 > 0)) AS presence, concat_ws(',', COUNT(*) FILTER (g1 = 0 AND g2 = 0), COUNT(*) FILTER (g1 = 0 AND g2 = 1), COUNT(*) FILTER (g1 = 0 AND g2 = 2), COUNT(*) FILTER (g1 = 1 AND g2 = 1), COUNT(*) FILTER (g1 = 1 AND g2 = 2), COUNT(*) FILTER (g1 = 2 AND g2 = 2)) AS genotypes, COUNT(*) FILTER (g1 <> g2) AS het, round(least((COUNT(*) FILTER (g1 = 1) + COUNT(*) FILTER (g2 = 1)) / nullif(2.0 * COUNT(g1), 0), 1 - (COUNT(*) FILTER (g1 = 1) + COUNT(*) FILTER (g2 = 1)) / nullif(2.0 * COUNT(g1), 0)), 6) AS maf FROM calls GROUP BY chrom, pos")),
    "G10": (lambda t: calling.site_info(calling.call_genotypes(_calls(t).select("taxon", "chrom", "pos", F.col("ad").alias("counts")))), _calls_sql(f"SELECT chrom, pos, {_info_columns('all')} FROM calls GROUP BY chrom, pos")),
    "G11": (lambda t: genotypes.drop_taxa(genotypes.override(t("genotypes"), _patch(t)), t("taxa").where("taxon = 'T05'")),
            duckdb(f"SELECT g.taxon, g.chrom, g.pos, CASE WHEN p.taxon IS NOT NULL THEN p.a1 ELSE g.a1 END AS a1, CASE WHEN p.taxon IS NOT NULL THEN p.a2 ELSE g.a2 END AS a2 FROM genotypes g LEFT JOIN ({_PATCH}) p ON g.taxon = p.taxon AND g.chrom = p.chrom AND g.pos = p.pos WHERE g.taxon <> 'T05'", "genotypes")),
    "G12": (lambda t: genotypes.subset_taxa(genotypes.subset_sites(t("genotypes"), t("sites").where("ref = 'A'")), t("taxa").where("coverage > 9")), duckdb("SELECT g.* FROM genotypes g WHERE EXISTS (SELECT 1 FROM sites s WHERE s.chrom = g.chrom AND s.pos = g.pos AND ref = 'A') AND taxon IN (SELECT taxon FROM taxa WHERE coverage > 9)", "genotypes", "sites", "taxa")),
    "G13": (lambda t: genotypes.merge_by_site(t("genotypes").where("chrom <= 2"), t("genotypes").where("chrom > 2")), duckdb("SELECT * FROM genotypes", "genotypes")),
    "G14": (lambda t: genotypes.merge_by_taxon(t("genotypes").where("taxon < 'T04'"), t("genotypes").where("taxon >= 'T04'")), duckdb("SELECT * FROM genotypes", "genotypes")),
    "G15": (lambda t: genotypes.with_site_index(genotypes.sort_sites(t("sites"))).select("chrom", "pos", F.col("idx").cast("bigint").alias("idx")), duckdb("SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS idx FROM sites", "sites")),
    "G15_taxa": (lambda t: number_rows(genotypes.sort_taxa(t("genotypes"))), duckdb("SELECT *, row_number() OVER (ORDER BY taxon, chrom, pos, a1 NULLS FIRST, a2 NULLS FIRST) AS place FROM genotypes", "genotypes")),
    "G16": (lambda t: genotypes.chrom_bounds(t("sites")), duckdb("SELECT chrom, CAST(SUM(n) OVER (ORDER BY chrom) - n AS BIGINT) AS start_idx, CAST(SUM(n) OVER (ORDER BY chrom) AS BIGINT) AS end_idx, n AS n_sites FROM (SELECT chrom, COUNT(*) AS n FROM sites GROUP BY 1) x", "sites")),
    "G17": (lambda t: distance.ibs(t("genotypes"), "T01", "T02"), duckdb(f"SELECT x.taxon AS taxon1, y.taxon AS taxon2, COUNT(*) AS n, round(AVG({_DIST['grid']}), 6) AS dxy {_BOTH} WHERE x.taxon = 'T01' AND y.taxon = 'T02' GROUP BY 1, 2", "genotypes")),
    "G18": (lambda t: distance.ibs(t("genotypes"), "T01", "T02", t("sites").where("chrom = 2"), "rows"), duckdb(f"SELECT x.taxon AS taxon1, y.taxon AS taxon2, COUNT(*) AS n, round(AVG({_DIST['rows']}), 6) AS dxy {_BOTH} WHERE x.taxon = 'T01' AND y.taxon = 'T02' AND x.chrom = 2 GROUP BY 1, 2", "genotypes")),
    "G19": (lambda t: distance.ibs_matrix(t("genotypes")), duckdb(_matrix_sql("grid"), "genotypes")),
    "G19_rows": (lambda t: distance.ibs_matrix(t("genotypes"), "rows"), duckdb(_matrix_sql("rows"), "genotypes")),
    "G19_sites": (lambda t: distance.ibs_matrix(t("genotypes"), sites=t("sites").where("chrom = 2 AND pos > 500")), duckdb(_matrix_sql("grid", "AND x.chrom = 2 AND x.pos > 500 AND EXISTS (SELECT 1 FROM sites s WHERE s.chrom = x.chrom AND s.pos = x.pos)"), "genotypes", "sites")),
    "G20": (lambda t: distance.ibs_matrix(t("genotypes"), "rows", max_sites=10_000), duckdb(_QUICK + _matrix_sql("rows", "JOIN chosen c ON c.chrom = x.chrom AND c.pos = x.pos"), "genotypes")),
    "G21": (lambda t: distance.divergence_table(distance.ibs_matrix(t("genotypes"))), duckdb(f"SELECT taxon1 AS \"Dxy\", string_agg(printf('%.3f', dxy), chr(9) ORDER BY taxon2) AS distances FROM ({_matrix_sql('grid')}) m GROUP BY 1", "genotypes")),
    "G22": (lambda t: genotypes.polarise(t("genotypes"), t("sites"), t("sites").select("chrom", "pos", F.when(F.col("pos") % 3 == 0, F.col("alt")).when(F.col("pos") % 3 == 1, F.col("ref")).otherwise("N").alias("anc")), t("taxa").select("taxon", F.concat(F.lit("P"), F.substring("taxon", 3, 1).cast("int") % 3).alias("pop"))).groupBy("pop", "chrom", "pos").agg(F.sum("derived").alias("derived"), F.count("derived").alias("called")),
            duckdb("SELECT 'P' || CAST(substr(taxon, 3, 1) AS INT) % 3 AS pop, g.chrom, g.pos, CAST(SUM(CASE WHEN g.pos % 3 = 1 THEN a1 + a2 ELSE 2 - a1 - a2 END) AS BIGINT) AS derived, COUNT(a1) AS called FROM genotypes g JOIN sites s ON g.chrom = s.chrom AND g.pos = s.pos WHERE g.pos % 3 < 2 GROUP BY 1, 2, 3", "genotypes", "sites")),
}

ENTRIES = V | G
