"""Queries over the fixtures for alignments, GBS tags, plain tables and helpers, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import alignments as al
from seqloom.operators import gbs, tables
from seqloom.plans.fixtures import Build, Tables, duckdb
from seqloom.plans.session import scratch_path, write_table
from seqloom.sources import tables as sheets

Entry = tuple[Build, str | None]

_LEN = "COALESCE(CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[{}]', 1), lambda x: CAST(x AS BIGINT))) AS INT), 0)"
_END = f"CASE WHEN cigar <> '*' THEN start_pos + {_LEN.format('MDN=X')} END"
_MAPPED = "cigar <> '*'"
_PERFECT = "COALESCE(regexp_full_match(cigar, '\\d+M.*') AND mapq >= 25, false)"


def _aligned(t: Tables) -> DataFrame:
    return al.cigar_match(al.cigar_end(t("alignments")))


def _perfect(t: Tables) -> DataFrame:
    return t("alignments").withColumn("perfect", F.coalesce(F.col("cigar").rlike(r"^\d+M") & (F.col("mapq") >= 25), F.lit(False)))


def _edits(t: Tables) -> DataFrame:
    tagged = t("alignments").withColumn("tags", F.array(F.lit("AS:i:7"), F.concat(F.lit("NM:i:"), F.col("mapq") % 6)))
    return al.edit_columns(tagged).select("query", "ln", "edit", "edit_ratio")


def _pairs(t: Tables) -> DataFrame:
    return al.pair_alignments(_aligned(t))


def _edited_pairs(t: Tables) -> DataFrame:
    rows = al.edit_columns(_aligned(t).withColumn("tags", F.array(F.concat(F.lit("NM:i:"), F.col("mapq") % 6))))
    return al.pair_alignments(rows, ("chrom", "start_pos", "end_pos", "mapq", "strand", "edit", "match"))


_PAIRS = f"""rec AS (SELECT query, (flag & 64) <> 0 AS first, chrom, start_pos, {_END} AS end_pos, mapq, CASE WHEN (flag & 16) <> 0 THEN 0 ELSE 1 END AS strand, cigar FROM alignments WHERE (flag & 2048) = 0 AND (flag & 256) = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY chrom, start_pos, end_pos, mapq, strand) AS k FROM rec WHERE first AND {_MAPPED}) x WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY chrom, start_pos, end_pos, mapq, strand) AS k FROM rec WHERE NOT first AND {_MAPPED}) x WHERE k = 1),
pairs AS (SELECT q.query, f.chrom AS chrom_f, f.start_pos AS start_pos_f, f.end_pos AS end_pos_f, f.mapq AS mapq_f, f.strand AS strand_f, b.chrom AS chrom_b, b.start_pos AS start_pos_b, b.end_pos AS end_pos_b, b.mapq AS mapq_b, b.strand AS strand_b
  FROM (SELECT DISTINCT query FROM rec) q LEFT JOIN f ON f.query = q.query LEFT JOIN b ON b.query = q.query)"""
_INSERT = "CASE WHEN chrom_f = chrom_b THEN CASE WHEN start_pos_f <= start_pos_b THEN end_pos_b - start_pos_f ELSE end_pos_f - start_pos_b END END"
_FRAGMENT = """CASE WHEN chrom_f = chrom_b AND strand_f <> strand_b THEN CASE WHEN strand_f = 1 THEN CASE WHEN start_pos_f > end_pos_b - 1 THEN -1 ELSE end_pos_b - start_pos_f END
  ELSE CASE WHEN end_pos_f - 1 < start_pos_b THEN -1 ELSE end_pos_f - start_pos_b END END ELSE -1 END"""


def _pair_sql(select: str) -> str:
    return duckdb(f"WITH {_PAIRS} {select}", "alignments")


def _near_pairs(t: Tables) -> DataFrame:
    """Pairs of the fixture with a taxon, on chromosomes cut to three, so that many mates share one."""
    pairs = _pairs(t).withColumns({f"chrom_{m}": F.col(f"chrom_{m}") % 3 + 10 for m in "fb"})
    return pairs.withColumn("taxon", F.concat(F.lit("T"), F.length("query")))


L: dict[str, Entry] = {
    "L1": (lambda t: al.flag_columns(t("alignments")).select("query", "ln", *[f"is_{n}" for n in al.FLAG_BITS]), duckdb("SELECT query, ln, " + ", ".join(f"(flag & {1 << b}) <> 0 AS is_{n}" for n, b in al.FLAG_BITS.items()) + " FROM alignments", "alignments")),
    "L2": (lambda t: al.cigar_end(t("alignments")).select("query", "ln", "end_pos"), duckdb(f"SELECT query, ln, {_END} AS end_pos FROM alignments", "alignments")),
    "L3": (lambda t: _aligned(t).select("query", "ln", "match", "align_len", "strand"), duckdb(f"SELECT query, ln, CASE WHEN {_MAPPED} THEN {_LEN.format('M')} END AS match, CASE WHEN {_MAPPED} THEN {_LEN.format('MDN=X')} END AS align_len, CASE WHEN {_MAPPED} THEN CASE WHEN (flag & 16) <> 0 THEN 0 ELSE 1 END END AS strand FROM alignments", "alignments")),
    "L4": (_edits, duckdb(f"SELECT query, ln, mapq % 6 AS edit, CASE WHEN {_MAPPED} THEN round((mapq % 6) / nullif({_LEN.format('M')}, 0), 6) END AS edit_ratio FROM alignments", "alignments")),
    "L5": (lambda t: tables.number_rows(al.sort_by_hit(al.primary(t("alignments")))), duckdb("SELECT *, row_number() OVER (ORDER BY chrom, start_pos, query, flag, mapq, cigar) AS place FROM alignments WHERE (flag & 2048) = 0 AND (flag & 256) = 0", "alignments")),
    "L6": (lambda t: al.queries(t("alignments")).select("query", F.lit(None).cast("int").alias("hit")).union(al.hits(t("alignments")).select(F.lit(None).cast("string"), "chrom")), duckdb(f"SELECT DISTINCT query, CAST(NULL AS INT) AS hit FROM alignments UNION ALL SELECT DISTINCT CAST(NULL AS STRING), chrom FROM alignments WHERE {_MAPPED}", "alignments")),
    "L7": (lambda t: al.count_by_query(t("alignments")), duckdb(f"SELECT query, COUNT(*) FILTER ({_MAPPED}) AS n FROM alignments GROUP BY 1", "alignments")),
    "L7_hits": (lambda t: al.count_by_hit(t("alignments")), duckdb(f"SELECT chrom, COUNT(*) AS n FROM alignments WHERE {_MAPPED} GROUP BY 1", "alignments")),
    "L7_from": (lambda t: al.with_prefix(al.from_position(t("alignments"), 5, 300), "Q1"), duckdb(f"SELECT * FROM alignments WHERE chrom = 5 AND start_pos >= 300 AND {_MAPPED} AND query LIKE 'Q1%'", "alignments")),
    "L8": (lambda t: al.query_classes(_perfect(t)), duckdb(f"SELECT query, n > 0 AS matched, p = 1 AS one_perfect, n = 1 AND p = 1 AS unique_perfect FROM (SELECT query, COUNT(*) FILTER ({_MAPPED}) AS n, COUNT(*) FILTER ({_MAPPED} AND {_PERFECT}) AS p FROM alignments GROUP BY 1) x", "alignments")),
    "L9": (_pairs, _pair_sql("SELECT * FROM pairs")),
    "L10": (lambda t: al.insert_size(_pairs(t)).select("query", "insert_size"), _pair_sql(f"SELECT query, {_INSERT} AS insert_size FROM pairs")),
    "L11": (lambda t: al.fragment_size(_pairs(t)).select("query", "fragment_size"), _pair_sql(f"SELECT query, {_FRAGMENT} AS fragment_size FROM pairs")),
    "L12": (lambda t: al.pair_ratios(_pairs(t)), _pair_sql("SELECT COUNT(*) AS n_pairs, round(AVG(CAST(chrom_f IS NOT NULL AND chrom_b IS NOT NULL AS INT)), 6) AS both, round(AVG(CAST((chrom_f IS NULL) <> (chrom_b IS NULL) AS INT)), 6) AS one, round(AVG(CAST(chrom_f IS NULL AND chrom_b IS NULL AS INT)), 6) AS none FROM pairs")),
    "L12_edit": (lambda t: al.pair_edit_ratios(_edited_pairs(t)), _pair_sql("SELECT query, round(mapq_f % 6 / nullif(mapq_f, 0), 6) AS ratio_f, round(mapq_b % 6 / nullif(mapq_b, 0), 6) AS ratio_b, round((COALESCE(mapq_f % 6, 0) + COALESCE(mapq_b % 6, 0)) / nullif(COALESCE(mapq_f, 0) + COALESCE(mapq_b, 0), 0), 6) AS ratio_both FROM pairs")),
    "L15": (lambda t: al.qc_summary(_near_pairs(t)),
            _pair_sql(f"""SELECT s.taxon, n_pairs, mito, chloro, insert_mode FROM (SELECT 'T' || length(query) AS taxon, COUNT(*) AS n_pairs, round(COUNT(*) FILTER (chrom_f % 3 + 10 = 11) / COUNT(*), 6) AS mito, round(COUNT(*) FILTER (chrom_f % 3 + 10 = 12) / COUNT(*), 6) AS chloro FROM pairs GROUP BY 1) s
            LEFT JOIN (SELECT taxon, size AS insert_mode FROM (SELECT taxon, size, row_number() OVER (PARTITION BY taxon ORDER BY COUNT(*) DESC, size) AS k FROM (SELECT 'T' || length(query) AS taxon, {_INSERT.replace('chrom_f = chrom_b', 'chrom_f % 3 = chrom_b % 3')} AS size FROM pairs WHERE mapq_f >= 30 AND mapq_b >= 30) y WHERE size BETWEEN 0 AND 1000 GROUP BY 1, 2) z WHERE k = 1) m ON m.taxon = s.taxon""")),
}


def _demultiplexed(t: Tables) -> DataFrame:
    return gbs.demultiplex(t("read_pairs").select("read_id", "seq_r1", "seq_r2"), t("barcodes"))


_SIDE = "{e} AS (SELECT read_id, barcode_{e}, list(taxon) AS taxa FROM (SELECT r.read_id, b.barcode_{e}, b.taxon, rank() OVER (PARTITION BY r.read_id ORDER BY length(b.barcode_{e}) DESC) AS k FROM read_pairs r JOIN barcodes b ON starts_with(r.seq_{e}, b.barcode_{e})) x WHERE k = 1 GROUP BY 1, 2)"
_DEMUX = f"{_SIDE.format(e='r1')}, {_SIDE.format(e='r2')}, demux AS (SELECT p.read_id, p.seq_r1, p.seq_r2, list_intersect(r1.taxa, r2.taxa)[1] AS taxon, r1.barcode_r1, r2.barcode_r2 FROM read_pairs p JOIN r1 ON r1.read_id = p.read_id JOIN r2 ON r2.read_id = p.read_id WHERE len(list_intersect(r1.taxa, r2.taxa)) = 1)"
_BODY = "substr(seq_{e}, length(barcode_{e}) + 1)"
_STOP = "least(CASE WHEN strpos({b}, 'GGCC') > 0 THEN strpos({b}, 'GGCC') - 1 ELSE 1000 END, CASE WHEN strpos({b}, 'TGCAG') > 0 THEN strpos({b}, 'TGCAG') - 1 ELSE 1000 END, 96)"
_CUT = "trimmed AS (SELECT *, substr(b1, 1, " + _STOP.format(b="b1") + ") AS tag_r1, substr(b2, 1, " + _STOP.format(b="b2") + f") AS tag_r2 FROM (SELECT *, {_BODY.format(e='r1')} AS b1, {_BODY.format(e='r2')} AS b2 FROM demux) x), good AS (SELECT * FROM trimmed WHERE length(tag_r1) >= 16 AND length(tag_r2) >= 16 AND NOT contains(tag_r1, 'N') AND NOT contains(tag_r2, 'N'))"


def _trimmed(t: Tables) -> DataFrame:
    return gbs.trim_reads(_demultiplexed(t), "GGCC", "TGCAG")


_COLLAPSED = "SELECT tag_r1, tag_r2, MIN(r1_len) AS r1_len, MIN(r2_len) AS r2_len, CAST(SUM(read_count) AS BIGINT) AS read_count FROM tags GROUP BY 1, 2 HAVING SUM(read_count) >= 3"


def _library(t: Tables) -> DataFrame:
    """Tags of the library with the tag's own text as id, as a table, for it is read more than once."""
    return write_table(gbs.collapse_tags(t("tags")).withColumn("id", F.concat("tag_r1", "tag_r2")), "tags-collapsed")


def _mutated(library: DataFrame) -> DataFrame:
    """The library's tags with one base of R1 changed."""
    changed = F.concat(F.substring("tag_r1", 1, 2), F.translate(F.substring("tag_r1", 3, 1), "ACGT", "CGTA"), F.substring("tag_r1", 4, 93))
    return library.withColumn("tag_r1", changed)


_LIB = f"lib AS (SELECT tag_r1 || tag_r2 AS id, * FROM ({_COLLAPSED}) x)"
_MUT = "mut AS (SELECT id, tag_r1[1:2] || translate(tag_r1[3:3], 'ACGT', 'CGTA') || tag_r1[4:96] AS tag_r1, tag_r2, r1_len, r2_len FROM lib)"
_CHUNK = "{n} AS (SELECT DISTINCT id, substr(tag_r1, 9, 6) AS g, substr(tag_r1, CAST(16 * i + 1 AS INT), 16) AS c FROM {f}, LATERAL (SELECT unnest(generate_series(0, 5)) AS i) y WHERE i < r1_len // 16 UNION SELECT DISTINCT id, substr(tag_r1, 9, 6), substr(tag_r2, CAST(16 * i + 1 AS INT), 16) FROM {f}, LATERAL (SELECT unnest(generate_series(0, 5)) AS i) y WHERE i < r2_len // 16)"
_DIFF = " + ".join(f"CAST(m.tag_r{e}[{i}:{i}] <> l.tag_r{e}[{i}:{i}] AS INT)" for e in (1, 2) for i in range(1, 97))
_MATCH = f"""WITH {_LIB}, {_MUT}, {_CHUNK.format(n='qc', f='mut')}, {_CHUNK.format(n='lc', f='lib')},
cand AS (SELECT DISTINCT qc.id AS query_id, lc.id AS library_id FROM qc JOIN lc ON qc.g = lc.g AND qc.c = lc.c),
d AS (SELECT query_id, library_id, CAST({_DIFF} AS INT) AS diff FROM cand JOIN mut m ON m.id = query_id JOIN lib l ON l.id = library_id)"""


def _recorded(library: DataFrame) -> DataFrame:
    """An allele of each library tag: base 20 of R1."""
    return library.select(F.col("id").alias("library_id"), F.lit(1).alias("end"), F.lit(20).alias("read_pos"), F.substring("tag_r1", 20, 1).alias("base"))


def _matched(t: Tables) -> DataFrame:
    library = _library(t)
    return gbs.match_tags(_mutated(library), library)


def _match_chosen(t: Tables) -> DataFrame:
    library = _library(t)
    query = _mutated(library)
    return gbs.choose_match(gbs.match_tags(query, library), query, _recorded(library))


def _tag_snps(t: Tables) -> DataFrame:
    line = t("lineitem")
    return line.select(F.concat(F.lit("Q"), "l_orderkey").alias("query"), (F.col("l_partkey") % 5).cast("int").alias("chrom"), (F.col("l_partkey") * 3).cast("int").alias("pos"), F.lit("A").alias("ref"), F.substring(F.lit("CGTDI"), (F.col("l_linenumber") % 5 + 1).cast("int"), F.lit(1)).alias("alt"))


def _query_counts(t: Tables) -> DataFrame:
    return t("orders").select(F.concat(F.lit("Q"), "o_orderkey").alias("query"), (F.col("o_custkey") % 9 + 1).cast("int").alias("read_count"))


_TAG_SNPS = "tag_snps AS (SELECT 'Q' || l_orderkey AS query, CAST(l_partkey % 5 AS INT) AS chrom, CAST(l_partkey * 3 AS INT) AS pos, 'A' AS ref, substr('CGTDI', CAST(l_linenumber % 5 + 1 AS INT), 1) AS alt FROM lineitem), reads AS (SELECT 'Q' || o_orderkey AS query, CAST(o_custkey % 9 + 1 AS INT) AS read_count FROM orders), cat AS (SELECT chrom, pos, ref, CAST(SUM(read_count) AS BIGINT) AS reads, COUNT(*) AS tags, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alts FROM tag_snps s JOIN reads r ON r.query = s.query GROUP BY 1, 2, 3)"


def _catalogue(t: Tables) -> DataFrame:
    return gbs.snp_counts(_tag_snps(t), _query_counts(t))


def _depths(t: Tables) -> DataFrame:
    """Allele depths of samples from matched tags: each line is a tag of a sample with one allele."""
    line = t("lineitem")
    samples = line.select(F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 16).cast("string"), 2, "0")).alias("sample"), F.concat_ws("_", "l_partkey", "l_linenumber").alias("library_id"), F.col("l_quantity").cast("int").alias("read_count"))
    alleles = line.select("l_partkey", "l_linenumber").distinct().select(F.concat_ws("_", "l_partkey", "l_linenumber").alias("library_id"), (F.col("l_partkey") % 5 + 1).cast("int").alias("chrom"), F.col("l_partkey").cast("int").alias("pos"), F.substring(F.lit("AAAACGT"), F.col("l_linenumber"), F.lit(1)).alias("allele"))
    return gbs.sample_allele_depth(samples, alleles)


def _base_sites(t: Tables) -> DataFrame:
    return t("part").select((F.col("p_partkey") % 5 + 1).cast("int").alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), F.lit("A").alias("ref"))


_DEPTH = "depth AS (SELECT 'S' || lpad(CAST(l_suppkey % 16 AS STRING), 2, '0') AS sample, CAST(l_partkey % 5 + 1 AS INT) AS chrom, CAST(l_partkey AS INT) AS pos, substr('AAAACGT', l_linenumber, 1) AS allele, CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS depth FROM lineitem GROUP BY 1, 2, 3, 4)"
_ALTS = "alts AS (SELECT * FROM (SELECT chrom, pos, allele, row_number() OVER (PARTITION BY chrom, pos ORDER BY SUM(depth) DESC, allele) AS k FROM depth WHERE allele <> 'A' GROUP BY 1, 2, 3) x WHERE k <= 2)"
_COLUMNS = "cells AS (SELECT d.sample, d.chrom, d.pos, CAST(COALESCE(SUM(depth) FILTER (d.allele = 'A'), 0) AS BIGINT) AS r0, CAST(COALESCE(SUM(depth) FILTER (k = 1), 0) AS BIGINT) AS r1, CAST(COALESCE(SUM(depth) FILTER (k = 2), 0) AS BIGINT) AS r2 FROM depth d LEFT JOIN alts a ON a.chrom = d.chrom AND a.pos = d.pos AND a.allele = d.allele WHERE EXISTS (SELECT 1 FROM alts b WHERE b.chrom = d.chrom AND b.pos = d.pos) GROUP BY 1, 2, 3)"


_SITES = "SELECT chrom, pos, CAST(SUM(r0 + r1 + CASE WHEN many > 1 THEN r2 ELSE 0 END) AS BIGINT) AS dp, concat_ws(',', CAST(SUM(r0) AS BIGINT), CAST(SUM(r1) AS BIGINT), CAST(SUM(r2) AS BIGINT)) AS ad, concat_ws(',', COUNT(*) FILTER (r0 > 0), COUNT(*) FILTER (r1 > 0), COUNT(*) FILTER (r2 > 0)) AS ap FROM cells JOIN (SELECT chrom, pos, COUNT(*) AS many FROM alts GROUP BY 1, 2) m USING (chrom, pos) GROUP BY 1, 2"


def _gbs_vcf(t: Tables) -> DataFrame:
    return gbs.gbs_vcf(_depths(t), gbs.site_alleles(_depths(t), _base_sites(t))).drop("samples", "ns")


def _retrieved(t: Tables) -> DataFrame:
    samples = t("tags").groupBy("sample", "tag_r1", "tag_r2", "r1_len", "r2_len").agg(F.sum("read_count").alias("read_count"))
    samples = write_table(samples.withColumn("id", F.concat("tag_r1", "tag_r2")), "tags-of-samples")
    lib = _library(t)
    place = F.translate(F.substring("tag_r1", 1, 9), "ACGT", "1234").cast("int")
    alleles = lib.select(F.col("id").alias("library_id"), F.lit(1).alias("end"), F.lit(20).alias("read_pos"), F.substring("tag_r1", 20, 1).alias("base"), F.lit(1).alias("chrom"), place.alias("pos"), F.substring("tag_r1", 20, 1).alias("allele"))
    catalogue = alleles.select("chrom", "pos").distinct().withColumn("ref", F.lit("A"))
    return gbs.retrieve(samples, lib, alleles, catalogue).select("chrom", "pos", "dp", "ad", "ap")


_SAMPLES = f"{_LIB}, samp AS (SELECT sample, tag_r1, tag_r2, tag_r1 || tag_r2 AS id, r1_len, r2_len, SUM(read_count) AS read_count FROM tags GROUP BY 1, 2, 3, 4, 5, 6), mut AS (SELECT DISTINCT id, tag_r1, tag_r2 FROM samp), {_CHUNK.format(n='qc', f='samp')}, {_CHUNK.format(n='lc', f='lib')}"
_CHOSEN = f"""cand AS (SELECT DISTINCT qc.id AS query_id, lc.id AS library_id FROM qc JOIN lc ON qc.g = lc.g AND qc.c = lc.c),
d AS (SELECT query_id, library_id, CAST({_DIFF} AS INT) AS diff FROM cand JOIN mut m ON m.id = query_id JOIN lib l ON l.id = library_id),
chosen AS (SELECT query_id, MIN(library_id) AS library_id FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY diff) AS k FROM d WHERE diff <= 3) x WHERE k = 1 AND query_id[20:20] = library_id[20:20] GROUP BY 1),
depth AS (SELECT sample, 1 AS chrom, CAST(translate(library_id[1:9], 'ACGT', '1234') AS INT) AS pos, library_id[20:20] AS allele, CAST(SUM(read_count) AS BIGINT) AS depth FROM samp JOIN chosen ON query_id = id GROUP BY 1, 2, 3, 4)"""


B: dict[str, Entry] = {
    "B1": (lambda t: _demultiplexed(t).select("read_id", "taxon", "barcode_r1", "barcode_r2"), duckdb(f"WITH {_DEMUX} SELECT read_id, taxon, barcode_r1, barcode_r2 FROM demux", "read_pairs")),
    "B2": (lambda t: _trimmed(t).select("read_id", "tag_r1", "tag_r2"), duckdb(f"WITH {_DEMUX}, {_CUT} SELECT read_id, tag_r1, tag_r2 FROM good", "read_pairs")),
    "B3": (lambda t: gbs.make_tags(_trimmed(t)).select("read_id", "tag_r1", "tag_r2", "r1_len", "r2_len"), duckdb(f"WITH {_DEMUX}, {_CUT} SELECT read_id, rpad(tag_r1, 96, 'A') AS tag_r1, rpad(tag_r2, 96, 'A') AS tag_r2, CAST(length(tag_r1) AS INT) AS r1_len, CAST(length(tag_r2) AS INT) AS r2_len FROM good", "read_pairs")),
    "B4": (lambda t: gbs.collapse_tags(t("tags")), duckdb(_COLLAPSED.replace("MIN(r1_len) AS r1_len, MIN(r2_len) AS r2_len", "first(r1_len ORDER BY r1_len, r2_len) AS r1_len, first(r2_len ORDER BY r1_len, r2_len) AS r2_len"), "tags")),
    "B5": (lambda t: gbs.tag_totals(gbs.collapse_tags(t("tags"))), duckdb(f"SELECT CAST(SUM(n) AS BIGINT) AS n_tags, CAST(SUM(r) AS BIGINT) AS n_reads, MAX(n) AS largest_group FROM (SELECT substr(tag_r1, 9, 6) AS g, COUNT(*) AS n, SUM(read_count) AS r FROM ({_COLLAPSED}) x GROUP BY 1) y", "tags")),
    "B8": (_catalogue, f"WITH {_TAG_SNPS} SELECT * FROM cat"),
    "B9": (lambda t: gbs.snp_totals(gbs.select_snps(gbs.filter_snps(_catalogue(t), 12), t("part").select((F.col("p_partkey") % 5).cast("int").alias("chrom"), (F.col("p_partkey") * 3).cast("int").alias("pos")))), f"WITH {_TAG_SNPS} SELECT chrom, COUNT(*) AS n_snps, CAST(SUM(reads) AS BIGINT) AS reads FROM cat WHERE reads >= 12 AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 5 = chrom AND p_partkey * 3 = pos) GROUP BY 1"),
    "B11": (lambda t: gbs.select_snps(_tag_snps(t), t("part").where("p_size > 25").select((F.col("p_partkey") % 5).cast("int").alias("chrom"), (F.col("p_partkey") * 3).cast("int").alias("pos"))), f"WITH {_TAG_SNPS} SELECT chrom, pos, query, ref, alt FROM tag_snps WHERE EXISTS (SELECT 1 FROM part WHERE p_size > 25 AND p_partkey % 5 = chrom AND p_partkey * 3 = pos)"),
    "B12": (_matched, duckdb(f"{_MATCH} SELECT query_id, library_id, diff FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY diff) AS k FROM d WHERE diff <= 7) x WHERE k = 1", "tags")),
    "B13": (_match_chosen, duckdb(f"{_MATCH} SELECT query_id, MIN(library_id) AS library_id FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY diff) AS k FROM d WHERE diff <= 7) x JOIN mut m ON m.id = query_id JOIN lib l ON l.id = library_id WHERE k = 1 AND m.tag_r1[20:20] = l.tag_r1[20:20] GROUP BY 1", "tags")),
    "B14": (_depths, f"WITH {_DEPTH} SELECT * FROM depth"),
    "B15": (lambda t: gbs.site_alleles(_depths(t), _base_sites(t)).withColumn("alts", F.array_join("alts", ",")), f"WITH {_DEPTH}, {_ALTS} SELECT chrom, pos, 'A' AS ref, string_agg(allele, ',' ORDER BY k) AS alts FROM alts GROUP BY 1, 2"),
    "B16": (_gbs_vcf, f"WITH {_DEPTH}, {_ALTS}, {_COLUMNS} {_SITES}"),
    "B17": (_retrieved, duckdb(f"WITH {_SAMPLES}, {_CHOSEN}, {_ALTS}, {_COLUMNS} {_SITES}", "tags")),
}


def _text(t: Tables) -> DataFrame:
    """Customers as a table of text columns; one of them holds numbers in some rows only."""
    mixed = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    return t("customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", mixed.alias("mixed"), F.col("c_nationkey").cast("string").alias("nation"))


_TEXT = "SELECT CAST(c_custkey AS STRING) AS id, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS STRING) END AS mixed, CAST(c_nationkey AS STRING) AS nation FROM customer"


def _t3(t: Tables) -> DataFrame:
    df = _text(t)
    more = tables.add_rows(df, df.withColumn("id", F.concat(F.lit("x"), "id")))
    fewer = tables.remove_rows(more, df.where("nation = '7'"), ["id"])
    return tables.replace_cells(fewer, df.where("nation = '5'").withColumn("mixed", F.lit("changed")), ["id"], "mixed")


def _table_files(t: Tables) -> DataFrame:
    """The rows of one nation in a gzipped file, all others in a plain one, read again and sorted."""
    parts = []
    for zipped, keep in ((True, F.col("nation") == "3"), (False, F.col("nation") != "3")):
        path = scratch_path(t.spark, "table")
        sheets.write_table_text(_text(t), path, keep, gzip=zipped)
        parts.append(sheets.read_table(t.spark, path).withColumn("zipped", F.lit(zipped)))
    return tables.number_rows(tables.sort_number(tables.add_rows(*parts), "mixed", "id"))


T: dict[str, Entry] = {
    "T1": (lambda t: _text(t).select("id", tables.typed("mixed", "int").alias("as_int"), tables.typed("mixed", "double").alias("as_double")), f"SELECT id, TRY_CAST(mixed AS INT) AS as_int, TRY_CAST(mixed AS DOUBLE) AS as_double FROM ({_TEXT}) x"),
    "T2": (lambda t: tables.replace_column(tables.remove_column(tables.insert_column(_text(t), 1, "len", F.length("c_name")), "c_name"), "nation", F.concat(F.lit("N"), "nation")), f"SELECT id, CAST(length(c_name) AS INT) AS len, mixed, 'N' || nation AS nation FROM ({_TEXT}) x"),
    "T3": (_t3, f"WITH x AS ({_TEXT}), u AS (SELECT * FROM x UNION ALL SELECT 'x' || id, c_name, mixed, nation FROM x) SELECT id, c_name, CASE WHEN nation = '5' AND NOT starts_with(id, 'x') THEN 'changed' ELSE mixed END AS mixed, nation FROM u WHERE NOT (nation = '7' AND NOT starts_with(id, 'x'))"),
    "T4": (lambda t: tables.number_rows(tables.sort_number(tables.number_rows(tables.sort_text(_text(t), "mixed", "id"), "by_text"), "mixed", "id"), "by_number"), f"SELECT *, row_number() OVER (ORDER BY mixed, id) AS by_text, row_number() OVER (ORDER BY TRY_CAST(mixed AS DOUBLE) NULLS FIRST, id) AS by_number FROM ({_TEXT}) x"),
    "T4_rows": (lambda t: tables.with_row_number(t("customer").select("c_custkey", "c_name"), "c_custkey"), "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS row FROM customer"),
    "S16": (_table_files, f"SELECT *, nation = '3' AS zipped, row_number() OVER (ORDER BY TRY_CAST(mixed AS DOUBLE) NULLS FIRST, id) AS place FROM ({_TEXT}) x"),
}


def _sheet(t: Tables) -> DataFrame:
    bams = F.transform(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 1).cast("int")), lambda i: F.concat_ws("_", F.lit("bam"), F.col("s_suppkey"), i))
    path = scratch_path(t.spark, "sheet")
    t("supplier").select(F.concat_ws("\t", "s_name", F.col("s_acctbal").cast("string"), F.array_join(bams, "\t"))).write.text(path)
    return sheets.read_taxa_map(t.spark, path)


def _libraries(t: Tables) -> DataFrame:
    sheet = t("customer").select(F.col("c_name").alias("sample"), (F.col("c_custkey") % 4).alias("flowcell"), (F.col("c_custkey") % 3).alias("lane"), (F.col("c_nationkey") % 5).alias("library"), F.col("c_nationkey").alias("well"), F.lit("ACGT").alias("barcode_r1"), F.lit("TTGG").alias("barcode_r2"))
    nation = t("nation").select((F.col("n_nationkey") % 4).alias("flowcell"), (F.col("n_nationkey") % 3).alias("lane"), (F.col("n_nationkey") % 5).alias("library"), F.col("n_name").alias("fastq_r1"), F.when(F.col("n_nationkey") % 6 == 0, "NA").otherwise(F.col("n_name")).alias("fastq_r2"))
    return sheets.gbs_samples(sheet, nation)


S: dict[str, Entry] = {
    "S18": (lambda t: sheets.taxa_totals(_sheet(t)), "SELECT COUNT(*) AS n_taxa, CAST(SUM(s_suppkey % 3 + 1) AS BIGINT) AS n_bams FROM supplier"),
    "S18_rows": (lambda t: _sheet(t).select("taxon", "coverage", F.array_join("bams", ";").alias("bams")), "SELECT s_name AS taxon, s_acctbal AS coverage, array_to_string([concat_ws('_', 'bam', s_suppkey, i) for i in generate_series(1, s_suppkey % 3 + 1)], ';') AS bams FROM supplier"),
    "S19": (_libraries, "WITH k AS (SELECT concat_ws('_', n_nationkey % 4, n_nationkey % 3, n_nationkey % 5) AS library_key, n_name AS fastq_r1, CASE WHEN n_nationkey % 6 = 0 THEN 'NA' ELSE n_name END AS fastq_r2 FROM nation) SELECT concat_ws('_', c_name, k.library_key, c_nationkey) AS sample, k.library_key, 'ACGT' AS barcode_r1, 'TTGG' AS barcode_r2, fastq_r1, fastq_r2 FROM customer JOIN k ON k.library_key = concat_ws('_', c_custkey % 4, c_custkey % 3, c_nationkey % 5) WHERE fastq_r1 <> 'NA' AND fastq_r2 <> 'NA'"),
}


def _fields(t: Tables) -> DataFrame:
    joined = F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment")
    parts = tables.fields(joined, "|")
    return t("customer").select(
        "c_custkey", tables.join_fields(parts, [2, 0], "+").alias("picked"), F.size(tables.words(F.concat_ws("  ", "c_name", "c_mktsegment"))).alias("n_words"),
        tables.zero_padded(F.col("c_custkey"), 8).alias("padded"), tables.fixed_lines(F.concat("c_name", "c_mktsegment"), 10).alias("lines"),
    )


_LINES = "rtrim(regexp_replace(c_name || c_mktsegment, '(.{10})', '\\1' || chr(10), 'g'), chr(10))"
U: dict[str, Entry] = {
    "U1": (lambda t: tables.split_parts(t("orders").select("o_orderkey"), 7, "o_orderkey"), "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INT) AS part FROM orders"),
    "U1_sizes": (lambda t: tables.split_sizes(t("orders").select("o_orderkey"), 1000, "o_orderkey"), "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS INT) AS part FROM orders"),
    "U3": (lambda t: tables.rank_values(tables.rank_values(t("events").select("event_id", "user_id", F.floor("value").alias("v")), "user_id", "v", "event_id").withColumnRenamed("place", "up"), "user_id", "v", "event_id", True), "SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS INT) AS up, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id DESC) AS INT) AS place FROM events"),
    "U4": (_fields, f"SELECT c_custkey, c_mktsegment || '+' || c_custkey AS picked, CAST(len(list_filter(regexp_split_to_array(c_name || '  ' || c_mktsegment, '\\s+'), lambda w: w <> '')) AS INT) AS n_words, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, {_LINES} AS lines FROM customer"),
}

ENTRIES = L | B | T | S | U
