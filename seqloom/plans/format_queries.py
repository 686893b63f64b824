"""Queries that write the fixtures in a text format and read them back, and those that walk made reads, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import alignments as al
from seqloom.operators import calling, discovery, distance, gbs, genes
from seqloom.operators import tables as plain
from seqloom.plans import variant_queries
from seqloom.plans.fixtures import Build, Tables, duckdb
from seqloom.plans.session import drop_path, scratch_path
from seqloom.sources import reads, tables, vcf

Entry = tuple[Build, str | None]


def _lines(t: Tables, lines: DataFrame, what: str) -> str:
    """Path of text lines written to the shared folder."""
    path = scratch_path(t.spark, what)
    lines.select("value").write.text(path)
    return path


def _tabs(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *columns)


def _vcf(t: Tables) -> str:
    path = scratch_path(t.spark, "vcf")
    vcf.write_vcf(t("sites"), t("genotypes"), path)
    return path


def _vcf_ad(t: Tables) -> DataFrame:
    calls = calling.call_genotypes(calling.allele_counts(t("depths")))
    taxa = sorted(r[0] for r in t("taxa").select("taxon").collect())
    every = t("sites").select("chrom", "pos").crossJoin(F.broadcast(t("taxa").select("taxon"))).join(calls, ["taxon", "chrom", "pos"], "left")
    info = calling.site_info(calls)
    body = calling.vcf_rows(t("sites").select("chrom", "pos", "ref", F.array("alt").alias("alts")), info, every)
    rows = body.select(_tabs("chrom", "pos", "id", "ref", "alt", F.lit("."), F.lit("."), "info", "format", "samples").alias("value"))
    head = t.spark.createDataFrame([("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *taxa]),)], "value string")
    path = _lines(t, head.union(rows), "vcf-ad")
    return vcf.read_vcf_ad(t.spark, path)[1].where("a1 IS NOT NULL").withColumn("ad", F.array_join("ad", ","))


def _bases() -> Column:
    """A pileup string with bases of both strands, indels of one and two digits, and a read's begin and end."""
    return F.concat(
        F.repeat(F.lit("A"), F.col("l_linenumber")), F.lit(".,"), F.when(F.col("l_returnflag") == "R", "+2AG").otherwise(""),
        F.when(F.col("l_linestatus") == "F", "-12acgtacgtacgt").otherwise(""), F.lit("t^]c$*"),
    )


def _pileup_lines(t: Tables) -> DataFrame:
    line = t("lineitem")
    value = _tabs((F.col("l_partkey") % 5 + 1).cast("string"), F.col("l_orderkey").cast("string"), F.lit("g"), F.col("l_linenumber").cast("string"), _bases(), F.lit("I"), F.lit("0"), F.lit("*"), F.lit("*"))
    return line.select(value.alias("value"))


def _counted(t: Tables) -> DataFrame:
    pileup = reads.read_pileup(t.spark, _lines(t, _pileup_lines(t), "pileup"), "T1")
    return discovery.pileup_allele_counts(pileup).select("chrom", "pos", "depth", F.array_join("counts", ",").alias("counts"), "ref_n", F.array_join("ins_lens", ",").alias("ins"), F.array_join("del_lens", ",").alias("dels"))


_V1 = """SELECT CAST(l_partkey % 5 + 1 AS INT) AS chrom, CAST(l_orderkey AS INT) AS pos, l_linenumber AS depth,
concat_ws(',', l_linenumber, 1, 0, 1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS counts, 2 AS ref_n,
CASE WHEN l_returnflag = 'R' THEN '2' ELSE '' END AS ins, CASE WHEN l_linestatus = 'F' THEN '12' ELSE '' END AS dels FROM lineitem"""


def _depth_lines(t: Tables) -> DataFrame:
    value = _tabs((F.col("l_partkey") % 5 + 1).cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return t("lineitem").select(value.alias("value"))


def _sam_lines(t: Tables) -> DataFrame:
    a = t("alignments")
    text = lambda c: F.col(c).cast("string")
    row = _tabs("query", text("flag"), F.when(F.col("cigar") == "*", "*").otherwise(text("chrom")), text("start_pos"), text("mapq"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("NM:i:"), F.col("mapq") % 6), F.lit("MD:Z:4"))
    return t.spark.createDataFrame([("@HD\tVN:1.6",), ("@PG\tID:bwa",)], "value string").union(a.select(row.alias("value")))


_SAM = "SELECT query, flag, CASE WHEN cigar <> '*' THEN CAST(chrom AS STRING) END AS chrom, CASE WHEN cigar <> '*' THEN start_pos END AS start_pos, mapq, cigar FROM alignments"


def _blast(t: Tables) -> DataFrame:
    o = t("orders")
    text = lambda c: c.cast("string")
    start, end = F.col("o_orderkey") * 10, F.col("o_orderkey") * 10 + 49
    minus = F.col("o_custkey") % 2 == 0
    hit = _tabs(F.concat(F.lit("q"), "o_orderkey"), F.concat(F.lit("chr"), F.col("o_custkey") % 5), F.when(F.col("o_custkey") % 3 == 0, "100.00").otherwise("90.0"), F.lit("50"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("50"), text(F.when(minus, end).otherwise(start)), text(F.when(minus, start).otherwise(end)), F.when(F.col("o_custkey") % 7 == 0, "0.5").otherwise("1e-20"), F.lit("90"))
    lines = o.select(F.concat(F.lit("# Query: q"), "o_orderkey", F.lit(" x")).alias("value")).union(o.select(hit.alias("value")))
    return reads.read_blast(t.spark, _lines(t, lines, "blast"), 1e-5, 50).withColumn("perfect", F.col("perfect").cast("int"))


_BLAST = """SELECT 'q' || o_orderkey AS query, CASE WHEN o_custkey % 7 <> 0 THEN 'chr' || o_custkey % 5 END AS chrom, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderkey * 10 AS INT) END AS start_pos,
CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderkey * 10 + 49 AS INT) END AS last_pos, CASE WHEN o_custkey % 7 <> 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END END AS strand,
CASE WHEN o_custkey % 7 <> 0 THEN 50 END AS match, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 3 = 0 AS INT) END AS perfect FROM orders"""


def _simple_alignments(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "alignments")
    rows = al.cigar_match(al.cigar_end(t("alignments"))).where("cigar <> '*'")
    out = rows.select(F.col("query").alias("Query"), F.col("chrom").cast("string").alias("Chromosome"), F.col("start_pos").alias("StartPos"), F.col("end_pos").alias("EndPos"), F.col("strand").alias("Strand"), F.col("mapq").alias("MappingQuality"), F.col("match").alias("MatchNumber"), F.lit(0).alias("EditDistance"), F.lit(0).alias("IfPerfectMatch"))
    reads.write_alignments(out, path)
    return reads.read_alignments(t.spark, path)


def _fasta(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "fasta")
    reads.write_fasta(t("seqs").select(F.concat(F.lit("seq"), "seq_id").alias("description"), "seq"), path)
    return reads.read_fasta(t.spark, path).select("description", "seq")


def _fasta_chunks(t: Tables) -> DataFrame:
    """Chunks of 300 bases, written as chunks and read again as those of 120; gzipped, for text takes more room than the documents."""
    paths = [scratch_path(t.spark, "fasta") for _ in range(2)]
    reads.write_fasta(t("seqs").select(F.concat(F.lit("seq"), "seq_id").alias("description"), "seq"), paths[0], codec="gzip")
    reads.write_fasta(reads.read_fasta_chunks(t.spark, paths[0], 300), paths[1], codec="gzip")
    drop_path(t.spark, paths[0])
    return reads.read_fasta_chunks(t.spark, paths[1], 120).select("description", "chunk", "offset", "seq")


def _fastq(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "fastq")
    rows = t("read_pairs").select(F.col("read_id").alias("record"), F.concat(F.lit("@r"), "read_id").alias("id"), F.col("seq_r1").alias("seq"), F.lit("+").alias("des"), F.rpad("qual_r1", 125, "I").alias("qual"))
    reads.write_fastq(rows, path)
    return reads.read_fastq(t.spark, path).select("id", "seq", "qual")


def _gff(t: Tables) -> str:
    sign = F.when(F.col("strand") == 1, "+").otherwise("-")
    row = lambda kind, strand, attributes: _tabs(F.col("chrom").cast("string"), F.lit("x"), kind, F.col("start_pos").cast("string"), (F.col("end_pos") - 1).cast("string"), F.lit("."), strand, F.lit("."), attributes).alias("value")
    g = t("genes").select(row(F.lit("gene"), sign, F.concat(F.lit("ID="), "gene", F.when(F.col("strand") == 1, F.lit(";biotype=coding")).otherwise(""))))
    tr = t("transcripts").select(row(F.lit("mRNA"), sign, F.concat(F.lit("ID="), "transcript", F.lit(";Parent="), "gene")))
    kind = F.when(F.col("kind") == "CDS", "CDS").when(F.col("kind") == "5UTR", "five_prime_UTR").otherwise("three_prime_UTR")
    f = t("features").select(row(kind, F.lit("+"), F.concat(F.lit("Parent="), "transcript")))
    other = t.spark.createDataFrame([("##gff-version 3",), ("1\tx\texon\t1\t2\t.\t+\t.\tParent=z",), ("Mt\tx\tgene\t1\t2\t.\t+\t.\tID=m",)], "value string")
    return _lines(t, other.union(g).union(tr).union(f), "gff")


def _renamed(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("1", "2", "B73V4_7", "Mt", "Pt"))), F.col("chrom"))
    return tables.gff_rename_organelles(t("genes").select(_tabs(name, F.lit("x"), "gene").alias("value")))


def _models(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "models")
    tables.write_gene_models(genes.nested_models(t("genes"), t("transcripts"), t("features")), path)
    rows = t.spark.read.parquet(path).select("gene", F.explode("transcripts").alias("x"))
    return rows.select("gene", "x.transcript", F.col("x.t_start").alias("start_pos"), F.col("x.t_end").alias("end_pos"), F.coalesce(F.size("x.features"), F.lit(0)).alias("n_features"))


def _model_text(t: Tables) -> DataFrame:
    """Gene models written as text; the lengths and the fields of the lines read back."""
    nested = genes.nested_models(t("genes"), t("transcripts"), t("features"))
    lines = t.spark.read.text(_lines(t, tables.gene_model_text(nested), "model-text"))
    f = F.split("value", "\t")
    return lines.select(f[0].alias("gene"), f[1].alias("chrom"), f[2].cast("int").alias("start_pos"), F.size(F.split(f[5], ";")).alias("n_transcripts"), F.regexp_count(f[5], F.lit("CDS ")).cast("bigint").alias("n_cds"))


_MODEL_TEXT = "SELECT g.gene, CAST(g.chrom AS STRING) AS chrom, g.start_pos, CAST(greatest(COUNT(DISTINCT t.transcript), 1) AS INT) AS n_transcripts, COUNT(f.kind) AS n_cds FROM genes g LEFT JOIN transcripts t ON t.gene = g.gene LEFT JOIN features f ON f.transcript = t.transcript AND f.kind = 'CDS' GROUP BY 1, 2, 3"


def _matrix_text(t: Tables) -> DataFrame:
    """A distance matrix written as text and its rows read back."""
    path = scratch_path(t.spark, "matrix")
    tables.write_matrix(distance.divergence_table(distance.ibs_matrix(t("genotypes"))), path)
    f = F.split("value", "\t", 2)
    return t.spark.read.text(path).where("NOT startswith(value, 'Dxy')").select(f[0].alias("taxon"), f[1].alias("distances"))


_MATRIX_TEXT = f"SELECT taxon1 AS taxon, string_agg(printf('%.3f', dxy), chr(9) ORDER BY taxon2) AS distances FROM ({variant_queries._matrix_sql('grid')}) m GROUP BY 1"


def _ranges(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ranges")
    tables.write_ranges(t("ranges"), path)
    return tables.read_ranges(t.spark, path, 4)


def _hash_sql(key: str, seed: int) -> str:
    p = plain.HASHES
    first = f"((CAST({key} AS BIGINT) % {p} * 48271 + {seed} * 16807 + 12345) % {p})"
    second = f"((xor({first}, {first} >> 15) * 69621 + 7) % {p})"
    return f"((xor({second}, {second} >> 13) * 39373 + 11) % {p})"


def _germplasm(t: Tables) -> DataFrame:
    c = t("customer").select(F.concat(F.lit("G"), "c_custkey").alias("GID"), "c_name", F.col("c_mktsegment").alias("a"), F.lit("x").alias("b"), F.col("c_nationkey").alias("c"), F.lit("no").alias("d"), F.lit("shelf").alias("e"))
    path = scratch_path(t.spark, "germplasm")
    tables.write_table_text(c, path)
    return plain.number_rows(tables.read_germplasm(t.spark, path))


def _depth_stats(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "depth")
    tables.write_depth_stats(t("depths").groupBy("chrom", "pos").agg(F.sum("depth").alias("total"), F.max("depth").alias("deepest")), path)
    return t.spark.read.csv(path, sep="\t", header=True, schema="pos int, total bigint, deepest int, chrom int").select("chrom", "pos", "total", "deepest")


def _reads(t: Tables) -> DataFrame:
    """Reads of three kinds: a substitution, an insertion and a deletion after a clipped end."""
    kind = F.col("l_linenumber") % 3
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), kind + 1)
    return t("lineitem").select(
        F.concat_ws("_", F.lit("Q"), "l_orderkey", "l_linenumber", "l_partkey").alias("query"), (F.col("l_suppkey") % 5 + 1).cast("int").alias("chrom"), F.col("l_partkey").cast("int").alias("start_pos"),
        F.col("l_quantity").cast("int").alias("mapq"), pick("10M", "4M2I4M", "2S4M3D4M").alias("cigar"), pick("4A5", "8", "4^GAT4").alias("md"), pick("ACGTCACGTA", "ACGTTTACGT", "TTACGTACGT").alias("seq"),
        F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"),
    )


_READ = "concat_ws('_', 'Q', l_orderkey, l_linenumber, l_partkey) AS query, CAST(l_suppkey % 5 + 1 AS INT) AS chrom"
_L13 = f"""SELECT {_READ}, CAST(l_partkey + CASE l_linenumber % 3 WHEN 1 THEN 3 ELSE 4 END AS INT) AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'T' ELSE 'G' END AS ref,
CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'I' ELSE 'D' END AS alt FROM lineitem WHERE CAST(l_quantity AS INT) >= 30"""


def _snps(t: Tables) -> DataFrame:
    return t("part").select((F.col("p_partkey") % 5 + 1).cast("int").alias("chrom"), F.col("p_partkey").cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C,G").alias("alts"))


def _plain_reads(t: Tables) -> DataFrame:
    return _reads(t).withColumns({"cigar": F.lit("10M"), "seq": F.lit("ACGTCACGTA")})


_L14 = f"""WITH r AS (SELECT {_READ}, l_partkey AS s, l_returnflag = 'R' AS rev FROM lineitem WHERE CAST(l_quantity AS INT) >= 30)
SELECT query, r.chrom, CAST(p_partkey AS INT) AS pos, substr('ACGTCACGTA', p_partkey - s + 1, 1) AS allele, CASE WHEN rev THEN translate(substr('ACGTCACGTA', p_partkey - s + 1, 1), 'ACGT', 'TGCA') ELSE substr('ACGTCACGTA', p_partkey - s + 1, 1) END AS base,
CAST(CASE WHEN rev THEN 10 - (p_partkey - s) ELSE p_partkey - s + 1 END AS INT) AS read_pos FROM r JOIN part ON p_partkey % 5 + 1 = r.chrom AND p_partkey BETWEEN s AND s + 9"""


def _ends(t: Tables) -> DataFrame:
    """Two ends of a tag for each order; some lie too far apart."""
    o = t("orders")
    end = lambda flag, start, md: o.select(F.concat(F.lit("Q"), "o_orderkey").alias("query"), F.lit(flag).alias("flag"), (F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"), start.cast("int").alias("start_pos"), F.lit(60).alias("mapq"), F.lit("10M").alias("cigar"), F.lit(md).alias("md"), F.lit("ACGTCACGTA").alias("seq"))
    first = F.col("o_orderkey") * 3
    return end(64, first, "4A5").union(end(144, first + F.col("o_custkey") % 1500, "10"))


def _catalogue(t: Tables) -> DataFrame:
    return t("orders").select((F.col("o_custkey") % 5 + 1).cast("int").alias("chrom"), (F.col("o_orderkey") * 3 + 4).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alts")).distinct()


_ENDS = "e AS (SELECT 'Q' || o_orderkey AS query, CAST(o_custkey % 5 + 1 AS INT) AS chrom, o_orderkey * 3 AS s1, o_orderkey * 3 + o_custkey % 1500 AS s2 FROM orders WHERE o_custkey % 1500 < 1000)"
_B10 = f"""WITH {_ENDS}, snp AS (SELECT DISTINCT CAST(o_custkey % 5 + 1 AS INT) AS chrom, o_orderkey * 3 + 4 AS pos FROM orders),
hit AS (SELECT query, e.chrom, snp.pos, pos - s1 + 1 AS p, false AS rev FROM e JOIN snp ON snp.chrom = e.chrom AND pos BETWEEN s1 AND s1 + 9 UNION ALL SELECT query, e.chrom, snp.pos, pos - s2 + 1, true FROM e JOIN snp ON snp.chrom = e.chrom AND pos BETWEEN s2 AND s2 + 9)
SELECT query, chrom, CAST(pos AS INT) AS pos, substr('ACGTCACGTA', p, 1) AS allele, CASE WHEN rev THEN translate(substr('ACGTCACGTA', p, 1), 'ACGT', 'TGCA') ELSE substr('ACGTCACGTA', p, 1) END AS base, CAST(CASE WHEN rev THEN 11 - p ELSE p END AS INT) AS read_pos FROM hit"""


def _tag_reads(t: Tables) -> DataFrame:
    return gbs.tags_fastq(gbs.collapse_tags(t("tags")))


_B6 = """WITH c AS (SELECT tag_r1, tag_r2, first(r1_len ORDER BY r1_len, r2_len) AS r1_len, first(r2_len ORDER BY r1_len, r2_len) AS r2_len, CAST(SUM(read_count) AS BIGINT) AS read_count FROM tags GROUP BY 1, 2 HAVING SUM(read_count) >= 3)
SELECT substr(sha256(tag_r1 || tag_r2), 1, 16) || '_' || read_count AS id, e AS "end", CASE e WHEN 1 THEN substr(tag_r1, 1, r1_len) ELSE substr(tag_r2, 1, r2_len) END AS seq, repeat('f', CASE e WHEN 1 THEN r1_len ELSE r2_len END) AS qual FROM c, (SELECT unnest([1, 2]) AS e) x"""

ENTRIES: dict[str, Entry] = {
    "S1": (lambda t: vcf.read_vcf(t.spark, _vcf(t))[1], duckdb("SELECT taxon, chrom, pos, a1, a2 FROM genotypes", "genotypes")),
    "S2": (_vcf_ad, variant_queries._calls_sql("SELECT c.taxon, c.chrom, c.pos, g1 AS a1, g2 AS a2, ad FROM calls c JOIN taxa t ON t.taxon = c.taxon WHERE g1 IS NOT NULL", "taxa")),
    "S3": (lambda t: vcf.read_vcf(t.spark, _vcf(t))[0], duckdb("SELECT chrom, pos, ref, alt FROM sites", "sites")),
    "S4": (lambda t: vcf.vcf_taxa(t.spark.read.text(_vcf(t))), duckdb("SELECT CAST(row_number() OVER (ORDER BY taxon) - 1 AS INT) AS idx, taxon FROM (SELECT DISTINCT taxon FROM genotypes) x", "genotypes")),
    "S5": (lambda t: reads.read_pileup(t.spark, _lines(t, _pileup_lines(t), "pileup"), "T1").groupBy("chrom").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"), F.sum(F.length("bases")).alias("signs")),
           "SELECT CAST(l_partkey % 5 + 1 AS INT) AS chrom, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS depth, CAST(SUM(l_linenumber + 8 + CASE WHEN l_returnflag = 'R' THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 15 ELSE 0 END) AS BIGINT) AS signs FROM lineitem GROUP BY 1"),
    "S6": (lambda t: reads.read_depth(t.spark, _lines(t, _depth_lines(t), "depth"), "T1"), "SELECT 'T1' AS taxon, CAST(l_partkey % 5 + 1 AS INT) AS chrom, CAST(l_orderkey AS INT) AS pos, CAST(l_linenumber + l_suppkey AS INT) AS depth FROM lineitem"),
    "S7": (lambda t: reads.read_sam(t.spark, _lines(t, _sam_lines(t), "sam")).select("query", "flag", "chrom", "start_pos", "mapq", "cigar"), duckdb(_SAM, "alignments")),
    "S8": (lambda t: reads.read_bowtie2(t.spark, _lines(t, _sam_lines(t), "sam")).select("query", "flag", "cigar", "edit"), duckdb("SELECT query, flag, cigar, mapq % 6 AS edit FROM alignments", "alignments")),
    "S8_blast": (_blast, _BLAST),
    "S9": (_simple_alignments, duckdb(f"SELECT query AS Query, CAST(chrom AS STRING) AS Chromosome, start_pos AS StartPos, start_pos + CAST(regexp_extract(cigar, '(\\d+)M', 1) AS INT) + CAST(regexp_extract(cigar, '(\\d+)D', 1) AS INT) AS EndPos, CASE WHEN (flag & 16) <> 0 THEN 0 ELSE 1 END AS Strand, mapq AS MappingQuality, CAST(regexp_extract(cigar, '(\\d+)M', 1) AS INT) AS MatchNumber, 0 AS EditDistance, 0 AS IfPerfectMatch FROM alignments WHERE cigar <> '*'", "alignments")),
    "S10": (_fasta, duckdb("SELECT 'seq' || seq_id AS description, seq FROM seqs", "seqs")),
    "S10_chunks": (_fasta_chunks, duckdb("SELECT 'seq' || seq_id AS description, CAST(i AS BIGINT) AS chunk, CAST(120 * i AS BIGINT) AS offset, substr(seq, CAST(120 * i + 1 AS INT), 120) AS seq FROM seqs, LATERAL (SELECT unnest(generate_series(0, greatest((length(seq) - 1) // 120, 0))) AS i) x", "seqs")),
    "S11": (_fastq, duckdb("SELECT '@r' || read_id AS id, seq_r1 AS seq, rpad(qual_r1, 125, 'I') AS qual FROM read_pairs", "read_pairs")),
    "S12": (lambda t: tables.read_gff(t.spark, _gff(t))[1], duckdb("SELECT gene, transcript, chrom, start_pos, end_pos, strand FROM transcripts", "transcripts")),
    "S12_features": (lambda t: tables.read_gff(t.spark, _gff(t))[2], duckdb("SELECT transcript, kind, chrom, start_pos, end_pos FROM features", "features")),
    "S13": (lambda t: tables.gff_gene_table(t.spark, _gff(t)), duckdb("SELECT gene, CASE WHEN strand = 1 THEN 'coding' ELSE 'NA' END AS biotype, CAST(chrom AS STRING) AS chrom, start_pos, end_pos - 1 AS end_pos, strand, 'NA' AS description FROM genes", "genes")),
    "S14": (_renamed, duckdb("SELECT CASE chrom WHEN 4 THEN '11' WHEN 5 THEN '12' ELSE CAST(chrom AS STRING) END || chr(9) || 'x' || chr(9) || gene AS value FROM genes WHERE chrom <> 3", "genes")),
    "S15": (_models, duckdb("SELECT gene, t.transcript, t.start_pos, t.end_pos, CAST(COUNT(f.kind) AS INT) AS n_features FROM transcripts t LEFT JOIN features f ON f.transcript = t.transcript GROUP BY 1, 2, 3, 4", "transcripts", "features")),
    "S15_text": (_model_text, duckdb(_MODEL_TEXT, "genes", "transcripts", "features")),
    "S17": (_ranges, duckdb("SELECT * FROM ranges", "ranges")),
    "S20": (_germplasm, "SELECT 'G' || c_custkey AS gid, c_name AS accession, c_mktsegment AS chinese_name, 'x' AS english_name, CAST(c_nationkey AS STRING) AS taxa_name, 'no' AS contamination, 'shelf' AS seed_storage, row_number() OVER (ORDER BY 'G' || c_custkey) AS place FROM customer"),
    "S21_matrix": (_matrix_text, duckdb(_MATRIX_TEXT, "genotypes")),
    "S21": (_depth_stats, duckdb("SELECT chrom, pos, CAST(SUM(depth) AS BIGINT) AS total, MAX(depth) AS deepest FROM depths GROUP BY 1, 2", "depths")),
    "V1": (_counted, _V1),
    "L13": (lambda t: al.read_variants(_reads(t)), _L13),
    "L14": (lambda t: al.read_alleles(_plain_reads(t), _snps(t)), _L14),
    "B6": (_tag_reads, duckdb(_B6, "tags")),
    "B7": (lambda t: gbs.tag_snps(_ends(t)), f"WITH {_ENDS} SELECT query, chrom, CAST(s1 + 4 AS INT) AS pos, 'A' AS ref, 'C' AS alt FROM e"),
    "B10": (lambda t: gbs.tag_alleles(_ends(t), _catalogue(t)), _B10),
    "U2": (lambda t: plain.sample_rows(t("orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey", seed=7), f"SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', 7)}, o_orderkey) AS k FROM orders) x WHERE k <= 500"),
    "U2_replaced": (lambda t: plain.sample_rows(t("orders").select("o_orderkey"), 2000, "o_orderkey", True, seed=7), f"SELECT o_orderkey FROM range(2000) d(id) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) o ON k = 1 + CAST(floor({_hash_sql('id', 7)} * (SELECT COUNT(*) FROM orders) / 2147483647) AS BIGINT)"),
    "U2_shuffled": (lambda t: plain.number_rows(plain.shuffled(t("orders").select("o_orderkey"), "o_orderkey", 3)), f"SELECT o_orderkey, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', 3)}, o_orderkey) AS place FROM orders"),
}
