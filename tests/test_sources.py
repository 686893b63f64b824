"""Golden cases of the text formats."""

import gzip
import random

from pyspark.sql import functions as F
from shuffles import written

from seqloom.operators.alignments import edit_columns, read_alleles, read_variants
from seqloom.sources import reads, tables, vcf

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT2\tT1
1\t12\t1-12\tA\tC\t.\t.\tDP=3\tGT:AD\t0/1:2,1\t./.:0,0
1\t40\t1-40\tGA\tT,D\t.\t.\tDP=4\tGT:AD\t1|2:0,2,2\t1|1:0,4,0
"""


def save(folder, name, text):
    path = folder / name
    path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_vcf_round_trip(spark, tmp_path):
    for name in ("a.vcf", "a.vcf.gz"):
        sites, gt = vcf.read_vcf(spark, save(tmp_path, name, VCF))
        assert rows(sites, "pos") == [(1, 12, "A", "C"), (1, 40, "G", "T")]
        assert rows(gt, "pos", "taxon") == [("T1", 1, 12, None, None), ("T2", 1, 12, 0, 1), ("T1", 1, 40, 1, 1), ("T2", 1, 40, 1, 0)]
    vcf.write_vcf(sites, gt, str(tmp_path / "out"), ("fileformat=VCFv4.2", "source=x"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[:2] == ["##fileformat=VCFv4.2", "##source=x"] and lines[2].split("\t")[-2:] == ["T1", "T2"]
    assert lines[3].split("\t") == ["1", "12", "1-12", "A", "C", ".", ".", ".", "GT", "./.", "0/1"] and lines[4].endswith("1/1\t1/0")
    again = vcf.read_vcf(spark, str(tmp_path / "out"))[1]
    assert rows(again, "pos", "taxon") == rows(gt, "pos", "taxon")


def test_vcf_with_depths(spark, tmp_path):
    sites, gt = vcf.read_vcf_ad(spark, save(tmp_path, "a.vcf", VCF))
    assert rows(sites, "pos") == [(1, 12, "A", ["C"]), (1, 40, "GA", ["T", "D"])]
    assert rows(gt, "pos", "taxon") == [("T1", 1, 12, None, None, None), ("T2", 1, 12, 0, 1, [2, 1]), ("T1", 1, 40, 1, 1, [0, 4, 0]), ("T2", 1, 40, 1, 2, [0, 2, 2])]
    assert rows(vcf.vcf_taxa(spark.read.text(str(tmp_path / "a.vcf"))), "idx") == [(0, "T2"), (1, "T1")]


def test_pileup_and_depth(spark, tmp_path):
    path = save(tmp_path, "p.txt", "1\t5\ta\t2\t.A\tII\t0\t*\t*\n1\t6\tN\t1\t+1g,\tI\t2\t,,\tII\n")
    assert rows(reads.read_pileup(spark, path, "T1"), "pos") == [("T1", 1, 5, "A", 2, ".A"), ("T1", 1, 6, "N", 3, "+1g,,,")]
    path = save(tmp_path, "d.txt", "1\t5\t2\t3\n1\t6\t0\t4\n")
    assert rows(reads.read_depth(spark, path, "T1"), "pos") == [("T1", 1, 5, 5), ("T1", 1, 6, 4)]


SAM = """@HD\tVN:1.6
@PG\tID:x
q1\t0\t1\t100\t60\t5M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\tMD:Z:2A2
q2\t4\t*\t0\t0\t*\t*\t0\t0\tACGTA\tIIIII
q3\t16\t1\t99\t60\t1S3M1I2M1D2M1H\t*\t0\t0\tTACGTACGT\tIIIIIIIII\tNM:i:3\tMD:Z:3C1^G2
"""


def test_sam_and_variants(spark, tmp_path):
    sam = reads.read_sam(spark, save(tmp_path, "a.sam", SAM))
    assert [tuple(r)[:6] for r in sam.orderBy("query").collect()] == [("q1", 0, "1", 100, 60, "5M"), ("q2", 4, None, None, 0, "*"), ("q3", 16, "1", 99, 60, "1S3M1I2M1D2M1H")]
    assert [r.edit for r in reads.read_bowtie2(spark, str(tmp_path / "a.sam")).orderBy("query").collect()] == [1, None, 3]
    edits = {r.query: (r.edit, r.perfect, r.match) for r in edit_columns(sam).collect()}
    assert edits == {"q1": (1, False, 5), "q2": (None, False, None), "q3": (3, False, 7)}
    found = rows(read_variants(sam), "query", "pos", "alt")
    assert found == [("q1", "1", 102, "A", "G"), ("q3", "1", 101, "G", "I"), ("q3", "1", 102, "C", "A"), ("q3", "1", 104, "G", "D")]


def test_alleles_at_known_snps(spark, tmp_path):
    sam = reads.read_sam(spark, save(tmp_path, "a.sam", SAM)).withColumn("chrom", F.col("chrom").cast("int"))
    snps = spark.createDataFrame([(1, 102, "A", "G"), (1, 101, "G", "I"), (1, 104, "G", "D"), (1, 500, "A", "C"), (2, 102, "A", "C")], "chrom int, pos int, ref string, alts string")
    found = rows(read_alleles(sam, snps), "query", "pos")
    assert [f[:5] for f in found] == [("q1", 1, 101, "C", "C"), ("q1", 1, 102, "G", "G"), ("q1", 1, 104, "A", "A"), ("q3", 1, 101, "I", "A"), ("q3", 1, 102, "A", "T"), ("q3", 1, 104, "D", "G")]
    assert [f[5] for f in found] == [2, 3, 5, 5, 4, 3]


def test_blast(spark, tmp_path):
    text = "# BLASTN\n# Query: a x\n# 0 hits\n# Query: b\nb\tchr1\t100.00\t50\t0\t0\t1\t50\t90\t41\t1e-20\t90\nb\tchr2\t90.0\t40\t4\t0\t1\t40\t5\t44\t1.0\t20\n"
    got = rows(reads.read_blast(spark, save(tmp_path, "b.txt", text), 1e-5, 50), "query")
    assert got == [("a", None, None, None, None, None, None), ("b", "chr1", 41, 90, 0, 50, True)]


def test_alignment_tables(spark, tmp_path):
    df = spark.createDataFrame([("q", "1", 5, 9, 1, 60, 5, 0, 1)], reads.ALIGNMENT)
    reads.write_alignments(df, str(tmp_path / "al"))
    assert reads.read_alignments(spark, str(tmp_path / "al")).collect() == df.collect()


def test_fasta_and_fastq(spark, tmp_path):
    fasta = reads.read_fasta(spark, save(tmp_path, "a.fa.gz", ">one x\nACGT\nacgt\n>two\n" + "A" * 130 + "\n"))
    assert rows(fasta, "seq_id") == [(1, "one x", "ACGTACGT"), (2, "two", "A" * 130)]
    assert [r.value for r in reads.fasta_lines(fasta).orderBy("value").collect()] == [">one x\nACGTACGT", ">two\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10]
    reads.write_fasta(fasta, str(tmp_path / "f"))
    assert sorted(tuple(r)[1:] for r in reads.read_fasta(spark, str(tmp_path / "f")).collect()) == [("one x", "ACGTACGT"), ("two", "A" * 130)]
    reads.write_fasta(fasta, str(tmp_path / "g"), by_chrom=True)
    assert {p.name for p in (tmp_path / "g").glob("chrom=*")} == {"chrom=one x", "chrom=two"} or len(list((tmp_path / "g").glob("chrom=*"))) == 2
    fastq = reads.read_fastq(spark, save(tmp_path, "a.fq", "@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n!5\n"))
    assert rows(fastq, "record") == [(1, "@r1", "ACGT", "+", "IIII"), (2, "@r2", "GG", "+", "!5")]
    assert reads.phred_offset(fastq) == 33 and reads.phred_offset(fastq.withColumn("qual", F.lit("hhhh"))) == 64
    reads.write_fastq(fastq, str(tmp_path / "q"))
    assert rows(reads.read_fastq(spark, str(tmp_path / "q")), "record") == rows(fastq, "record")
    reads.fastq_to_fasta(fastq, str(tmp_path / "qa"))
    assert {r.description for r in reads.read_fasta(spark, str(tmp_path / "qa")).collect()} == {"r1", "r2"}


GFF = """##gff-version 3
##sequence-region 1 1 1000
##sequence-region B73V4 1 9
1\tx\tchromosome\t1\t1000\t.\t.\t.\tID=chromosome:1
1\tx\tgene\t10\t90\t.\t+\t.\tID=gene:G1;biotype=protein_coding;description=kinase
1\tx\tmRNA\t10\t90\t.\t+\t.\tID=transcript:G1.1;Parent=gene:G1
1\tx\tfive_prime_UTR\t10\t14\t.\t+\t.\tParent=transcript:G1.1
1\tx\texon\t10\t40\t.\t+\t.\tParent=transcript:G1.1
1\tx\tCDS\t15\t40\t.\t+\t0\tID=CDS:P1;Parent=transcript:G1.1
1\tx\tgene\t200\t300\t.\t-\t.\tID=gene:G2
B73V4\tx\tgene\t1\t9\t.\t+\t.\tID=gene:S
Mt\tx\tgene\t1\t9\t.\t+\t.\tID=gene:M
"""


def test_gff(spark, tmp_path):
    path = save(tmp_path, "a.gff3", GFF)
    genes, transcripts, features = tables.read_gff(spark, path, "maize")
    assert rows(genes, "gene") == [("G1", 1, 10, 91, 1), ("G2", 1, 200, 301, 0)]
    assert rows(transcripts, "gene") == [("G1", "G1.1", 1, 10, 91, 1)]
    assert rows(features, "start_pos") == [("G1.1", "5UTR", 1, 10, 15), ("G1.1", "CDS", 1, 15, 41)]
    assert rows(tables.gff_gene_table(spark, path), "gene") == [("G1", "protein_coding", "1", 10, 90, 1, "kinase"), ("G2", "NA", "1", 200, 300, 0, "NA")]
    renamed = [r.value for r in tables.gff_rename_organelles(spark.read.text(path)).collect()]
    assert not any("B73" in x for x in renamed) and any(x.startswith("11\tx") for x in renamed)
    wheat = save(tmp_path, "w.gff3", "3\ty\tgene\t5\t9\t.\t-\t.\tID=T1;x=2\n3\ty\tmRNA\t5\t9\t.\t-\t.\tID=T1.1;Parent=T1\n")
    assert rows(tables.read_gff(spark, wheat)[1], "gene") == [("T1", "T1.1", 3, 5, 10, 0)]


def test_gene_models_round_trip(spark, tmp_path):
    from seqloom.operators.genes import nested_models

    genes, transcripts, features = tables.read_gff(spark, save(tmp_path, "a.gff3", GFF), "maize")
    models = nested_models(genes, transcripts, features)
    tables.write_gene_models(models, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    text = {r.value for r in tables.gene_model_text(models).collect()}
    assert "G1\t1\t10\t91\t1\tG1.1:10:91[5UTR 10 15,CDS 15 41]" in text


def test_tables_ranges_and_sheets(spark, tmp_path):
    import pytest

    path = save(tmp_path, "t.txt.gz", "a\tb\n1\tx\n2\t\n")
    table = tables.read_table(spark, path)
    tables.write_table_text(table, str(tmp_path / "t"), keep=F.col("a") == "1", gzip=True)
    assert rows(tables.read_table(spark, str(tmp_path / "t")), "a") == [("1", "x")]
    ranges = tables.read_ranges(spark, save(tmp_path, "r.txt", "Chr\tStart\tEnd\tValue\tStrand\n1\t5\t9\t0.5\t1\n"), 5)
    assert rows(ranges, "chrom") == [(1, 5, 9, 0.5, 1)]
    tables.write_ranges(ranges, str(tmp_path / "r"), keep=F.col("start_pos") > 1)
    assert rows(tables.read_ranges(spark, str(tmp_path / "r"), 5), "chrom") == [(1, 5, 9, 0.5, 1)]
    sheet = tables.read_taxa_map(spark, save(tmp_path, "s.txt", "Taxa\tCoverage\tBams\nT1\t10.5\ta.bam\tb.bam\nT2\t8\tc.bam\n"))
    assert rows(sheet, "taxon") == [("T1", 10.5, ["a.bam", "b.bam"]), ("T2", 8.0, ["c.bam"])]
    assert rows(tables.taxa_totals(sheet), "n_taxa") == [(2, 3)]
    assert rows(tables.read_taxa_map(spark, save(tmp_path, "s2.txt", "Taxa\tRef\tBams\nT1\tr.fa\ta.bam\n"), "reference"), "taxon") == [("T1", "r.fa", ["a.bam"])]
    with pytest.raises(ValueError, match="T1"):
        tables.read_taxa_map(spark, save(tmp_path, "s3.txt", "T1\ta\nT1\tb\n"), "bams")
    germ = save(tmp_path, "g.txt", "\t".join("abcdefg") + "\nG2\t1\t2\t3\t4\t5\t6\nG1\t1\t2\t3\t4\t5\t6\n")
    assert [r.gid for r in tables.read_germplasm(spark, germ).collect()] == ["G1", "G2"]


def test_matrix_and_depth_output(spark, tmp_path):
    table = spark.createDataFrame([("T2", "0.500\t0.000"), ("T1", "0.000\t0.500")], "Dxy string, distances string")
    tables.write_matrix(table, str(tmp_path / "m"))
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["Dxy\tT1\tT2", "T1\t0.000\t0.500", "T2\t0.500\t0.000"]
    tables.write_depth_stats(spark.createDataFrame([(1, 2, 0.5, 0.1)], "chrom int, pos int, mean double, sd double"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "chrom=1").is_dir()


def test_fasta_headers_may_hold_the_sign_and_files_have_many_splits(spark, tmp_path):
    records = [(f"r{i} a>b > {i}" if i % 2 else "", "ACGTN" * (i % 7) + "acg") for i in range(200)]
    for part in range(2):
        lines = [line for d, s in records[part * 100 : part * 100 + 100] for line in (f">{d}", s[:4], *([s[4:]] if s[4:] else []))]
        (tmp_path / f"{part}.fa").write_text(("" if part else "; note\n") + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = reads.read_fasta(spark, str(tmp_path)).orderBy("seq_id").collect()
        assert [(r.seq_id, r.description, r.seq) for r in got] == [(i + 1, d, s.upper()) for i, (d, s) in enumerate(records)]
        (tmp_path / "q.fq").write_text("".join(f"@r{i} x\nACGT\n+\nIII{i % 10}\n" for i in range(150)))
        rows = reads.read_fastq(spark, str(tmp_path / "q.fq")).orderBy("record").collect()
        assert [(r.record, r.id, r.seq, r.des, r.qual) for r in rows] == [(i + 1, f"@r{i} x", "ACGT", "+", f"III{i % 10}") for i in range(150)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chunks_within_a_split_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n" + "ACGTACGTAC\n" * (i % 90) for i in range(400)))
    assert written(spark, lambda: reads.read_fasta_chunks(spark, str(tmp_path), 60).collect()) <= 20
    reads.write_fasta(reads.read_fasta_chunks(spark, str(tmp_path), 60), str(tmp_path / "z"), codec="gzip")
    assert all(p.suffix == ".gz" for p in (tmp_path / "z").glob("part-*"))
    assert rows(reads.read_fasta(spark, str(tmp_path / "z")), "seq_id") == [(i + 1, f"r{i}", "ACGTACGTAC" * (i % 90)) for i in range(400)]


def test_long_records_are_read_in_chunks_from_many_splits(spark, tmp_path):
    """Records over many splits and files, lines of any length, empty records, text before the first header."""
    rng = random.Random(8)
    records, lines = [], ["no header yet"]
    for i in range(12):
        lines.append(f">r{i} > x")
        bases = ""
        for _ in range(rng.choice((0, 0, 1, 40))):
            part = "".join(rng.choice("ACGTacgtN") for _ in range(rng.choice((0, 1, 7, 60, 333))))
            lines.append(part[:5] + " \t" + part[5:])
            bases += part.upper()
        records.append((i + 1, f"r{i} > x", bases))
    text = "\n".join(lines) + "\n"
    third = text.index("\n", len(text) // 3) + 1
    (tmp_path / "a.fa").write_text(text[:third])
    (tmp_path / "b.fa").write_text(text[third:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [tuple(r) for r in reads.read_fasta_chunks(spark, str(tmp_path), 60).orderBy("seq_id", "chunk").collect()]
        assert [tuple(r) for r in reads.read_fasta(spark, str(tmp_path)).orderBy("seq_id").collect()] == records
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{name}", value)
    assert got == [(i, d, p // 60, p, s[p : p + 60]) for i, d, s in records for p in (range(0, len(s), 60) if s else [0])]
    chunks = spark.createDataFrame(got, "seq_id bigint, description string, chunk bigint, offset bigint, seq string")
    reads.write_fasta(chunks.repartition(5), str(tmp_path / "out"))
    assert [tuple(r) for r in reads.read_fasta(spark, str(tmp_path / "out")).orderBy("seq_id").collect()] == records
