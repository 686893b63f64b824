"""Golden cases, properties and brute force for the genomic operators."""

import math
import random

import pytest
from pyspark.sql import functions as F
from shuffles import written

from seqloom.functions import bases
from seqloom.operators import alignments, calling, coordinates, discovery, distance, gbs, genes, genotypes, ranges, sequences, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


PILEUP = [
    ("..,A", [1, 0, 0, 0, 0, 0], 3, [], []),
    (".+2AG.", [0, 0, 0, 0, 0, 1], 2, [2], []),
    (",-12acgtacgtacgt,", [0, 0, 0, 0, 1, 0], 2, [], [12]),
    ("^]A$", [1, 0, 0, 0, 0, 0], 0, [], []),
    ("^+AT", [1, 0, 0, 1, 0, 0], 0, [], []),
    ("*", [0] * 6, 0, [], []),
    ("aAcCgGtT", [2, 2, 2, 2, 0, 0], 0, [], []),
    (".+1A,+2ac", [0, 0, 0, 0, 0, 2], 2, [1, 2], []),
    (None, [0] * 6, 0, [], []),
]


def test_pileup_symbols(spark):
    df = spark.createDataFrame([("T", 1, i, "A", 4, p[0]) for i, p in enumerate(PILEUP)], "taxon string, chrom int, pos int, ref string, depth int, bases string")
    got = discovery.pileup_allele_counts(df).orderBy("pos").collect()
    assert [(r.counts, r.ref_n, r.ins_lens, r.del_lens) for r in got] == [p[1:] for p in PILEUP]
    assert got[1].indel_seqs == ["IAG"] and got[2].indel_seqs == ["DACGTACGTACGT"]


def test_discovery_filters(spark):
    sites = [  # depth, alleles (n, code, len), indel types, ref -> kept
        (10, [(5, 1, 0)], 0, "A", 1), (10, [(5, 1, 0)], 0, "N", None), (1, [(1, 1, 0)], 0, "A", None), (10, [(5, 3, 0), (2, 1, 0)], 0, "A", 3), (10, [(5, 3, 0), (3, 1, 0)], 0, "A", None),
        (10, [(7, 1, 0)], 0, "A", None), (10, [(9, 1, 0)], 0, "A", 1), (10, [(3, 1, 0)], 0, "A", None), (10, [(5, 5, 2)], 2, "A", None), (10, [(5, 5, 2)], 1, "A", 5), (400, [(200, 1, 0)], 0, "A", None), (10, [], 0, "A", None),
    ]
    df = spark.createDataFrame([("T", 1, i, *s[:4]) for i, s in enumerate(sites)], "taxon string, chrom int, pos int, depth bigint, alleles array<struct<n:bigint,code:int,indel_len:int>>, indel_types bigint, ref string")
    taxa = spark.createDataFrame([("T", 10.0)], "taxon string, coverage double")
    got = {r.pos: r.allele for r in discovery.discover_variants(df, taxa).collect()}
    assert got == {i: s[4] for i, s in enumerate(sites) if s[4] is not None}


def test_tie_goes_to_the_higher_code(spark):
    df = spark.createDataFrame([("T", 1, 1, 0, 0, 5), ("T", 1, 1, 3, 0, 5), ("T", 1, 1, 5, 1, 2), ("T", 1, 1, 5, 2, 2)], "taxon string, chrom int, pos int, code int, indel_len int, n int")
    top = discovery.symbol_sites(df).first()
    assert [(a.n, a.code) for a in top.alleles] == [(5, 3), (5, 0), (4, 5)] and top.alleles[2].indel_len == 2 and top.indel_types == 2


def test_upper_gamma_known_values():
    assert math.isclose(discovery.upper_gamma(0.5, 1.920729410347), 0.05, rel_tol=1e-9)
    assert math.isclose(discovery.upper_gamma(1, 3), math.exp(-3), rel_tol=1e-12)
    assert math.isclose(discovery.upper_gamma(5, 9.153519026), 0.05, rel_tol=1e-6)
    assert discovery.upper_gamma(2, 0) == 1.0 and discovery.upper_gamma(10, 200) < 1e-60


def test_chi_square_of_a_joint_site(spark):
    data = [(f"T{i}", 1, 7, c, 0, n) for i, (ref, alt) in enumerate([(10, 0), (9, 1), (0, 10), (1, 9)]) for c, n in ((-1, ref), (1, alt)) if n]
    df = spark.createDataFrame(data, "taxon string, chrom int, pos int, code int, indel_len int, n int")
    taxa = spark.createDataFrame([(f"T{i}", 10.0) for i in range(4)], "taxon string, coverage double")
    site = discovery.joint_call(df, taxa).first()
    assert (site.alts, site.dp, site.nz, site.ad, site.ap) == ([1], 40, 4, [20], [3])
    want = sum((a - 5) ** 2 / 5 + (10 - a - 5) ** 2 / 5 for a in (0, 1, 10, 9))
    assert math.isclose(site.pv[0], discovery.upper_gamma(1.5, want / 2), rel_tol=1e-9)
    assert discovery.joint_call(df, taxa, discovery.JointParams(max_p=1e-30)).count() == 0


def plain_call(counts, err=0.05):
    """Likelihoods as products, by the definition."""
    n = sum(counts)
    if n == 0:
        return None, None
    if n > 150:
        counts, n = [int(c * 150 / n) for c in counts], 150
    ways = math.factorial(n)
    for c in counts:
        ways /= math.factorial(c)
    cost = {}
    for i in range(len(counts)):
        for j in range(i, len(counts)):
            fit = (1 - 0.75 * err) ** counts[i] if i == j else (0.5 - err / 4) ** (counts[i] + counts[j])
            rest = n - counts[i] - (counts[j] if i != j else 0)
            cost[i, j] = -(math.log10(ways) + math.log10(fit) + rest * math.log10(err / 4))
    best = min(sorted(cost), key=lambda k: round(cost[k], 9))
    return best, [math.floor(round(cost[i, j], 9) + 0.5) for j in range(len(counts)) for i in range(j + 1)]


def test_genotype_calls_match_products(spark):
    rng = random.Random(3)
    cases = [[0, 0, 0], [1, 1, 0], [5, 0, 0], [0, 0, 9], [200, 200, 60], [75, 75, 0], [149, 1, 0], [3, 1], [0, 2]] + [[rng.randint(0, 40) for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame([(str(i), 1, 1, c) for i, c in enumerate(cases)], "taxon string, chrom int, pos int, counts array<int>")
    for r in calling.call_genotypes(df).collect():
        best, gl = plain_call(r.counts)
        assert (r.gt, r.gl, r.ad) == ("./." if best is None else f"{best[0]}/{best[1]}", gl, r.counts)


def test_missing_site_has_no_frequency(spark):
    df = spark.createDataFrame([("T", 1, 1, [0, 0, 0])], "taxon string, chrom int, pos int, counts array<int>")
    info = calling.site_info(calling.call_genotypes(df)).first()
    assert (info.nz, info.maf, info.gn) == (0, None, "0,0,0,0,0,0")


def random_genotypes(spark, taxa=7, sites=60, seed=1):
    rng = random.Random(seed)
    cell = lambda: rng.choice([(0, 0), (0, 1), (1, 0), (1, 1), (None, None)])
    return spark.createDataFrame([(f"T{t}", 1 + s % 2, s, *cell()) for t in range(taxa) for s in range(sites)], "taxon string, chrom int, pos int, a1 int, a2 int")


@pytest.mark.parametrize("kind", distance.KINDS)
def test_gram_matrix_equals_pairs(spark, kind):
    gt = random_genotypes(spark)
    matrix = {(r.taxon1, r.taxon2): (r.n, r.dxy) for r in distance.ibs_matrix(gt, kind, tile=4).collect()}
    assert len(matrix) == 49
    for a, b in (("T0", "T1"), ("T3", "T6"), ("T5", "T2")):
        pair = distance.ibs(gt, a, b, kind=kind).first()
        assert matrix[a, b] == matrix[b, a] == (pair.n, pair.dxy)
    assert all(matrix[f"T{i}", f"T{i}"][1] == 0 for i in range(7))
    few = distance.ibs_matrix(gt, kind, max_sites=10)
    sites = sorted({(r.chrom, r.pos) for r in gt.collect()})[::6]
    some = distance.ibs(gt, "T0", "T1", spark.createDataFrame(sites, "chrom int, pos int"), kind).first()
    assert few.where("taxon1 = 'T0' AND taxon2 = 'T1'").first().dxy == some.dxy


def test_merges_check_their_keys(spark):
    gt = random_genotypes(spark)
    with pytest.raises(ValueError, match="taxon"):
        genotypes.merge_by_site(gt, gt.where("taxon = 'T1'"))
    with pytest.raises(ValueError, match="pos"):
        genotypes.merge_by_taxon(gt, gt.where("pos = 1"))


def random_ranges(seed, n=200, longest=900):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.randint(1, 5000)
        out.append((rng.randint(1, 2), s, s + rng.choice([0, 1, 3, rng.randint(1, 40), rng.randint(1, longest), 40_000])))
    return out


SCHEMA = "chrom int, start_pos int, end_pos int"


def test_overlap_join_matches_all_pairs_with_long_ranges(spark):
    a, b = random_ranges(1), random_ranges(2)
    got = rows(ranges.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), bin_size=16))
    want = [(*x, *y) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])]
    assert sorted(got) == sorted(want)


def test_ranges_at_matches_all_pairs(spark):
    a = random_ranges(3)
    positions = [(c, p) for c in (1, 2) for p in range(1, 46_000, 97)]
    got = rows(ranges.ranges_at(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(positions, "chrom int, pos int"), bin_size=16))
    assert sorted(got) == sorted((c, p, *x) for c, p in positions for x in a if x[0] == c and x[1] <= p < x[2])


def test_short_ranges_are_sent_to_narrow_bins_alone(spark):
    rng = random.Random(5)
    a, b = ([(1, s, s + rng.randint(1, 20)) for s in (rng.randint(0, 5000) for _ in range(400))] for _ in range(2))
    x, y = (spark.createDataFrame(r, SCHEMA).coalesce(1) for r in (a, b))
    bins = sum((e - 1) // 16 - s // 16 + 1 for _, s, e in a + b)
    assert written(spark, lambda: ranges.overlap_join(x, y, 16).collect()) <= bins + 10


def test_positions_are_sent_to_one_bin(spark):
    rng = random.Random(6)
    a = [(1, s, s + rng.randint(1, 20)) for s in (rng.randint(0, 5000) for _ in range(400))]
    x, y = spark.createDataFrame(a, SCHEMA).coalesce(1), spark.range(5000).selectExpr("1 AS chrom", "CAST(id AS INT) AS pos").coalesce(1)
    bins = sum((e - 1) // 16 - s // 16 + 1 for _, s, e in a)
    assert written(spark, lambda: ranges.ranges_at(x, y, 16).collect()) <= bins + 5000 + 10


def test_first_ranges_match_plain_loops_and_meet_a_position_once(spark, monkeypatch):
    rng = random.Random(7)
    a = random_ranges(7) + [(1, s, e) for s in (50, 51, 300) for e in (1000, 60, 60, 52, 2000, 2000)] * 40 + [(None, 1, 9), (1, None, 9)]
    a += [(3, rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(300)]
    positions = [(c, p) for c in (1, 2, 4) for p in range(1, 46_000, 97)] + [(1, p) for p in range(40, 320)] * 2 + [(3, p) for p in range(-99, 99)] + [(None, 5), (1, None)]
    made = []
    plain = ranges.ranges_at
    monkeypatch.setattr(ranges, "ranges_at", lambda *x, **y: made.append(plain(*x, **y)) or made[-1])
    got = rows(ranges.first_range_at(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(positions, "chrom int, pos int")))
    whole = [r for r in a if None not in r]
    want = [(c, p, *min(((s, e) for k, s, e in whole if k == c and p is not None and s <= p < e), default=(None, None))) for c, p in set(positions)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert made[0].count() == sum(r[2] is not None for r in got)


@pytest.mark.parametrize("longest", [9_000, 100_000])
def test_a_gene_holds_a_position_once(spark, longest):
    a = [(*r, f"G{i % 40}") for i, r in enumerate(random_ranges(8))] + [(2, 3000, 90_000, f"G{i}") for i in range(40)] + [(1, 5, 90, "A"), (1, 5, 90, "A"), (1, 20, 30, "A"), (1, 80, 99, "A"), (1, 20, 60, None), (1, 30, 70, None), (1, 90, 90, "B")]
    a = [r for r in a if r[2] - r[1] < longest]
    assert (max(e - s for _, s, e, _ in a) > ranges.BIN * ranges.MOST_BINS) == (longest == 100_000)
    positions = [(c, p) for c in (1, 2) for p in range(1, 46_000, 97)] + [(1, p) for p in range(100)]
    got = rows(genes.genes_at(spark.createDataFrame(a, f"{SCHEMA}, gene string"), spark.createDataFrame(positions, "chrom int, pos int")))
    assert sorted(got, key=repr) == sorted({(c, p, g) for c, p in positions for k, s, e, g in a if k == c and s <= p < e}, key=repr)


def test_merge_is_idempotent_and_keeps_positions(spark):
    a = [r for r in random_ranges(4) if r[2] - r[1] < 5000]
    merged = ranges.merge_overlaps(spark.createDataFrame(a, SCHEMA), stretch=256)
    got = rows(merged, "chrom", "start_pos")
    assert rows(ranges.merge_overlaps(merged, stretch=1024), "chrom", "start_pos") == got
    held = {(c, p) for c, s, e in a for p in range(s, e)}
    assert {(c, p) for c, s, e in got for p in range(s, e)} == held and sum(e - s for _, s, e in got) == len(held)
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(("size", "step"), [(100, 25), (90, 40), (10, 30), (50, 50)])
def test_windows_match_brute_force(spark, size, step):
    rng = random.Random(size)
    lengths = spark.createDataFrame([(1, 400), (2, 77), (3, 1)], "chrom int, chrom_len int")
    windows = ranges.make_windows(lengths, size, step)
    want = [(c, s, s + size) for c, n in ((1, 400), (2, 77)) for s in range(1, n, step)]
    assert sorted(rows(windows)) == want
    values = [(rng.randint(1, 2), rng.randint(1, 70), float(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(values, "chrom int, pos int, value double")
    assert sorted(rows(ranges.window_counts(df, windows, size, step))) == [(*w, sum(1 for c, p, _ in values if c == w[0] and w[1] <= p < w[2])) for w in want]
    assert sorted(rows(ranges.window_sums(df, windows, size, step))) == [(*w, sum(v for c, p, v in values if c == w[0] and w[1] <= p < w[2])) for w in want]
    a = [(c, s, s + rng.randint(0, 60)) for c, s, _ in values]
    got = sorted(rows(ranges.window_coverage(spark.createDataFrame(a, SCHEMA), windows, size, step)))
    assert got == [(*w, sum(max(0, min(e, w[2]) - max(s, w[1])) for c, s, e in a if c == w[0])) for w in want]


def test_bases_and_kmers(spark):
    df = spark.createDataFrame([("ACGTN",), ("TTTT",)], "seq string")
    twice = df.select("seq", bases.reverse_complement(bases.reverse_complement(F.col("seq"))).alias("again")).collect()
    assert all(r.seq == r.again for r in twice)
    codes = spark.createDataFrame([("ACGTACGTACGTACGT",), ("N" * 16,)], "kmer string").select("kmer", bases.encode_kmer(F.col("kmer")).alias("c"))
    good, bad = codes.withColumn("d", bases.decode_kmer(F.col("c"), 16)).collect()
    assert good.d == good.kmer and bad.c is None
    turned = spark.createDataFrame([(w,) for w in ("A", "ACG", "GATTACAGATTACAGATTACAGATTACAGAC", "TTTT")], "w string").select("w", bases.decode_kmer(bases.complement_code(bases.encode_kmer(F.col("w")), 4), 4).alias("four"), bases.decode_kmer(bases.complement_code(bases.encode_kmer(F.col("w")), 31), 31).alias("long"))
    got = {r.w: r for r in turned.collect()}
    turn = str.maketrans("ACGT", "TGCA")
    assert got["TTTT"].four == "AAAA" and got["ACG"].four == "AACG".translate(turn)[::-1] and got["GATTACAGATTACAGATTACAGATTACAGAC"].long == "GATTACAGATTACAGATTACAGATTACAGAC".translate(turn)[::-1]
    two = spark.createDataFrame([("ACGTACGT", "ACGAACGG")], "a string, b string")
    r = two.select(bases.hamming(F.col("a"), F.col("b")).alias("h"), bases.packed_hamming(bases.encode_kmer(F.col("a")), bases.encode_kmer(F.col("b"))).alias("p"), bases.hamming(F.col("a"), F.col("b"), 1).alias("l")).first()
    assert (r.h, r.p, r.l) == (2, 2, 32)


def test_kmers_by_position(spark):
    rng = random.Random(9)
    data = [(i, "".join(rng.choice("ACGTACGTN") for _ in range(n))) for i, n in enumerate((30, 3, 0, 17))]
    seqs = spark.createDataFrame(data, "seq_id int, seq string")
    mers = {(i, p): s[p : p + 3] for i, s in data for p in range(len(s) - 2) if "N" not in s[p : p + 3]}
    assert {(r.seq_id, r.pos): r.kmer for r in sequences.kmers(seqs, 3, chunk=4).collect()} == mers


def test_empty_qualities_stay_empty(spark):
    df = spark.createDataFrame([(1, "I?5+!"), (2, ""), (3, None), (4, "!")], "read_id int, qual string")
    assert rows(sequences.rescale_quality(df), "read_id") == [(1, "!+5?I", "h^TJ@"), (2, "", ""), (3, None, None), (4, "!", "@")]


def test_tag_snps_and_alleles(spark):
    cols = "query string, flag int, chrom int, start_pos int, mapq int, cigar string, seq string, md string"
    data = [("t1", 64, 1, 100, 60, "5M", "ACGTA", "2A2"), ("t1", 144, 1, 300, 60, "5M", "ACGTA", "5"), ("t2", 64, 1, 100, 60, "5M", "ACGTA", "2A2"), ("t2", 144, 2, 300, 60, "5M", "ACGTA", "5"),
            ("t3", 64, 1, 100, 60, "5M", "ACGTA", "5"), ("t3", 144, 1, 200, 60, "5M", "ACGTA", "5"), ("t4", 64, 1, 100, 10, "5M", "ACGTA", "2A2"), ("t4", 144, 1, 200, 60, "5M", "ACGTA", "1A3")]
    df = spark.createDataFrame(data, cols)
    assert rows(gbs.tag_snps(df)) == [("t1", 1, 102, "A", "G")]
    catalogue = spark.createDataFrame([(1, 102, "A", "G"), (1, 302, "G", "C")], "chrom int, pos int, ref string, alts string")
    got = rows(gbs.tag_alleles(df, catalogue), "query", "pos")
    assert got == [("t1", 1, 102, "G", "G", 3), ("t1", 1, 302, "G", "C", 3), ("t3", 1, 102, "G", "G", 3)]


def test_tags_as_fastq(spark):
    tags = spark.createDataFrame([("A" * 96, "C" * 96, 20, 30, 7)], "tag_r1 string, tag_r2 string, r1_len int, r2_len int, read_count int")
    got = gbs.tags_fastq(tags).orderBy("end").collect()
    assert [(r.end, r.seq, len(r.qual)) for r in got] == [(1, "A" * 20, 20), (2, "C" * 30, 30)] and got[0].id.endswith("_7")


def test_samples_and_parts(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in tables.sample_rows(df.repartition(n), 50, "id", seed=4).collect()) for n in (1, 16))
    assert a == b and len(set(a)) == 50
    assert a != sorted(r.id for r in tables.sample_rows(df, 50, "id", seed=5).collect())
    assert [tables.sample_rows(df, n, "id").count() for n in (0, 999, 1000, 2000)] == [0, 999, 1000, 1000]
    many, again = (tables.sample_rows(df.repartition(n), 3000, "id", replace=True, seed=4) for n in (2, 7))
    assert many.count() == 3000 and 900 < many.select("id").distinct().count() < 1000
    assert sorted(r.id for r in many.collect()) == sorted(r.id for r in again.collect())
    assert tables.sample_rows(df.limit(0), 5, "id", replace=True).count() == tables.sample_rows(df.limit(0), 5, "id").count() == 0
    mixed = [r.id for r in tables.shuffled(df.repartition(5), "id").collect()]
    assert sorted(mixed) == list(range(1000)) and mixed != sorted(mixed) and mixed == [r.id for r in tables.shuffled(df, "id").collect()]
    parts = {r.part: r["count"] for r in tables.split_parts(spark.range(10), 4, "id").groupBy("part").count().collect()}
    assert parts == {1: 3, 2: 3, 3: 2, 4: 2}


def test_wheat_parts_round_trip(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (42, 184873787), (43, 1)], "part int, pos int")
    there = coordinates.to_chromosome(df)
    assert rows(there.select("part", "chromosome", "chrom_pos"), "part") == [(1, "chr1A", 5), (2, "chr1A", 471304010), (42, "chr7D", 638686055)]
    back = coordinates.to_part(there.select("chromosome", "chrom_pos"))
    assert rows(back.select("part", "part_pos"), "part") == [(1, 5), (2, 5), (42, 184873787)]
    assert coordinates.subgenome(spark, "D").count() == 14


def test_fragment_size_by_hand(spark):
    cols = "chrom_f int, start_pos_f int, end_pos_f int, strand_f int, chrom_b int, start_pos_b int, end_pos_b int, strand_b int"
    cases = [((1, 10, 20, 1, 1, 50, 60, 0), 50), ((1, 50, 60, 0, 1, 10, 20, 1), 50), ((1, 10, 20, 0, 1, 50, 60, 1), -1), ((1, 10, 20, 1, 1, 50, 60, 1), -1), ((1, 10, 20, 1, 2, 50, 60, 0), -1), ((1, 10, 20, 1, None, None, None, None), -1)]
    df = spark.createDataFrame([c[0] for c in cases], cols)
    assert [r.fragment_size for r in alignments.fragment_size(df).collect()] == [c[1] for c in cases]


def test_retrieved_genotypes_match_plain_loops(spark):
    rng = random.Random(17)
    tag = lambda: "".join(rng.choice("ACGT") for _ in range(96))
    library = {f"l{i}": (tag(), tag()) for i in range(8)}
    library["l8"] = (library["l0"][0][:40] + ("A" if library["l0"][0][40] != "A" else "C") + library["l0"][0][41:], library["l0"][1])
    alleles = []
    for n, (name, (one, two)) in enumerate(library.items()):
        alleles.append((name, 1, 41, one[40], 1, n % 4 if n < 8 else 0, one[40]))
        alleles.append((name, 2, 5, two[4], 2, n % 3, two[4]))
    samples = []
    for n in range(60):
        pair = [list(x) for x in library[f"l{rng.randrange(9)}"]]
        for _ in range(rng.randrange(6)):
            end, at = rng.randrange(2), rng.choice([*range(16, 48), 3])
            pair[end][at] = rng.choice("ACGT")
        samples.append((f"s{n % 5}", f"q{n}", "".join(pair[0]), "".join(pair[1]), 96, 96, rng.randrange(1, 9)))
    sites = [(1, p, "A") for p in range(4)] + [(2, p, "G") for p in range(3)]
    differ = lambda a, b: sum(x != y for x, y in zip(a[0] + a[1], b[0] + b[1], strict=True))
    chunks = lambda t: {x[i : i + 16] for x in t for i in range(0, 96, 16)}
    depth = {}
    for sample, _, one, two, *_, reads in samples:
        own = (one, two)
        near = {k: differ(own, v) for k, v in library.items() if one[8:14] == v[0][8:14] and chunks(own) & chunks(v)}
        best = sorted(k for k, d in near.items() if d == min(near.values()) and d <= gbs.MOST_RETRIEVED)
        agree = [k for k in best if all(own[e - 1][p - 1] == b for k2, e, p, b, *_ in alleles if k2 == k)]
        for k2, _, _, _, chrom, pos, allele in alleles:
            if agree and k2 == agree[0]:
                depth[sample, chrom, pos, allele] = depth.get((sample, chrom, pos, allele), 0) + reads
    want = {}
    for chrom, pos, ref in sites:
        total = {}
        for (_, c, p, allele), n in depth.items():
            if (c, p) == (chrom, pos) and allele != ref:
                total[allele] = total.get(allele, 0) + n
        if total:
            shown = [ref, *sorted(total, key=lambda a: (-total[a], a))[:2]]
            each = [[n for (_, c, p, a), n in depth.items() if (c, p, a) == (chrom, pos, x)] for x in shown] + [[]] * (3 - len(shown))
            want[chrom, pos] = (sum(map(sum, each)), ",".join(str(sum(x)) for x in each), ",".join(str(len(x)) for x in each))
    frames = (
        spark.createDataFrame(samples, "sample string, id string, tag_r1 string, tag_r2 string, r1_len int, r2_len int, read_count int"),
        spark.createDataFrame([(k, *v, 96, 96) for k, v in library.items()], "id string, tag_r1 string, tag_r2 string, r1_len int, r2_len int"),
        spark.createDataFrame(alleles, "library_id string, end int, read_pos int, base string, chrom int, pos int, allele string"),
        spark.createDataFrame(sites, "chrom int, pos int, ref string"),
    )
    got = {(r.chrom, r.pos): (r.dp, r.ad, r.ap) for r in gbs.retrieve(*frames).collect()}
    assert len(want) > 3 and got == want
