import random
import statistics

import pytest

from seqloom.operators import depth, ranges, sequences


@pytest.mark.parametrize(("size", "step"), [(20, 10), (25, 10), (7, 9)])
def test_covered_positions_equal_plain_loops(spark, monkeypatch, size, step):
    monkeypatch.setattr(ranges, "STRETCH", 5)
    rng = random.Random(size)
    rows = [(c, a, a + rng.randrange(-1, 60), 1.0) for c in (1, 2) for a in (rng.randrange(1, 900) for _ in range(60))] + [(1, 1, 5000, 1.0), (1, 950, 950, 1.0), (3, 1, 9, 1.0)]
    lengths = spark.createDataFrame([(1, 1000), (2, 300), (4, 50)], "chrom int, chrom_len int")
    windows = ranges.make_windows(lengths, size, step)
    got = ranges.window_coverage(spark.createDataFrame(rows, "chrom int, start_pos int, end_pos int, value double"), windows, size, step)
    want = [(w.chrom, w.win_start, w.win_end, sum(max(0, min(e, w.win_end) - max(s, w.win_start)) for c, s, e, _ in rows if c == w.chrom and s < e)) for w in windows.collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    none = ranges.window_coverage(spark.createDataFrame([], "chrom int, start_pos int, end_pos int"), windows, size, step)
    assert {r.covered for r in none.collect()} == {0} and none.count() == windows.count()


def test_a_range_over_a_chromosome_makes_few_rows(spark):
    one = spark.createDataFrame([(1, 1, 2_000_000_000)], "chrom int, start_pos int, end_pos int")
    windows = spark.createDataFrame([(1, 1_000_001, 1_000_101)], "chrom int, win_start int, win_end int")
    assert ranges.window_coverage(one, windows, 100, 100).first().covered == 100


def test_depth_profile_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(depth, "BLOCK", 10)
    rng = random.Random(3)
    rows = [(f"T{rng.randrange(4)}", rng.choice((1, 2)), rng.randrange(-3, 45), rng.randrange(9)) for _ in range(90)]
    lengths = spark.createDataFrame([(1, 37), (2, 20), (3, 11), (4, 0)], "chrom int, chrom_len int")
    taxa = spark.createDataFrame([(f"T{i}",) for i in range(3)], "taxon string")
    got = {(r.chrom, r.pos): (r["mean"], r.sd) for r in depth.pop_depth(spark.createDataFrame(rows, "taxon string, chrom int, pos int, depth int"), taxa, lengths).collect()}
    assert sorted(got) == [(c, p) for c, n in ((1, 37), (2, 20), (3, 11)) for p in range(1, n + 1)]
    for (chrom, pos), (mean, sd) in got.items():
        each = [sum(d for t, c, p, d in rows if (t, c, p) == (f"T{i}", chrom, pos)) for i in range(3)]
        assert abs(mean - statistics.mean(each)) < 1e-6 and abs(sd - statistics.stdev(each)) < 1e-6


@pytest.mark.parametrize("lengths", [[5], [0], [0, 0], [3, 3, 3, 3], [1, 2, 4, 8, 1025, 1024, 1023], [7000, 6999, 5000, 4999, 4998], []])
def test_assembly_statistics_equal_plain_sums(spark, lengths):
    got = sequences.assembly_stats(spark.createDataFrame([(i, "A" * n) for i, n in enumerate(lengths)], "seq_id int, seq string")).first()
    upto, n50, l50 = 0, None, None
    for k, n in enumerate(sorted(lengths, reverse=True), 1):
        upto += n
        if upto > sum(lengths) // 2 and n50 is None:
            n50, l50 = n, k
    assert tuple(got) == (len(lengths), sum(lengths) if lengths else None, n50, l50)
