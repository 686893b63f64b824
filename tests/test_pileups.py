import random

from seqloom.operators import alignments
from seqloom.operators.discovery import pileup_allele_counts


def test_rows_alike_and_others(spark):
    rows = [(1, ".,.,"), (2, None), (3, ""), (4, ".A,+2AC^I."), (5, "*$")]
    got = {r.id: (r.counts, r.ref_n, r.ins_lens, r.del_lens, r.indel_seqs) for r in pileup_allele_counts(spark.createDataFrame(rows, "id int, bases string")).collect()}
    none = [0] * 6
    assert got == {1: (none, 4, [], [], []), 2: (none, 0, [], [], []), 3: (none, 0, [], [], []), 4: ([1, 0, 0, 0, 0, 1], 3, [2], [], ["IAC"]), 5: (none, 0, [], [], [])}


def test_alleles_of_reads_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignments, "STRETCH", 50)
    monkeypatch.setattr(alignments, "MOST_READS", 20)
    rng = random.Random(7)
    reads = []
    for i in range(300):
        n = rng.choice((10, 30, 120))
        cut = rng.randrange(1, n)
        cigar = rng.choice((f"{n}M", f"{cut}M2D{n - cut}M", f"{cut}M3I{n - cut}M", f"2S{n - 2}M", "*"))
        size = n + (3 if "I" in cigar else 0)
        reads.append((f"q{i % 250}", rng.choice((1, 1, 1, 2)), rng.randrange(1, 300), cigar, "".join(rng.choice("ACGT") for _ in range(size)), rng.choice((0, 16)), rng.choice((20, 60))))
    snps = [(c, p, rng.choice("ACGT"), rng.choice(("A,C", "I", "D,T", "G"))) for c in (1, 2, 3) for p in rng.sample(range(1, 450), 60)]
    want = []
    for query, chrom, start, cigar, seq, flag, mapq in reads:
        if cigar == "*" or mapq < alignments.MIN_MAPQ:
            continue
        end = start + sum(int(n) for n, op in alignments._CIGAR.findall(cigar) if op in "MDN=X")
        over = sorted((p, r, a) for c, p, r, a in snps if c == chrom and start <= p < end)
        want += [(query, chrom, *found) for found in alignments.walk_alleles(start, cigar, seq, bool(flag & 16), over)]
    df = spark.createDataFrame(reads, "query string, chrom int, start_pos int, cigar string, seq string, flag int, mapq int")
    got = alignments.read_alleles(df.repartition(3), spark.createDataFrame(snps, "chrom int, pos int, ref string, alts string"))
    assert len(want) > 500 and sorted(tuple(r) for r in got.collect()) == sorted(want)
