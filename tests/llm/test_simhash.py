import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqloom.llm.simhash import _list_edges, keep_one_per_group, simhash_groups


def plain_fingerprint(text):
    """The definition, a bit at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {k: k for k in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min(parent[b] for b in ids if bin(prints[a] ^ prints[b]).count("1") <= 4)
            if low < parent[a]:
                parent[a], changed = low, True
    return parent


def test_matches_brute_force_on_copies_near_copies_and_odd_texts(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = {}
    for base in range(12):
        original = [rng.choice(words) for _ in range(300)]
        for copy in range(6):
            text = list(original)
            for _ in range(copy // 2):
                text[rng.randrange(300)] = rng.choice(words)
            texts[len(texts) + 100] = ("\x0b" if copy % 2 else " ").join(text)
    texts |= {1: "", 2: None, 3: "one two three", 4: "ONE two\x0cthree", 5: "  \t", 6: "É é É"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id bigint, text string")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash_groups(df).collect()}
    prints = {k: plain_fingerprint(v) for k, v in texts.items()}
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == plain_components(prints)
    assert got[3] == got[4][:1] + (3,) and got[1][1] == got[5][1] == 1


def test_long_posting_lists_are_parted_without_losing_links(spark):
    """Fingerprints that crowd into few lists, walked a few bits at a time, with lists of over three parted."""
    from seqloom.llm import simhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    prints = set(base.tolist())
    while len(prints) < 400:
        start = int(rng.choice(base))
        for bit in rng.choice(20, int(rng.integers(1, 9)), replace=False).tolist():
            start ^= 1 << (3 * bit)
        prints.add(start)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint").repartition(3)
    postings = df.mapInArrow(simhash._postings, "key bigint, fp bigint")
    found = simhash._searched(postings, 3).cache()
    long = found.where("b is null")
    assert long.count() > 400
    again = simhash._searched(long.select("a", "key").mapInArrow(simhash._parted, "key bigint, fp bigint"), simhash._ALL)
    edges = found.where("b is not null").union(again).select("a", "b").collect()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = plain_components_of(near)
    place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    got = np.eye(len(prints), dtype=bool)
    for a, b in edges:
        got[place[a], place[b]] = got[place[b], place[a]] = True
    assert (plain_components_of(got) == want).all() and len(set(want.tolist())) > 1


def plain_components_of(near):
    low = np.arange(len(near))
    while True:
        new = np.where(near, low[None, :], len(near)).min(axis=1)
        if (new == low).all():
            return low
        low = new


def test_groups_are_the_same_whatever_the_longest_list(spark):
    words = ["w%d" % i for i in range(300)]
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(words)), F.concat(F.lit("x"), F.col("id") % 90)).alias("text"))
    rows = simhash_groups(df, longest_list=3).collect()
    assert {r.id: r.component for r in rows} == plain_components({r.id: r.fp & (2**64 - 1) for r in rows})


def test_posting_list_search_finds_chains_and_bounded_degrees():
    rng = np.random.default_rng(1)
    base = np.uint64(0x0123456789ABCDEF)
    chain = [base]
    for bit in range(12):
        chain.append(chain[-1] ^ np.uint64(1 << bit) ^ np.uint64(1 << (bit + 16)))
    far = rng.integers(0, 2**63, 50).astype(np.uint64)
    members = np.concatenate((np.array(chain, np.uint64), far))
    a, b = _list_edges(rng.permutation(members))
    parent = {int(m): int(m) for m in members}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[top(x)] = top(y)
    for x in members.tolist():
        for y in members.tolist():
            if bin(x ^ y).count("1") <= 4:
                assert top(x) == top(y)
    assert max(np.bincount(np.unique(np.concatenate((a, b)), return_inverse=True)[1]), default=0) <= 33


def test_odd_rows_and_empty_table(docs, no_docs):
    rows = simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component for r in rows if r.fp == 0} == {3}
    null = [r for r in rows if r.id is None]
    assert len(null) == 1 and null[0].component == 1
    assert simhash_groups(no_docs).collect() == []


def test_keeps_one_document_of_a_group_with_all_columns(docs):
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(plain_components(prints).values()))
    assert ids.count(7) == 1 and ids.count(None) == 1 and 4 not in ids and 10 not in ids


def test_one_large_group_of_near_copies(spark):
    words = ["w%d" % i for i in range(400)]
    df = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(" ".join(words)), F.concat(F.lit("x"), F.col("id") % 200)).alias("text")
    )
    rows = simhash_groups(df).collect()
    prints = {r.id: r.fp & (2**64 - 1) for r in rows}
    assert {r.id: r.component for r in rows} == plain_components(prints)


def test_components_of_a_long_shuffled_chain_settle(spark, monkeypatch):
    from seqloom.llm import components

    rounds = []
    monkeypatch.setattr(components, "write_table", lambda df, what, f=components.write_table: (rounds.append(what), f(df, what))[1])
    ids = np.random.default_rng(1).permutation(3_000).tolist()
    edges = [*zip(ids, ids[1:], strict=False), (5_000, 5_001), (5_001, 5_000), (6_000, 6_000)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(3_000), 0) | {5_000: 5_000, 5_001: 5_000}
    assert rounds.count("cc-hooked") <= 20


def test_rows_that_share_an_id_keep_a_row_of_each_group(spark, docs):
    from seqloom.llm.simhash import keep_one_per_group

    words = [f"w{i}" for i in range(300)]
    one, two, three = (" ".join(words[a : a + 90]) for a in (0, 100, 200))
    rows = [(1, one, "b"), (1, one, "a"), (1, two, "a"), (2, two, "a"), (3, three, "a"), (3, three, "a"), (None, one, "a"), (4, one, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for n in (1, 7):
        got = sorted((tuple(r) for r in keep_one_per_group(df.repartition(n)).collect()), key=repr)
        assert got == sorted([(1, one, "a"), (1, two, "a"), (3, three, "a"), (None, one, "a")], key=repr)
    assert {r.doc_id for r in keep_one_per_group(docs).collect()} >= {1, 3, 7, None}
