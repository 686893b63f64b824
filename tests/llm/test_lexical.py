import math
import re
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import lexical
from seqloom.llm.lexical import Lists, _best, ranked, terms_of

DOCS = "doc_id bigint, text string, id int, item bigint, n int, terms string"
ITEMS = "item_id bigint, text string, term string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, top=10):
    texts = [(i, Counter(cut(t))) for i, t, *_ in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in texts:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(400)] + ["naïve", "日本", "ÉTÉ", "Été", "x y", "a_b", "A1"])
    share = 1 / np.arange(1, len(words) + 1)
    docs = []
    for i in range(600):
        n = int(rng.integers(0, 120))
        docs.append((i, " ".join(rng.choice(words, n, p=share / share.sum())), 1, 1, 1, "x"))
    docs += [(700 + i, docs[5][1], 1, 1, 1, "x") for i in range(200)]  # equal scores by the hundred
    docs += [docs[9], docs[9], (9, "w1 w2 w3 other", 1, 1, 1, "x"), (None, docs[5][1], 1, 1, 1, "x"), (None, None, 1, 1, 1, "x"), (5000, None, 1, 1, 1, "x")]
    docs += [(6000, "W7, " * 50_000, 1, 1, 1, "x"), (6001, "z" * 100_000, 1, 1, 1, "x"), (6002, "\x00\x7f-- ", 1, 1, 1, "x")]
    items = [(i, " ".join(rng.choice(words, 12)), "t") for i in range(30)]
    items += [(3, "w399 w398", "t"), (90, None, "t"), (91, "", "t"), (92, "nowhere", "t"), (None, "w5 W5 w6", "t"), (93, "w0", "t"), (94, docs[5][1], "t"), (95, "z" * 100_000, "t")]
    return docs, items


def test_equals_all_scores(spark, tables):
    docs, items = tables
    got = ranked(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item", "rank", "doc", "score"]
    want = plain(docs, items)
    assert sum(r[0] == 93 for r in want) == 10
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_tables(spark, tables):
    docs, items = tables
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert ranked(none, spark.createDataFrame(items, ITEMS)).collect() == []
    assert ranked(spark.createDataFrame(docs[:20], DOCS), no_items).collect() == []


def test_items_in_batches(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(lexical, "MOST_TERMS", 150)
    got = ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, items)


def test_terms_in_stretches(monkeypatch):
    text = "Ab c-dé_1 " * 30 + "x" * 70 + " End日"
    whole = [t.encode() for t in cut(text)]
    for size in (3, 16, 64, 1000):
        monkeypatch.setattr(lexical, "_STRETCH", size)
        parts = list(terms_of(text.encode()))
        assert [t for p in parts for t in p] == whole
        assert size > 500 or len(parts) > 1


def test_search_stops_early_and_finds_all():
    rng = np.random.default_rng(4)
    n, terms = 4000, 5
    doc, term, impact = [], [], []
    for t in range(terms):
        own = rng.choice(n, 3000, replace=False)
        doc.append(own)
        term.append(np.full(3000, t))
        impact.append((1e6 / (1 + rng.permutation(3000) // 3)).astype(np.int64))
    doc, term, impact = map(np.concatenate, (doc, term, impact))
    lists = Lists(doc, term, impact, terms)
    none = np.zeros(0, np.int64)
    shorter = 0
    for asked in ([0], [1, 2], [0, 1, 2, 3, 4]):
        whole = np.zeros(n, np.int64)
        keep = np.isin(term, asked)
        np.add.at(whole, doc[keep], impact[keep])
        met, score, read = lists.search(np.array(asked), 10, (none, none))
        assert (whole[met] == score).all()
        best = met[_best(met, score, 10)]
        assert best.tolist() == _best(np.arange(n), whole, 10).tolist()
        shorter += read < keep.sum() / 2
        kth = whole[best[-1]]
        _, _, again = lists.search(np.array(asked), 10, (best, whole[best] + 1))
        assert again <= read
        assert lists.search(np.array(asked), 10, (best, np.full(10, 10**9)))[2] == 0
        assert kth > 0
    assert shorter == 3


def test_ties_at_the_last_place_are_all_met():
    doc, term = np.arange(500), np.zeros(500, np.int64)
    lists = Lists(doc, term, np.full(500, 7), 1)
    none = np.zeros(0, np.int64)
    met, score, _ = lists.search(np.array([0]), 10, (none, none))
    assert met[_best(met, score, 10)].tolist() == list(range(10))
    assert len(met) == 500
