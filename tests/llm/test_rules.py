import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.llm import rules
from seqloom.llm.rules import distance, measure, quality_rules, references, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WORDS = {
    "en": "the of and to in a is that it for was on as with be by at from his her they this have not are but had which one all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß sie nach".split(),
}


def prose(rng, lang, n):
    share = 1 / np.arange(1, 31)
    out = []
    for _ in range(n):
        out.append(str(rng.choice(WORDS[lang], p=share / share.sum())) if rng.random() < 0.5 else "".join(rng.choice(list("abdeilmnorstu"), int(rng.integers(3, 10)))))
    text = " ".join(out)
    return text[0].upper() + re.sub(r" (\w+) (\w+) (\w+) (\w+)\b", r" \1 \2 \3, \4.", text[1:], count=n // 12)


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def kind(c):
    if c in " \t\n\v\f\r":
        return 3
    for i, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (4, ".,;:!?'\"-()"), (5, "#*$%&|<>")):
        if c in chars:
            return i
    return 6 if ord(c) < 128 else 7


def plain_distance(p, q):
    total = 0
    for a, b in zip(np.array(p) / sum(p), np.array(q) / sum(q), strict=True):
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
    return math.sqrt(max(total, 0))


def plain_verdicts(rows):
    """The docstring by loops, with fractions for shares."""
    long = [(lang or "", t) for _, t, lang, *_ in rows if t and len(WORD.findall(t)) >= 50]
    chars, words, n = defaultdict(lambda: np.zeros(8)), defaultdict(Counter), Counter()
    for lang, t in long:
        n[lang] += 1
        own = np.bincount([kind(c) for c in t], minlength=8)
        chars[lang] += own / own.sum()
        found = WORD.findall(t)
        for w, k in Counter(found).items():
            words[lang][w] += k / len(found)
    top = {lang: sorted(words[lang].items(), key=lambda x: (-round(x[1], 9), x[0].encode()))[:32] for lang in n if n[lang] * 1000 >= len(long)}
    out = []
    for _, t, *_ in rows:
        counts = plain_counts(t)
        good, nearest = not top, []
        for lang in sorted(top):
            t = t or ""
            found = Counter(WORD.findall(t))
            own = np.bincount([kind(c) for c in t], minlength=8)
            hist = [found[w] for w, _ in top[lang]]
            hist.append(counts[0] - sum(hist))
            ref = [s for _, s in top[lang]]
            a = plain_distance(own, chars[lang]) if t else 0
            b = plain_distance(hist, [*ref, n[lang] - sum(ref)]) if counts[0] else 0
            good |= a <= 0.20 + 2 / math.sqrt(max(len(t), 1)) and b <= 0.25 + 1.2 / math.sqrt(max(counts[0], 1))
            nearest.append((a + b, a, b))
        out.append((counts, good and not counts[-1], min(nearest, default=(0, 0, 0))[1:]))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(i, prose(rng, ("en", "de")[i % 3 == 0], int(rng.integers(50, 400))), ("en", "de")[i % 3 == 0], None) for i in range(120)]
    clean = prose(rng, "en", 200)
    out += [(200, clean.upper() + " A!", "en", None), (201, re.sub(r"(\w) ", r"\1### ", clean), "en", None), (202, " | ".join(clean.split()), "en", None)]
    out += [(203, "word " * 300, "en", None), (204, prose(rng, "de", 300), "en", None), (205, prose(rng, "en", 49), "en", None), (206, prose(rng, "en", 50), None, None)]
    out += [(207, "\n".join([clean, "line one two", " \t", "", "", clean, "line one two", "line one two"]), "en", None), (208, "a b c " * 20 + clean, "en", None)]
    out += [(None, None, None, None), (209, None, "en", None), (210, "", "de", None), (211, " \n\x0b\t", "en", None), (212, "\x1c\x85 日本 naïve " * 60, "ja", None)]
    out += [out[5], out[5], (213, clean * 60, "en", None)]
    return out


SCHEMA = "doc_id bigint, text string, lang string, kept boolean"


def test_rules_equal_plain_loops(spark, rows):
    got = quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted(((r[0], *v) for r, v in zip(rows, plain_verdicts(rows), strict=True)), key=repr)
    got = sorted(((r["id"], tuple(r[c] for c in COUNTS), r["kept"], (r["char_distance"], r["word_distance"])) for r in got), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)
    kept = {r[0]: r[2] for r in got}
    assert all(kept[i] for i in range(120) if not plain_counts(rows[i][1])[-1])
    assert not any(kept[i] for i in (200, 201, 202, 203, 205))
    assert kept[204]


def test_without_texts_or_references(spark, rows):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    short = quality_rules(spark.createDataFrame([(1, "too short", "en", None), (2, None, None, None)], SCHEMA)).collect()
    assert [(r["base_failed"], r["kept"], r["nearest"]) for r in short] == [(True, False, None)] * 2
    texts = measure(*_buffer([rows[0][1]]))
    assert rules.judge_slice(texts, [])[0].all()


def _buffer(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def test_common_words_are_exact_though_buckets_collide(spark, rows, monkeypatch):
    refs = references(spark.createDataFrame(rows, SCHEMA))
    assert [r.lang for r in refs] == ["", "de", "en", "ja"]
    counted = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        words = WORD.findall(t or "")
        if len(words) >= 50:
            for w, k in Counter(words).items():
                counted[lang or ""][w.encode()] += (1 << 20) * k // len(words)
    for ref in refs:
        assert ref.words == [w for w, _ in sorted(counted[ref.lang].items(), key=lambda x: (-x[1], x[0]))[:32]]


def test_repeats_and_distance():
    texts = measure(*_buffer(["a b c a b c", "a b c", "a a a a", "", "x y z x y w x y z"]))
    assert repeated_words(texts.row, texts.word, 5).tolist() == [6, 0, 4, 0, 6]
    assert np.isclose(distance(np.array([[1.0, 0], [1, 1], [0, 0]]), np.array([0, 2.0])), [1, plain_distance([1, 1], [0, 2]), 0]).all()
