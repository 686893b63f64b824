import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import language as lid
from seqloom.llm.language import identify
from seqloom.llm.queries import language_of_pages

WORDS = {
    "en": "the house that they have built for people of town and it was good with many windows",
    "de": "das haus welches die leute der stadt gebaut haben und es war gut für alle straßen",
    "fr": "la maison que les gens de la ville ont construite était bonne pour tous les enfants",
    "es": "la casa que la gente de la ciudad construyó era buena para todos los niños pequeños",
}


def buckets(text):
    text = "".join(" " * len(c.encode()) if any(a <= ord(c) <= b for a, b in lid.SIGNS) else c for c in text)
    raw = [b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in text.encode()]
    padded = [32, *raw, 32]
    return [((padded[i - 1] << 16 | padded[i] << 8 | padded[i + 1]) * 2654435761 % 2**32) >> 18 for i in range(1, len(padded) - 1) if padded[i] != 32]


def plainly(rows):
    """(language, posterior, letters, accepted) of (text, declared, address) rows by loops over dictionaries."""
    languages = lid.LANGUAGES
    tag = lambda said: (m := re.match(r"\s*([A-Za-z]+)", said or "")) and m[1].lower() or ""
    host = lambda address: re.sub(r":\d*$", "", re.match(r"(?:.*?://)?([^/?#]*)", (address or "").lower())[1])
    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else ""
    held = {x: {} for x in languages}
    counts, by_suffix, every = {}, {}, dict.fromkeys(languages, 0)
    for text, said, address in rows:
        if tag(said) in languages:
            for b in set(buckets(text or "")):
                held[tag(said)][b] = held[tag(said)].get(b, 0) + 1
            for table, key in ((counts, host(address)), (by_suffix, suffix(host(address)))):
                table.setdefault(key, dict.fromkeys(languages, 0))[tag(said)] += 1
            every[tag(said)] += 1
    total = sum(every.values())
    smooth = lambda own, above: {x: (own[x] + lid.PRIOR_ROWS * above[x]) / (sum(own.values()) + lid.PRIOR_ROWS) for x in languages}
    overall = {x: (every[x] + lid.PRIOR_ROWS / len(languages)) / (total + lid.PRIOR_ROWS) for x in languages}
    out = []
    for text, said, address in rows:
        found = buckets(text or "")
        weight = min(len(found), lid.MOST_EVIDENCE) / max(len(found), 1)
        h = host(address)
        others = {x: counts[h][x] - (x == tag(said)) for x in languages} if h in counts else {}
        prior = smooth(others, smooth(by_suffix[suffix(h)], overall)) if h in counts else overall
        sums = {}
        for x in (*languages, lid.UNKNOWN):
            if x == lid.UNKNOWN:
                chance = [-math.log(lid.BUCKETS)] * len(found)
            else:
                size = sum(held[x].values())
                chance = [math.log((held[x].get(b, 0) + 0.5) / (size + 0.5 * lid.BUCKETS)) - (3 if size == 0 else 0) for b in found]
            sums[x] = weight * sum(chance) + math.log(lid.UNKNOWN_PRIOR if x == lid.UNKNOWN else prior[x] * (1 - lid.UNKNOWN_PRIOR))
            for told, right in ((tag(said), lid.DECLARED_RIGHT), (lid.SUFFIX_LANGUAGE.get(suffix(h)), lid.SUFFIX_RIGHT)):
                if told in languages:
                    sums[x] += math.log(right if x == told else (1 - right) / len(languages))
        best = max(sums, key=sums.get)
        posterior = 1 / sum(math.exp(v - sums[best]) for v in sums.values())
        out.append((best, posterior, len(found), bool(found) and best != lid.UNKNOWN and posterior >= lid.ACCEPT))
    return out


def rows():
    rng = np.random.default_rng(12)
    out = []
    for i in range(160):
        true = str(rng.choice([x for x in WORDS if x in lid.LANGUAGES]))
        said = true if rng.random() < 0.8 else str(rng.choice([*WORDS, "EN-us", "xx", ""]))
        words = WORDS[true].split()
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)))) + (" 日本語 12!" if i % 9 == 0 else "")
        address = f"{'https://' if i % 2 else ''}H{int(rng.integers(0, 12))}.example.{rng.choice(['de', 'uk', 'fr', 'com'])}{':80/x?y' if i % 3 == 0 else ''}"
        out.append((text, said or None, address if i % 11 else None))
    return [*out, (None, "en", "h1.example.de"), ("", None, ""), ("Это русский текст", "ru", "a.b"), ("\U0001f600 \u3000\u2014 \xbf\xab", "en", "h1.example.de"), ("\xbfla casa? \u2018no\u2019 \U0001f600x", "es", "one.uk"), out[0], out[0]]


def same(got, want):
    assert (got[0], got[2], got[3]) == (want[0], want[2], want[3]) and got[1] == pytest.approx(want[1], abs=2e-3), (got, want)


def test_posteriors_match_plain_loops(spark):
    data = rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id int, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r.lid for r in identify(df, F.col("text"), F.col("lang"), F.col("source")).collect()}
    for i, want in enumerate(plainly(data)):
        same((got[i].language, got[i].posterior, got[i].letters, got[i].accepted), want)


def test_pages_have_their_tag_and_url(spark, tmp_path):
    data = rows()
    pages = [(i, a, f"<html x lang='{said or ''}'><script>ignored words</script><p>{text or ''}</p></html>" if i % 5 else text) for i, (text, said, a) in enumerate(data)]
    spark.createDataFrame(pages, "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    seen = []
    for _, url, html in pages:
        said = re.search(r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", html or "")
        seen.append((re.sub(r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>", " ", html or ""), said and said[1], url))
    got = {r.page_id: r for r in language_of_pages(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages)
    for i, want in enumerate(plainly(seen)):
        same((got[i].language, got[i].posterior, want[2], got[i].kept), want)


def test_a_wrong_tag_on_a_host_of_its_own_does_not_support_itself(spark):
    data = [(WORDS["de"], "de", "a.de"), (WORDS["en"], "en", "b.uk")] * 30
    df = spark.createDataFrame([*data, ("das haus", "en", "lone.com"), ("das haus", "", "other.com")], "text string, lang string, source string")
    priors = lid.host_priors(df, F.col("source"), F.col("lang"), lid.LANGUAGES)[0].where("host = 'lone.com'").first()
    got = df.limit(1).select(lid._without_own(F.array(*map(F.lit, priors.counts)), F.array(*map(F.lit, priors.above)), F.lit("en"), lid.LANGUAGES).alias("p")).first()
    assert got.p == pytest.approx(priors.above)


def test_signs_alone_are_no_letters(spark):
    rows = [("\U0001f600\U0001f600", "en", "b.uk"), ("\u3000\u3000", "en", "b.uk"), (WORDS["en"], "en", "b.uk")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted((r.lid.letters, r.lid.accepted) for r in identify(df, F.col("text"), F.col("lang"), F.col("source")).collect())[:2] == [(0, False)] * 2
