import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.operators import nearest_tags
from seqloom.operators.nearest_tags import _words, differing, match_tags, packed_tags, segment_keys

SCHEMA = "id string, tag_r1 string, tag_r2 string, r1_len int, r2_len int"


def pieces(tag):
    return {tag[e][16 * i : 16 * i + 16] for e, n in ((1, tag[3]), (2, tag[4])) for i in range(n // 16)}


def plain(query, library, max_diff, most_tags=None):
    often = {}
    for tag in library:
        for p in pieces(tag):
            often[tag[1][8:14], p] = often.get((tag[1][8:14], p), 0) + 1
    out = []
    for q in query:
        near = {}
        for tag in library:
            shared = {p for p in pieces(q) & pieces(tag) if most_tags is None or often[tag[1][8:14], p] <= most_tags}
            if q[1][8:14] == tag[1][8:14] and shared:
                diff = sum(x != y for x, y in zip(q[1] + q[2], tag[1] + tag[2], strict=True))
                if diff <= max_diff:
                    near[tag[0]] = diff
        out += [(q[0], k, d) for k, d in near.items() if d == min(near.values())]
    return sorted(out)


def some(n, seed):
    """Tags of few groups, many short, so that most of their bases are padding and one piece is in most of them."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    starts, common = [word(16) for _ in range(2)], word(16)
    library = []
    for i in range(n):
        one, two = rng.choice(starts) + word(rng.choice((4, 30, 80))), common + word(rng.choice((2, 20, 80)))
        library.append((f"l{i}", one.ljust(96, "A"), two.ljust(96, "A"), len(one), len(two)))
    query = []
    for i in range(60):
        _, one, two, a, b = rng.choice(library)
        for _ in range(rng.randrange(9)):
            at = rng.choice([*range(8), *range(14, 96)])
            one, two = (one[:at] + rng.choice("ACGTN") + one[at + 1 :], two) if rng.random() < 0.5 else (one, two[:at] + rng.choice("ACGT") + two[at + 1 :])
        query.append((f"q{i}", one, two, a, b))
    return query, library


@pytest.mark.parametrize(("longest", "max_diff"), [(4096, 7), (20, 7), (20, 3)])
def test_equals_all_pairs(spark, monkeypatch, longest, max_diff):
    monkeypatch.setattr(nearest_tags, "LONGEST_LIST", longest)
    monkeypatch.setattr(nearest_tags, "BUCKET_POSTINGS", 2000)
    query, library = some(700, 11)
    got = match_tags(spark.createDataFrame(query, SCHEMA), spark.createDataFrame(library, SCHEMA), max_diff)
    want = plain(query, library, max_diff)
    assert len(want) > 20
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_piece_in_thousands_of_tags_hides_none(spark):
    query, library = some(5000, 12)
    query = query[:20]
    frames = [spark.createDataFrame(x, SCHEMA) for x in (query, library)]
    want = plain(query, library, 7)
    assert sorted(tuple(r) for r in match_tags(*frames).collect()) == want
    cut = plain(query, library, 7, 1000)
    assert sorted(tuple(r) for r in match_tags(*frames, most_tags=1000).collect()) == cut
    assert len(cut) < len(want)


def test_nulls_repeats_and_empty_tables(spark):
    query, library = some(30, 13)
    none = spark.createDataFrame([], SCHEMA)
    frames = [spark.createDataFrame([*x, (None, *x[0][1:]), x[1], (x[2][0], *x[2][1:3], 3, 3)], SCHEMA) for x in (query, library)]
    assert sorted(tuple(r) for r in match_tags(*frames).collect()) == plain(query, library, 7)
    assert match_tags(none, frames[1]).collect() == match_tags(frames[0], none).collect() == []


def test_packed_words_and_keys():
    a, b = packed_tags(pa.array(["ACGTN" + "A" * 187])), packed_tags(pa.array(["ACGAR" + "A" * 187]))
    assert differing(_words(a), _words(b)).tolist() == [2]
    keys = [segment_keys(x, 9)[0] for x in (a, b)]
    assert [i for i in range(9) if keys[0][i] != keys[1][i]] == [3, 4]
    assert len(np.unique(keys[0])) == 9
