from itertools import product

import numpy as np
import pytest

from seqloom.llm import negatives
from seqloom.llm.negatives import _NONE, _product, _top, hard_negatives, hilbert_keys, needed

SCHEMA = "vec_id bigint, embedding array<float>, label int, tile int, rank int, anchor string"


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (2, 1)])
def test_neighbours_on_the_curve_are_one_step_apart(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    walked = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def plain(rows, every=100, positives=5, negatives=10):
    """The contract by loops over all pairs."""
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        code = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if sum(c * c for c in code) >= 1 << 56:
            continue
        entry = (label, np.array(code, np.int32).tobytes(), code)
        kept[i] = min(kept.get(i, entry), entry)
    out = []
    for a, (label, _, v) in kept.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, (other, _, w) in kept.items() if i != a and len(w) == len(v)]
        scores.sort()
        for s, p, _ in [x for x in scores if x[2]][:positives]:
            hard = [(t, n) for t, n, same in scores if not same and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def some_rows(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) / 2).astype(float).tolist(), int(rng.integers(4)), 1, 1, "x") for i in range(n)]
    rows += [(n + i, rows[3][1], 2, 1, 1, "x") for i in range(300)]  # one vector in many rows: ties everywhere
    rows += [rows[100], rows[100]]
    rows += [(200, rows[7][1], 3, 1, 1, "x")]  # an id that two unlike rows share
    rows += [(None, rows[0][1], 1, 1, 1, "x"), (n + 400, None, 1, 1, 1, "x"), (n + 500, rows[0][1], None, 1, 1, "x")]
    rows += [(n + 600, [1.0, None] * 4, 1, 1, 1, "x"), (n + 700, [float("nan")] * 8, 1, 1, 1, "x"), (n + 800, [float("inf")] * 8, 1, 1, 1, "x")]
    rows += [(100_000 + 100 * i, [0.5 * i, 1.0, -2.0], i % 2, 1, 1, "x") for i in range(9)]  # vectors of another length
    rows += [(200_000, [], 1, 1, 1, "x"), (200_001, [], 1, 1, 1, "x"), (200_002, [], 2, 1, 1, "x"), (300_000, [3e38] * 8, 1, 1, 1, "x")]
    rows += [(400_000, [-60000.0] * 8, 0, 1, 1, "x"), (400_001, [-50000.0] * 8, 0, 1, 1, "x"), (400_002, [-30000.0] * 8, 1, 1, 1, "x")]
    return rows


def test_equals_all_pairs(spark):
    rows = some_rows(1500)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["anchor", "positive", "rank", "negative", "positive_score", "negative_score"]
    want = plain(rows)
    assert len(want) > 300
    assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_tables_and_single_labels(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(i, [1.0, float(i)], 1, 1, 1, "x") for i in range(0, 300, 50)]
    assert hard_negatives(spark.createDataFrame(one, SCHEMA)).collect() == []


def test_bounds_hold_and_leave_blocks_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, size=(40, 16))
    blocks = [c + rng.integers(-20, 20, size=(64, 16)) for c in centres]
    low, high = np.array([b.min(axis=0) for b in blocks]), np.array([b.max(axis=0) for b in blocks])
    anchors = np.array([b[0] for b in blocks])
    zones = (np.zeros(40, np.int64), np.full(40, 9), np.arange(40) * 64)
    scores = np.array([[(b @ a) for b in blocks] for a in anchors])
    best = np.sort(scores.reshape(40, -1), axis=1)[:, -5]
    window = lambda lo, hi, kth: [np.array(x)[:, None] for x in (lo, hi, kth, [0] * 40)]
    need, upper = needed(anchors, np.ones(40, np.int64), window([_NONE] * 40, [1 << 61] * 40, best), low, high, zones, True)
    assert (upper >= scores.max(axis=2)).all()
    assert need[scores.max(axis=2) > best[:, None]].all()
    assert need.mean() < 0.2
    at_most = (0.9 * best).astype(int)
    at_least = (0.3 * best).astype(int)
    need, _ = needed(anchors, np.ones(40, np.int64), window(at_least, at_most, [_NONE] * 40), low, high, zones, False)
    met = ((scores >= at_least[:, None, None]) & (scores <= at_most[:, None, None])).any(axis=2)
    assert need[met].all()
    assert not need.all()
    own = (np.ones(40, np.int64), np.ones(40, np.int64), zones[2])
    assert not needed(anchors, np.ones(40, np.int64), window(at_least, at_most, [_NONE] * 40), low, high, own, False)[0].any()


def test_products_of_large_numbers_are_exact():
    a = np.array([[(1 << 27) + 1, -3], [5, 7]])
    assert _product(a, a).tolist() == [[int(x) * int(u) + int(y) * int(v) for u, v in a.tolist()] for x, y in a.tolist()]
    ids = np.array([9, 4, 7, 1])
    assert ids[_top(np.array([5, 8, 8, 1]), ids, 2)].tolist() == [4, 7]
    assert negatives.GROUP_BLOCKS == 64
