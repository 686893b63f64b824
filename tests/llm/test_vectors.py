import numpy as np

from seqloom.llm.topk import nearest_codes, probed, sign_codes
from seqloom.llm.vectors import near_vectors, tile_links

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, key string"


def rows(n=160, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d))
    out = []
    for i in range(n):
        v = centers[i % 6] + rng.normal(size=d) * (0.02 if i % 3 else 0.4)
        out.append((i, [float(np.float32(x)) for x in v], i % 2, "n", "k"))
    return out


ODD = [(900, None, 0, "n", "k"), (901, [0.0] * 16, 0, "n", "k"), (902, [float("nan")] * 16, 0, "n", "k"), (903, [None] * 16, 0, "n", "k"), (904, [], 0, "n", "k"),
       (905, [1.0] * 16, None, "n", "k"), (906, [1.0] * 16, 0, "n", "k"), (906, [1.0] * 16, 0, "n", "k"), (907, [2.0] * 16, 0, "n", "k"), (908, [1.0] * 8, 0, "n", "k"), (None, [1.0] * 16, 0, "n", "k"),
       (909, [3e37] * 16, 0, "n", "k")]


def plain(data, threshold=0.93):
    """Degree and component by all pairs in double precision."""
    good = [(i, np.array(v), g) for i, v, g, *_ in data if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = np.zeros(len(good), int)
    low = [g[0] for g in good]
    near = [[b for b in range(len(good)) if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= threshold] for a in range(len(good))]
    for a, other in enumerate(near):
        links[a] = len(other)
    for _ in range(len(good)):
        new = [min([low[a], *(low[b] for b in near[a])]) for a in range(len(good))]
        if new == low:
            break
        low = new
    found = {}
    for a, g in enumerate(good):
        found.setdefault(g[0], (int(links[a]), low[a]))
    return found


def test_links_and_components_match_all_pairs(spark):
    data = rows() + [(500 + i, v, g, n, k) for i, (_, v, g, n, k) in enumerate(rows()[:20])] + ODD
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for tile in (32, 2048):
        got = near_vectors(df, tile=tile).collect()
        assert len(got) == len(data)
        expected = plain(data)
        for r in got:
            if r.id is None:
                assert (r.n_links, r.component, r.kept) == (0, None, None)
            else:
                links, component = expected.get(r.id, (0, r.id))
                assert (r.id, r.n_links, r.component, r.kept) == (r.id, links, component, r.id == component)


def test_blocks_of_large_labels_grow_up_to_their_bytes(spark, monkeypatch):
    from seqloom.llm import vectors

    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    expected = {i: plain(data).get(i, (0, i)) for i, *_ in data}
    written = {}
    monkeypatch.setattr(vectors, "write_table", lambda rows, what, f=vectors.write_table: written.setdefault(what, []).append([r.blocks for r in rows.collect()] if what == "vectors-sizes" else 0) or f(rows, what))
    for block_bytes, blocks in ((1 << 20, 8), (20 * 16 * 8, 8), (5 * 16 * 8, 16)):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
        got = near_vectors(df, tile=4).collect()
        assert {r.id: (r.n_links, r.component) for r in got} == expected
        assert written.pop("vectors-sizes") == [[blocks, blocks]]


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24)) + 2.2
    true = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    expected = {(a, b) for a, b in zip(*np.nonzero(np.triu(true >= 0.93, 1)), strict=True)}
    assert {(a, b) for i, j in tile_links(x, None, 0.93) for a, b in zip(i, j, strict=True)} == expected
    cross = {(a, b) for i, j in tile_links(x[:100], x[100:], 0.93) for a, b in zip(i, j + 100, strict=True)}
    assert cross == {p for p in expected if p[0] < 100 <= p[1]}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_vectors(df).collect() == []
    codes = sign_codes(df)
    assert nearest_codes(codes, codes).collect() == []


def test_topk_matches_brute_force(spark):
    data = [r[:2] for r in rows(220, 64, 4)] + [(300 + i, rows(1, 64, 4)[0][1]) for i in range(30)] + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(3)
    codes = sign_codes(df)
    bits = {}
    for i, v in data:
        if i is not None and v and None not in v and not np.isnan(v).any():
            bits[i] = tuple(x > 0 for x in v)
    for k in (1, 7):
        got = {}
        for r in nearest_codes(codes, codes.where("id % 20 = 0"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.distance, r.neighbour_id, r.rank))
        for q in [i for i in bits if i % 20 == 0]:
            width = -(-len(bits[q]) // 16)
            order = sorted((sum(a != b for a, b in zip(bits[q], c, strict=True)), i) for i, c in bits.items() if i != q and -(-len(c) // 16) == width and len(c) == len(bits[q]))
            assert got.get(q, []) == [(d, i, n + 1) for n, (d, i) in enumerate(order[:k])]


def test_only_buckets_at_the_radius_are_read():
    rng = np.random.default_rng(6)
    low = np.sort(rng.integers(0, 1 << 13, 3_000))
    for prefix in (0, 5):
        values = (prefix << 13 | low).astype(np.uint16)
        asked = rng.integers(0, 1 << 16, 20).astype(np.uint16)
        for radius in range(17):
            got = {q: found for q, found in probed(values, asked, prefix, radius)}
            for q, value in enumerate(asked):
                want = np.flatnonzero(np.bitwise_count(values ^ value) == radius)
                assert np.array_equal(np.sort(got.get(q, np.zeros(0, int))), want)


def test_topk_with_clashing_columns(spark):
    codes = sign_codes(spark.createDataFrame(rows(60), SCHEMA)).selectExpr("*", "'x' AS segment", "1 AS low", "2 AS query", "'y' AS distance")
    plainly = nearest_codes(codes.select("id", "code"), codes.select("id", "code").where("id < 5"), 3)
    assert sorted(map(tuple, nearest_codes(codes, codes.where("id < 5"), 3).collect())) == sorted(map(tuple, plainly.collect()))
