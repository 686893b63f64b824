import numpy as np
import pytest

from seqloom.llm import components
from seqloom.llm.components import connected_components
from seqloom.llm.simhash import simhash_groups
from seqloom.llm.vectors import near_vectors


def union_find(edges):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {x: root(x) for x in top}


def chain(n, seed):
    ids = np.random.default_rng(seed).permutation(10 * n)[:n].tolist()
    return list(zip(ids[:-1], ids[1:], strict=True))


def graphs():
    rng = np.random.default_rng(4)
    yield "chain", chain(5_000, 1)
    yield "star", [(700, int(x)) for x in rng.permutation(3_000) if x != 700]
    grid = rng.permutation(900).reshape(30, 30)
    yield "grid", [*zip(grid[:-1].ravel().tolist(), grid[1:].ravel().tolist(), strict=True), *zip(grid[:, :-1].ravel().tolist(), grid[:, 1:].ravel().tolist(), strict=True)]
    ids = rng.permutation(3_000).tolist()
    yield "tree with a hot root", [(ids[i], ids[0] if i % 3 else ids[int(rng.integers(0, i))]) for i in range(1, 3_000)]
    yield "odd", [(5, 5), (-3, 7), (7, -3), (-3, 7), (9, 7), (2**62, -(2**62))]


@pytest.mark.parametrize("name,edges", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_components_match_union_find_in_few_rounds(spark, monkeypatch, name, edges):
    rounds = []
    monkeypatch.setattr(components, "write_table", lambda df, what, write=components.write_table: (rounds.append(what), write(df, what))[1])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {x: c for x, c in union_find(edges).items() if any(x in e and e[0] != e[1] for e in (edges if len(edges) < 10 else [])) or len(edges) >= 10}
    assert got == want
    assert rounds.count("cc-around") <= 25, name


def test_empty_graph(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_long_chain_of_vectors(spark):
    """Each vector is near the next one only, so a label is one chain as long as the table."""
    n = 500
    angle = np.arange(n) * 0.3
    order = np.random.default_rng(2).permutation(n).tolist()
    turns = [[float(np.cos(a)), float(np.sin(a)), 0.02 * float(a)] for a in angle]
    df = spark.createDataFrame([(order[i], v, 1) for i, v in enumerate(turns)], "vec_id bigint, embedding array<double>, label int")
    x = np.array(turns)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    want = union_find([(order[a], order[b]) for a, b in near])
    assert {r.id: r.component for r in near_vectors(df, tile=64).collect()} == want


def test_long_chain_of_fingerprints(spark, monkeypatch):
    """Fingerprints that drift by two bits from one to the next."""
    from seqloom.llm import simhash
    from pyspark.sql import functions as F

    n = 400
    rng = np.random.default_rng(7)
    codes, code = [], 0
    for _ in range(n):
        for bit in rng.choice(64, 2, replace=False):
            code ^= 1 << int(bit)
        codes.append(code)
    order = rng.permutation(n).tolist()
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, i, t: docs.select(F.col(i).alias("id"), F.col(t).cast("bigint").alias("fp")))
    df = spark.createDataFrame([(order[i], str(c - (1 << 64) if c >> 63 else c)) for i, c in enumerate(codes)], "doc_id bigint, text string")
    links = [(order[a], order[b]) for a in range(n) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4]
    assert {r.id: r.component for r in simhash_groups(df).collect()} == union_find(links)
