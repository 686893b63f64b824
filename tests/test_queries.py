"""Every registered genomic query against its DuckDB counterpart on the smallest tables."""

import ast
import math
from pathlib import Path

import duckdb
import pytest

from seqloom import registry
from seqloom.plans.fixtures import Tables

SF = "/root/testdata/sf0.001"
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return round(float(v), 5) if hasattr(v, "as_tuple") else v

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ENTRIES))
def test_query_equals_sql(spark, duck, name):
    build, sql = registry.ENTRIES[name]
    df = build(Tables(spark, SF))
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(got[0])) == len(got[0])
    assert got[1], "a query without rows shows nothing"
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert got == comparable(columns, want.fetchall())


def test_the_library_does_not_import_the_corpus_subpackage():
    root = Path(__file__).resolve().parents[1] / "seqloom"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith(("seqloom.llm", "corpus_pipeline")) for n in names), path


def test_entry_returns_site_summaries(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
