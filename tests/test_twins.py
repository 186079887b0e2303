"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import importlib.util
import math

import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
OWN = [n for n in entry_point.queries() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    """A value that compares alike from both engines."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_twin(spark, duck, name):
    found = entry_point.queries()[name](spark, DATA)
    if name not in entry_point.oracle_sql():
        assert found.count() > 0
        return
    want = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_entry_works_without_the_training_data_part(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("docgrowth.llm.queries", "corpus_pipeline") else real(n, *a))
    names = entry_point.queries()
    assert "roas_action" in names and not any(n.startswith("op") for n in names)
