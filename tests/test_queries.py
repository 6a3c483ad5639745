"""Every registered query against its SQL counterpart, on the smallest tables."""

import importlib.util
import math

import duckdb
import pytest

import __spark_entry__ as entry_points

from conftest import DATA

SF = f"{DATA}/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
# The optional subpackage has its own tests.
CORPUS = {n for n in QUERIES if n.startswith("op") and n[2].isdigit()} | {"pipeline"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if n not in CORPUS))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_library_stands_without_the_optional_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("textmeter.llm", "corpus_pipeline") else find(n, *a))
    assert set(entry_points.queries()) == set(QUERIES) - CORPUS


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
