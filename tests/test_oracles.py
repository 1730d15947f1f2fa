"""Every registered engine query against the same query in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quarrygraph.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


def test_stream_equals_batch(spark):
    rows = lambda df: sorted(map(tuple, df.select("path", "first_generation", "last_generation", "cold").collect()))
    assert rows(registry.QUERIES["stream_dirty_paths"](spark, DATA)) == rows(registry.QUERIES["dirty_paths"](spark, DATA))


def test_batch_plans_cover_all_documents(spark):
    got = registry.QUERIES["batch_plans"](spark, DATA).groupBy("project").sum("documents", "cost").collect()
    want = registry.star.inventory(spark, DATA, "current").groupBy("project").agg({"path": "count", "length": "sum"}).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *sorted(r[1:])) if r[1] < r[2] else (r[0], r["count(path)"], r["sum(length)"]) for r in want)
