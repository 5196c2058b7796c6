"""Registered queries against their SQL at the smallest size, by DuckDB."""

import decimal
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from basalt.plans import evidence, fulltext, generations, indexed, lifecycle, records, registry, search, text, usage  # noqa: E402, F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = duck.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    """Their operators are held against loops and golden cases in test_functions.py."""
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1


def test_upsert_takes_new_rows_where_old_values_are_larger(spark, tmp_path):
    """As on larger tables, where a nation has more customers than 1,000 and its suppliers together."""
    spark.range(4_500).selectExpr("cast(id % 3 = 0 as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(4).selectExpr("cast(2 - id % 2 * 2 as int) as s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["snk02_upsert"](spark, str(tmp_path)).select("k", "v").collect())
    assert got == sorted(c.sql(registry.ORACLES["snk02_upsert"]).fetchall()) == [(0, 1_002), (1, 1_500), (2, 1_002)]
