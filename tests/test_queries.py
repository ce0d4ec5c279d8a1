"""Every registered query with an SQL twin against DuckDB over the same tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))} | {k: v for k, v in entry.oracle_sql().items() if k in ("order_limit_offset", "optional_label", "optional_nested", "optional_wildcard", "open_items", "order_relation", "order_vs_overlap")}

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    result = db.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, result.fetchall())


def test_each_query_has_a_twin():
    names = {k for k in entry.queries() if k in entry.engine.QUERIES}
    assert names == set(entry.engine.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
