"""Every catalogue query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from clauseplan import queries as catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def bag(columns, rows):
    return sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.Q))
def test_same_rows(spark, duck, name):
    df = catalogue.Q[name](spark, FOLDER)
    want = duck.sql(catalogue.Q[name].sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(df.columns, df.collect()) == bag(want.columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
