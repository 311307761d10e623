"""Queries over whole tables, at a size where a subset of the ids would show."""

import duckdb
import pytest

from clauseplan import queries as catalogue

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["f_times", "j12_interval_overlap", "a20_braces", "r1_closure_bag", "r1_closure_distinct", "r7_shortest_path"])
def test_whole(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "supplier"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    query = catalogue.Q[name]
    want = con.sql(query.sql)
    got = query(spark, FOLDER).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    table = {"f_times": "events", "a20_braces": "customer"}.get(name)
    if table:
        assert len(got) == con.sql(f"select count(*) from {table}").fetchall()[0][0] > 500
    if name.startswith("r1"):
        assert {r.a for r in got} == {r[0] for r in con.sql("select s_suppkey from supplier").fetchall()}
