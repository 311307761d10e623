"""Lists in order: ``a10_array_null_keys`` on odd rows, and the order of equal keys."""

import duckdb
from test_engine import rows

from clauseplan import queries as catalogue

ODD = [
    (1, 4500.0, "A"), (2, 4100.0, "A"), (3, float("nan"), "A"), (4, None, "A"), (5, float("inf"), "B"), (6, 4001.0, None),
    (None, 4200.0, "A"), (-1, 9000.0, "A"), (-1, 4300.0, "C"), (-1, None, "D"),
]


def test_rows_without_a_balance(spark, tmp_path):
    """No two balances of a segment are equal, so the SQL leaves nothing open."""
    table = spark.createDataFrame(ODD, "c_custkey long, c_acctbal double, c_mktsegment string")
    table.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    query = catalogue.Q["a10_array_null_keys"]
    want = [(seg, list(xs)) for seg, xs in con.sql(query.sql).fetchall()]
    assert sorted(((r.seg, list(r.xs)) for r in query(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_equal_keys_go_by_value(spark):
    """The order of rows and their tasks make no difference."""
    data = [(2.0, 7), (1.0, 9), (2.0, 3), (None, 6), (1.0, 4), (2.0, 5), (None, 2)]
    for table in (data, data[::-1]):
        source = spark.createDataFrame(table, "x double, k long").repartition(3)
        assert rows(spark, "Out(xs? Array= x -> k) distinct :- S(x:, k:);", tables={"S": source}) == [([4, 9, 3, 5, 7, 2, 6],)]
