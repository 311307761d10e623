"""Rows with equal scores: which item ``ArgMax`` and ``ArgMin`` name."""

import datetime

import pytest
from test_engine import rows

ITEMS = [7, 3, 9, 3, 5]


@pytest.mark.parametrize(("kind", "low", "high"), [
    ("long", -5, 2**62), ("int", -(2**31), 2**31 - 1), ("double", -1.5, 2.5), ("double", 2.5, float("nan")), ("double", 1.0, float("inf")), ("decimal(10,2)", "1.50", "2.50"), ("boolean", False, True),
    ("string", "ab", "abc"), ("string", "", "é"), ("date", datetime.date(1969, 1, 1), datetime.date(2024, 2, 29)),
    ("timestamp", datetime.datetime(1960, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 1)), ("timestamp_ntz", datetime.datetime(1960, 1, 1, 5, 6, 7, 8), datetime.datetime(1960, 1, 1, 5, 6, 7, 9)),
])
def test_ties_go_to_the_least_item(spark, kind, low, high):
    """Each of three items has the best score; the order of rows and their tasks make no difference."""
    as_kind = (lambda v: __import__("decimal").Decimal(v)) if kind.startswith("decimal") else lambda v: v
    data = [("a", i, as_kind(high if i in (7, 3, 9) else low)) for i in ITEMS] + [("a", 1, None), ("a", None, as_kind(high)), ("a", 4, as_kind(low))]
    for table in (data, data[::-1]):
        source = spark.createDataFrame(table, f"g string, i long, s {kind}").repartition(3)
        assert rows(spark, "Out(g:, top? ArgMax= i -> s, low? ArgMin= i -> s) distinct :- S(g:, i:, s:);", tables={"S": source}) == [("a", 3, 4)]


def test_ties_beside_no_score(spark):
    assert rows(spark, "Out(top? ArgMax= i -> s) distinct :- S(i:, s:);", tables={"S": spark.createDataFrame([(1, None)], "i long, s double")}) == [(None,)]
    assert rows(spark, "Out(top? ArgMax= i -> s) distinct :- S(i:, s:);", tables={"S": spark.createDataFrame([(2, [1]), (1, [2])], "i long, s array<int>")}) == [(1,)]
    assert rows(spark, "Out(r:, m: (combine ArgMax= i -> s :- S(i:, s:), i > r)) :- R(r:);", tables={"S": spark.createDataFrame([(5, 1.0), (4, 1.0)], "i long, s double"), "R": spark.createDataFrame([(0,)], "r long")}) == [(0, 4)]
