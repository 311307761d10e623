"""Text of doubles: the fewest digits that give the number back, as Python's ``repr`` has them."""

import random

from test_engine import rows


def test_fewest_digits(spark):
    rng = random.Random(12)
    values = [k * 1e17 for k in range(11800, 11900)] + [2e-3 * k for k in range(200)] + [rng.uniform(0, 1e6) for _ in range(500)] + [rng.randint(1, 9999) * 10.0**e for e in range(-30, 30) for _ in range(10)]
    values += [2.0**-44, 5e-324, 1.5e-310, 2e23, 8.41e21, 1.2345678901234567e17, -1.1807e21, 1.7976931348623157e308]
    got = rows(spark, "Out(x:, t: ToString(x)) :- T(x:);", tables={"T": spark.createDataFrame([(v,) for v in values], "x double")})
    digits = lambda t: (float(t), len(t.lower().split("e")[0].replace(".", "").strip("-0")))
    assert len(got) == len(values) and all(digits(t) == digits(repr(x)) for x, t in got)
    assert {t for x, t in got if x == 11807 * 1e17} == {"1.1807e+21"}


def test_no_numbers(spark):
    table = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, -0.0), (5, None)], "k int, x double")
    assert rows(spark, "Out(k:, t: ToString(x)) :- T(k:, x:);", tables={"T": table}) == [(1, "nan"), (2, "inf"), (3, "-inf"), (4, "-0.0"), (5, None)]
