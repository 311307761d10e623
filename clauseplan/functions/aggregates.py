"""Aggregates as column expressions over a group's rows.  A pair ``a -> b`` is a struct of ``arg`` and ``value``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from . import places

_ALIASES = {"+": "Sum", "++": "MergeList", "*": "Product", "1": "Min", "ISum": "Sum", "SomeValue": "AnyValue", "Aggr": "AnyValue", "Countif": "CountIf", "ArrayConcatAgg": "MergeList", "ArrayAgg": "List", "ExactCount": "Count"}


def as_list(x: Column) -> Column:
    """All values, nulls too; null for no rows."""
    kept = F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])
    return F.when(F.size(kept) > 0, kept)


def as_set(x: Column) -> Column:
    """The distinct values in order, a null last; null for no rows."""
    kept = F.array_sort(F.array_distinct(F.transform(F.collect_set(F.struct(x.alias("x"))), lambda s: s["x"])))
    return F.when(F.size(kept) > 0, kept)


def ordered(pair: Column) -> Column:
    """Values of ``key -> value`` by key, null keys last."""
    rows = F.collect_list(F.struct(pair["arg"].isNull().alias("none"), pair["arg"].alias("key"), pair["value"].alias("value")))
    return F.when(F.size(rows) > 0, F.transform(F.array_sort(rows), lambda s: s["value"]))


def falling(x: Column, kind: T.DataType) -> Column | None:
    """A column that sorts as ``x`` does backwards, for a value that isn't null; None for kinds that have none."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.bitwise_not(x)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.struct((~F.isnan(x)).alias("number"), (-x).alias("x"))  # what isn't a number is above all
    if isinstance(kind, T.DecimalType):
        return -x
    if isinstance(kind, T.BooleanType):
        return ~x
    if isinstance(kind, T.DateType):
        return -F.unix_date(x)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(x)
    if isinstance(kind, T.TimestampNTZType):
        return F.struct((-F.unix_date(x.cast("date"))).alias("d"), (-F.hour(x)).alias("h"), (-F.minute(x)).alias("m"), (-F.date_part(F.lit("SECOND"), x)).alias("s"))
    if isinstance(kind, T.StringType | T.BinaryType):  # a text comes before its beginnings
        return F.concat(F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return None


def best(pair: Column, largest: bool, kind: T.DataType | None = None) -> Column:
    """The item of the best score, of several the least (of the largest of a ``kind`` without a reverse order, the
    greatest); rows without an item or a score don't count."""
    item, score = pair["arg"], pair["value"]
    back = falling(score, kind) if largest and kind is not None else None
    order = F.struct((score if back is None else back).alias("score"), item.alias("item"))
    order = F.when(item.isNotNull() & score.isNotNull(), order)
    return (F.max if largest and back is None else F.min)(order)["item"]


def best_k(pair: Column, k: Column, largest: bool) -> Column:
    """The items of the ``k`` best scores, best first; null scores last."""
    rows = F.collect_list(F.struct(pair["value"].alias("score"), pair["arg"].alias("item")))
    scored, others = F.filter(rows, lambda s: s["score"].isNotNull()), F.filter(rows, lambda s: s["score"].isNull())
    line = F.concat(F.sort_array(scored, asc=not largest), others)
    return F.when(F.size(rows) > 0, F.transform(F.slice(line, F.lit(1), k.cast("int")), lambda s: s["item"]))


def text_of(x: Column) -> Column:
    """Values joined by commas, in order."""
    rows = F.array_sort(F.collect_list(x))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda v: v.cast("string")), ","))


def top_sum(pair: Column, n: Column) -> Column:
    """The ``n`` items with the largest sums of their weights, as ``{value, sum}``, from ``item -> weight``."""
    rows = F.collect_list(F.struct(pair["arg"].alias("item"), pair["value"].cast("double").alias("weight")))
    items = F.array_distinct(F.transform(rows, lambda r: r["item"]))
    sums = F.transform(items, lambda i: F.struct(F.aggregate(F.filter(rows, lambda r: r["item"].eqNullSafe(i)), F.lit(0.0), lambda s, r: s + F.coalesce(r["weight"], F.lit(0.0))).alias("sum"), i.alias("value")))
    best = F.slice(F.sort_array(sums, asc=False), F.lit(1), n.cast("int"))
    return F.transform(best, lambda s: F.struct(s["value"].alias("value"), s["sum"].alias("sum")))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "Sum": F.sum, "Min": F.min, "Max": F.max, "Avg": F.avg, "Count": F.count_distinct, "List": as_list, "Set": as_set, "Array": ordered,
    "MergeList": lambda x: F.when(F.count(x) > 0, F.flatten(F.collect_list(x))), "ArgMax": lambda p: best(p, True), "ArgMin": lambda p: best(p, False),
    "ArgMaxK": lambda p, k: best_k(p, k, True), "ArgMinK": lambda p, k: best_k(p, k, False), "AnyValue": lambda x: F.any_value(x, True), "StringAgg": text_of, "Median": F.median,
    "LogicalOr": F.bool_or, "LogicalAnd": F.bool_and, "Product": F.product, "CountIf": F.count_if, "ApproxCountDistinct": F.approx_count_distinct,
    "ApproxQuantiles": lambda x, n: F.call_function("percentile_approx", x, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: i / n)),
    "PercentileCont": lambda x, p: F.call_function("percentile", x, p), "PercentileDisc": lambda x, p: F.call_function("percentile_approx", x, p), "Corr": lambda p: F.corr(p["arg"], p["value"]), "CovarPop": lambda p: F.covar_pop(p["arg"], p["value"]),
    "CovarSamp": lambda p: F.covar_samp(p["arg"], p["value"]), "BitAnd": F.bit_and, "BitOr": F.bit_or, "BitXor": F.bit_xor, "StddevPop": F.stddev_pop, "StddevSamp": F.stddev_samp, "VarPop": F.var_pop, "VarSamp": F.var_samp,
    "HllCountInit": lambda x: F.hll_sketch_agg(x), "HllCountMerge": lambda x: F.hll_sketch_estimate(F.hll_union_agg(x)), "HllCountMergePartial": lambda x: F.hll_union_agg(x),
    "ApproxTopSum": lambda p, n: top_sum(p, n), "StCentroidAgg": lambda g: places.point(F.avg(places.first(g)["x"]), F.avg(places.first(g)["y"])),
    "ApproxTopCount": lambda x, n: F.call_function("approx_top_k", x, n.cast("int")),
}


def named(op: str) -> str | None:
    """The built-in that an aggregate's sign or name means."""
    own = _ALIASES.get(op, op)
    return own if own in AGGREGATES else None


def call(op: str, values: list[Column], kind: T.DataType | None = None) -> Column:
    """``kind``: that of a pair's ``value``, which ``ArgMax`` asks for."""
    try:
        if named(op) == "ArgMax" and len(values) == 1:
            return best(values[0], True, kind)
        return AGGREGATES[named(op)](*values)
    except TypeError as e:
        raise PlanError(f"{op} can't take {len(values)} arguments") from e


