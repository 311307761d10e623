"""Relational steps that the planner composes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union, by name where the names are the same, else by place; text beside another type makes both text."""
    first = frames[0]
    if len(frames) == 1:
        return first
    for f in frames[1:]:
        if len(f.columns) != len(first.columns):
            raise PlanError("rules of one predicate have different numbers of columns")
    aligned = [f.select(*[quoted(c) for c in first.columns]) if set(f.columns) == set(first.columns) else f.toDF(*first.columns) for f in frames]
    wide = []
    for i, c in enumerate(first.columns):
        kinds = {type(f.schema[i].dataType) for f in aligned} - {T.NullType}
        if T.StringType in kinds and len(kinds) > 1:
            wide.append(c)
    if wide:
        aligned = [f.withColumns({c: quoted(c).cast("string") for c in wide}) for f in aligned]
    return reduce(DataFrame.union, aligned)


def anti_join(left: DataFrame, right: DataFrame, conditions: list[Column], keep: bool = False) -> DataFrame:
    """Rows of ``left`` without (``keep``: with) a row of ``right``.  Without any condition, one row of ``right`` is enough to decide."""
    how = "left_semi" if keep else "left_anti"
    if not conditions:
        return left.join(F.broadcast(right.limit(1)), F.lit(True), how)
    return left.join(right, all_of(conditions), how)


def attach_row(left: DataFrame, row: DataFrame) -> DataFrame:
    """A keyless aggregate's one row beside every row."""
    return left.crossJoin(F.broadcast(row))


def searched(frame: DataFrame, pattern: str) -> DataFrame:
    """Rows of which some column's text matches."""
    return frame.filter(reduce(lambda a, b: a | b, [F.coalesce(quoted(c).cast("string").rlike(pattern), F.lit(False)) for c in frame.columns]))


def sorted_by(frame: DataFrame, keys: list[str]) -> DataFrame:
    """By ``"column"``, ``"column", "DESC"`` or ``"column desc"``; nulls last."""
    order: list[tuple[str, bool]] = []
    for key in keys:
        words = key.split()
        if key.upper() in ("DESC", "ASC") and order:
            order[-1] = (order[-1][0], key.upper() == "DESC")
        elif len(words) == 2 and words[1].upper() in ("DESC", "ASC"):
            order.append((words[0], words[1].upper() == "DESC"))
        else:
            order.append((key, False))
    return frame.orderBy(*[quoted(c).desc_nulls_last() if down else quoted(c).asc_nulls_last() for c, down in order])
