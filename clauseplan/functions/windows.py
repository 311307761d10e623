"""Window functions: ``Name(value, [partition...], [order...][, n])``, ascending, nulls last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The function over the value and the extra argument, and its frame: running, the n rows before, or Spark's own.
WINDOWS: dict[str, tuple[Callable[..., Column], str]] = {
    "CumulativeSum": (F.sum, "running"), "CumulativeMax": (F.max, "running"), "CumulativeMin": (F.min, "running"),
    "WindowSum": (F.sum, "rows"), "WindowMax": (F.max, "rows"), "WindowMin": (F.min, "rows"),
    "Rank": (lambda x: F.rank(), ""), "DenseRank": (lambda x: F.dense_rank(), ""), "RowNumber": (lambda x: F.row_number(), ""), "PercentRank": (lambda x: F.percent_rank(), ""), "CumeDist": (lambda x: F.cume_dist(), ""),
    "Ntile": (lambda x, n: F.ntile(n), ""), "Lag": (lambda x, n=1: F.lag(x, n), ""), "Lead": (lambda x, n=1: F.lead(x, n), ""), "FirstValue": (F.first_value, "running"), "LastValue": (F.last_value, "running"), "NthValue": (lambda x, n: F.nth_value(x, n), "running"),
}


def call(name: str, value: Column, partition: list[Column], order: list[Column], n: int | None = None) -> Column:
    function, frame = WINDOWS[name]
    window = Window.partitionBy(*partition).orderBy(*[o.asc_nulls_last() for o in order])
    if frame == "running":
        window = window.rowsBetween(Window.unboundedPreceding, 0)
    elif frame == "rows":
        window = window.rowsBetween(-int(n or 0), 0)
    return function(value, *([n] if n is not None and frame != "rows" else [])).over(window)
