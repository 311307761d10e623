"""Rules over streams: the plan of a rule is the same on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Program
from ..errors import PlanError


def streamed(program: Program, predicate: str, streams: dict[str, DataFrame], event_time: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A predicate's rows over streams.  ``event_time`` gives a stream's time column and how late its rows may come, as in
    ``{"Events": ("ts", "10 minutes")}``.  Recursive and grounded predicates need whole tables and are refused."""
    planner = program.planner
    for name in planner.rules:
        if planner.loop_of(name) or name in planner.ground:
            raise PlanError(f"{name} needs a whole table, not a stream")
    for name, df in streams.items():
        if not df.isStreaming:
            raise PlanError(f"{name} is no stream")
        if event_time and name in event_time:
            df = df.withWatermark(*event_time[name])
        planner.tables[name] = df
    planner.memo.clear()
    return planner.relation(predicate)


def started(df: DataFrame, path: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Write a streamed result to files until it is stopped."""
    return df.writeStream.format(kind).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).start()
