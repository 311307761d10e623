"""Files as tables, results as files."""

from __future__ import annotations

from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """CSV and TSV with a header, a JSON array, JSON lines, or Parquet, by suffix or ``kind``.  Empty CSV fields are null."""
    kind = kind or PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"', multiLine=True, nullValue="")
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    raise PlanError(f"{path}: kind {kind!r} is not known")


def file_text(spark: SparkSession, path: str) -> str:
    """One file's text, through Spark's readers.  It becomes a constant of the plan, so it has to be a small file."""
    row = spark.read.text(path, wholetext=True).first()
    return "" if row is None else row["value"]


def attached(spark: SparkSession, place: str, table: str) -> DataFrame:
    """A table of an attached database: by JDBC, or a file or folder ``table.kind`` under a folder."""
    if place.startswith("jdbc:"):
        return read_table(spark, place, table)
    jvm = spark.sparkContext._jvm
    for kind in ("parquet", "orc", "csv", "tsv", "json", "jsonl", "ndjson"):
        path = jvm.org.apache.hadoop.fs.Path(f"{place.rstrip('/')}/{table}.{kind}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return read(spark, path.toString(), kind)
    raise PlanError(f"{place} holds no table {table}")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row of ``path`` and ``content``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, by JDBC; give ``partitionColumn``, its bounds and ``numPartitions`` to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def _framed(frame: DataFrame) -> DataFrame:
    """The lines of one JSON array.  One file has one writer; rows stream through it."""

    def lines(batches):
        open_ = "["
        for batch in batches:
            for row in batch.column(0).to_pylist():
                if row is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([open_ + row])], names=["value"])
                    open_ = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if open_ == "," else "[]"])], names=["value"])

    made = frame.select(F.to_json(F.struct("*")).alias("value"))
    no_row = frame.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that an empty table has a writer too
    return made.unionByName(no_row).coalesce(1).mapInArrow(lines, "value string")


def write(frame: DataFrame, path: str, kind: str | None = None, overwrite: bool = True) -> None:
    kind = kind or PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    writer = frame.write.mode("overwrite" if overwrite else "errorifexists")
    if kind in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    elif kind in ("json", "jsonl", "ndjson"):
        writer.json(path)
    elif kind == "text":
        writer.text(path)
    elif kind == "array":
        _framed(frame).write.mode("overwrite" if overwrite else "errorifexists").text(path)
    elif kind in ("parquet", "orc"):
        getattr(writer, kind)(path)
    else:
        raise PlanError(f"{path}: kind {kind!r} is not known")
