"""Lineage cuts, joins with crowded keys, and connected components, over shared storage."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, one is made up in local mode alone, as in tests."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local(\[|$)", context.master):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def settled(frame: DataFrame) -> DataFrame:
    """As :func:`cut`; what the query has shuffled is removed from disk once its rows are written."""
    conf = frame.sparkSession.conf
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, "false")
    conf.set(key, "true")  # a frame is planned with what is set when it is made
    try:
        return cut(frame.select("*"))
    finally:
        conf.set(key, was)


#: Bits of a table of marks: 8 MB at every size of the input.
MARK_BITS = 26


def marks(keys: DataFrame) -> np.ndarray:
    """A table of bits that holds the key of every row, for :func:`marked`.  Its size is fixed: the more keys, the more others
    seem marked too, so it spares rows a shuffle, and the join that follows decides."""
    at = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(1 << MARK_BITS)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 AS int))")
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (MARK_BITS - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which keys, given by their ``xxhash64``, a table of marks holds, and a share of others."""
    at = hashes & ((1 << MARK_BITS) - 1)
    return (table[at >> 6] >> (at & 63) & 1).astype(bool)


#: A key is crowded if it has more than this share of what an even deal gives a task.
CROWDED = 1 / 8


def spread_join(left: DataFrame, right: DataFrame, key: str, right_key: str, by: Column, keys: DataFrame | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key at most (a left join).

    The rows of a crowded key are dealt by a hash of ``by`` over as many tasks as their number asks for, and the one row
    of ``right`` goes to each.  Fewer than ``partitions / CROWDED`` keys can be crowded, however large the tables are, so
    their list is broadcast.  ``keys``: the key column of ``left``, if that is cheaper to read again than ``left``.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (left if keys is None else keys).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    every = counts.agg(F.sum("_n").alias("_all"))
    pieces = F.ceil(F.col("_n") * parts / CROWDED / F.col("_all"))
    crowded = counts.crossJoin(F.broadcast(every)).select("_k", pieces.alias("_pieces")).filter("_pieces > 1")
    crowded = F.broadcast(cut(crowded))
    dealt = left.join(crowded, F.col(key) == F.col("_k"), "left").withColumn("_piece", F.pmod(F.xxhash64(by), F.coalesce("_pieces", F.lit(1)))).drop("_k", "_pieces")
    copied = right.join(crowded, F.col(right_key) == F.col("_k"), "left").withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_k", "_pieces")
    return dealt.join(copied, (F.col(key) == F.col(right_key)) & (F.col("_piece") == F.col("_of")), "left").drop("_piece", "_of")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node that has an edge to another.

    Large stars and small stars take turns until nothing changes, in a number of rounds that grows with the logarithm of
    a component's size.  Each round's edges go to shared storage; the driver sees one count and one checksum a round.
    """

    def state(frame: DataFrame) -> tuple:
        r = frame.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
        return r["n"], r["x"], r["s"]

    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    edges = cut(edges)
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
