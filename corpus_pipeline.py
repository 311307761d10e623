"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the last return the columns of ``docs``.

Defined results, for every stage: a null text counts as empty; an empty table gives an empty result with the same columns;
other columns, whatever they are called, pass through; repeated rows are treated alike.  Quality drops texts of fewer than
20 words, so empty ones go first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clauseplan.llm import mixing, near_copies, pieces, quality_rules, secret_ledger
from clauseplan.llm.queries import piece_model
from clauseplan.llm.shared import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; a null id doesn't matter."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more) the document with the smallest id stays, with all rows of that
    id; rows with a null id stay."""
    return near_copies.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; every document stays."""
    return secret_ledger.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics near their tempered shares; nulls are a value of their own."""
    return mixing.sampled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none."""
    return pieces.encoded(docs, piece_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("encoding", encoding)]

#: Groups of near-duplicates need a closure over all pairs, and pieces can't be expressed; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again.  A stage's table is removed when the next
    one is written; the last one's is the result and stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = ""
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
