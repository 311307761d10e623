"""The ten registered queries, and the SQL that checks those which SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, partial_match, pieces, quality_model, quality_rules, secret_ledger, simhash, suffix_dedup, telephony

#: The folder of the public vocabulary files; on a cluster the same path on every driver.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model(folder: str = "") -> bytes:
    return Path(folder or TOKENIZERS, PIECE_MODEL).read_bytes()


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_documents(spark, sf_dir), keep_text=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(_documents(spark, sf_dir))


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.carried(_documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_documents(spark, sf_dir))


def op6_partial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_match.scores(_documents(spark, sf_dir))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secret_ledger.by_path(docs, secret_ledger.scan(docs))
    base = [r.kind for r in secret_ledger.BASE_RULES]
    own = F.filter("spans", lambda s: s["kind"].isin(*base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secret_ledger.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(secret_ledger.spans_text(own), 256).alias("base_sha256"), secret_ledger.spans_text(F.col("spans")).alias("spans"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.trained_and_scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_documents(spark, sf_dir))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_telephony": op4_telephony,
    "op5_licenses": op5_licenses,
    "op6_partial_match": op6_partial_match,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_quality_model": op8_quality_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_pieces": op10_pieces,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op9_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM rep, (SELECT unnest(range(0, 8)) AS k)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.dups, 0) AS n_dup_lines, coalesce(dup.n, 0) AS n_lines,
        coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f""",
}
