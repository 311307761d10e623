"""Secret scans over all historical versions, by an incremental blob ledger.

Each version of a file is addressed by the SHA-256 of its content.  A ledger row says which rule versions have run on
a blob and what they found.  A scan takes only the (blob, rule version) pairs that the ledger lacks, adds rows for
them, and joins findings back to every path that holds the blob.

A version's text is moved once, to gather equal blobs; each task passes a blob on once, so a blob that a third of all
versions share arrives once from each task.  Findings reach the paths of a crowded blob in several tasks.

A span carries its rule with the rule's version: findings of a version that is no longer asked for are never given out.

Defined results: a null text counts as empty; null paths pass through; repeated rows give repeated results; an empty
table gives an empty result; columns beside the two named are never read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_chunks, whole_text
from .shared import cut, spread_join

LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those are dropped whose ``group`` is shorter than ``least``.
    ``hint``: lower-case strings of which a text must hold one (in either case) to match at all."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules and well-known token formats.
ASSIGN = Rule("assign", 1, r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, ("passw", "secret", "token", "api"))
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",))
HEX = Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}")
BASE_RULES = (ASSIGN, ACCESS, HEX)
RULES = (
    *BASE_RULES,
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hint=("private key-----",)),
    Rule("hosting_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint=("xox",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=("eyj",)),
)


def scan_text(text: str, rules: tuple[tuple[Rule, re.Pattern], ...], lowered: str | None = None) -> list[tuple[str, int, int]]:
    lowered = text.lower() if lowered is None else lowered
    out = []
    for rule, compiled in rules:
        if rule.hint and not any(x in lowered for x in rule.hint):
            continue
        for m in compiled.finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((rule.key, m.start(), m.end()))
    return out


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """``_path``, ``_text`` and the content address ``blob`` of each version."""
    v = versions.select(F.col(path).alias("_path"), whole_text(text).alias("_text"))
    return v.withColumn("blob", F.sha2(F.col("_text").cast("binary"), 256))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs that ``ledger`` lacks: append them to it."""
    compiled = tuple((r, re.compile(r.pattern)) for r in rules)
    blobs = addressed(versions, path, text).select("blob", "_text")

    def once():
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch) -> dict:
            keep = []
            for x in batch.column("blob").to_pylist():
                x = bytes.fromhex(x)
                keep.append(x not in seen)
                seen.add(x)
            part = batch.filter(pa.array(keep, pa.bool_()))
            return {"blob": part.column("blob"), "_text": part.column("_text")}

        return work

    blobs = map_chunks(blobs, once, "blob string, _text string", "_text")
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.repartition("blob").withColumn("todo", every)
    else:
        known = ledger.select(F.col("blob").alias("_known"), F.explode("rules").alias("_rule")).groupBy("_known").agg(F.collect_set("_rule").alias("_done"))
        todo = blobs.join(known.hint("merge"), F.col("blob") == F.col("_known"), "left").withColumn("todo", F.array_except(every, F.coalesce("_done", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0).select("blob", "_text", "todo")  # the join has gathered equal blobs

    def scanner():
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"blob": [], "rules": [], "spans": []}
            for blob, text, keys in zip(*(batch.column(c).to_pylist() for c in ("blob", "_text", "todo")), strict=True):
                if (address := bytes.fromhex(blob)) in seen:
                    continue
                seen.add(address)
                found = scan_text(text, tuple(x for x in compiled if x[0].key in keys))
                out["blob"].append(blob)
                out["rules"].append(keys)
                out["spans"].append([{"rule": k, "start": a, "end": b} for k, a, b in found])
            return out

        return work

    return map_chunks(todo, scanner, LEDGER, "_text")


def updated(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger kept as Parquet in ``folder``, after scanning what it lacks and appending that.  A run that broke off can
    be run again: what it has appended is not scanned twice."""
    spark: SparkSession = versions.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    scan(versions, rules, spark.read.schema(LEDGER).parquet(folder) if there else None, path, text).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and its spans under the given rule versions by start, then rule as listed; only blobs with a span."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    wanted = F.filter("spans", lambda s: s["rule"].isin(*[r.key for r in rules]))
    one = ledger.select("blob", wanted.alias("spans")).filter(F.size("spans") > 0)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["rule"]].alias("rank"), s["end"].alias("end"), kind[s["rule"]].alias("kind"))))
    return one.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")).select("blob", F.array_distinct(order).alias("spans"))


def by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Every version with its blob and spans (an empty list where there are none)."""
    v = cut(addressed(versions, path, text).select("_path", "blob"))
    found = findings(ledger, rules).withColumnRenamed("blob", "_found")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return spread_join(v, found, "blob", "_found", F.col("_path")).select(F.col("_path").alias(path), "blob", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _blanked(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for x, a, b in zip(text, starts, ends, strict=True):
        if x is None or a is None:
            out.append(None)
            continue
        parts, at = [], 0
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if i >= at:
                parts += (x[at:i], "[secret]")
            at = max(at, j)
        out.append("".join(parts) + x[at:])
    return pd.Series(out, dtype=object)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every found span replaced by ``[secret]`` (overlapping spans by one).  ``length``, if
    there is such a column, is set to the new text's code points where the text changed."""
    ledger = scan(docs, rules, path=id, text=text)
    found = findings(ledger, rules).select(F.col("blob").alias("_found"), F.col("spans").alias("_spans"))
    blob = F.sha2(whole_text(text).cast("binary"), 256).alias("_blob")
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(id).alias("_path"), blob)
    found = found.hint("merge")  # one plan at every size: how many have secrets has no bound
    joined = spread_join(packed, found, "_blob", "_found", F.col("_path"), docs.select(blob))
    changed = F.col("_spans").isNotNull()
    blank = F.pandas_udf(_blanked, T.StringType())  # only texts with spans go through Python
    done = blank(F.when(changed, F.col("_text")), F.transform("_spans", lambda s: s["start"]), F.transform("_spans", lambda s: s["end"]))
    own = joined.withColumn("_new", done).withColumn("_new", F.when(changed, F.col("_new")).otherwise(F.col("_text")))

    def column(name: str) -> Column:
        kept = F.col("_row").getField(name)
        if name == text:
            return F.col("_new").alias(name)
        if name == length:
            return F.when(changed, F.length("_new").cast(docs.schema[name].dataType)).otherwise(kept).alias(name)
        return kept.alias(name)

    return own.select(*map(column, docs.columns))
