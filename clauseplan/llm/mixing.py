"""Mixing sources to target weights by iterative proportional fitting, on DataFrame operations alone.

Token weights are summed to cells of (source, language, topic) before anything is shuffled.  Raking then scales the
cells, one margin after another, towards each value's target share of ``keep`` times all tokens, and never beyond a cell's
own weight: what a full cell can't give, the next rounds ask of the others.  A cell's fit over its weight is the probability
with which its documents are kept.  A document is kept if its hash, from its id and a seed, is below its probability.
Targets that ask for more of a value than there is can't be met; :func:`margins` sets what is reached beside what was
asked for.

Targets are shares by value, for any of the three margins; a value without a share gets none.  A margin without targets
is tempered: each value's own share is raised to ``temper`` and rescaled.

Defined results: nulls in source, language or topic form a value of their own; a null text has no tokens, and documents
without tokens are kept with their cell's probability; a null id hashes as the empty string; repeated rows are kept or
dropped alike; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import WORD_PATTERN, whole_text
from .shared import cut

ROUNDS, TEMPER, KEEP, SEED = 10, 0.7, 0.75, "mix"
#: Rounds after which the cells are written down, so that plans stay short.
CUT_EVERY = 5
MARGINS = ("source", "lang", "topic")
#: Cells are broadcast only if they were counted and are no more than this; beyond, the join is by shuffle.
BROADCAST_CELLS = 10_000
NONE = "\0none"


def tokens(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD_PATTERN)).cast("long")


def topic(text: str = "text") -> Column:
    """A plain topic by form: few words, tables, texts with numbers, prose."""
    body = whole_text(text)
    return F.when(F.col("_tokens") < 20, "fragment").when(body.contains("|"), "table").when(body.rlike("[0-9]{3}"), "numbers").otherwise("prose")


def marked(docs: DataFrame, id: str, source: str, lang: str, text: str, by: Column | None) -> DataFrame:
    """All columns of ``docs``, and the underscored ones that raking reads."""
    sized = docs.withColumn("_tokens", tokens(text))
    given = {"source": F.col(source), "lang": F.col(lang), "topic": topic(text) if by is None else by}
    return sized.withColumns({f"_{k}": F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in given.items()})


def rake(frame: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, keep: float | None = None) -> DataFrame:
    """The cells of a marked frame: ``_source``, ``_lang``, ``_topic``, ``_weight``, the fitted ``_fit``, and a ``_goal_`` for
    each margin.  With ``keep``, goals are shares of that part of all tokens, and no cell is fitted beyond its weight."""
    cells = cut(frame.groupBy(*[f"_{m}" for m in MARGINS]).agg(F.sum("_tokens").cast("double").alias("_weight")).filter("_weight > 0"))
    for m in MARGINS:
        cells = cells.withColumn(f"_sum_{m}", F.sum("_weight").over(Window.partitionBy(f"_{m}")))
    given = targets or {}
    sums = cells.agg(F.sum("_weight").alias("all"), *[F.sum(F.pow(f"_sum_{m}", F.lit(temper)) * F.col("_weight") / F.col(f"_sum_{m}")).alias(m) for m in MARGINS]).first()
    for m in MARGINS:
        if m in given:
            shares = given[m]
            share = F.lit(0.0)
            for value, x in shares.items():
                share = F.when(F.col(f"_{m}") == F.lit(NONE if value is None else value), F.lit(float(x))).otherwise(share)
        else:
            share = F.pow(f"_sum_{m}", F.lit(temper)) / F.lit(sums[m])
        cells = cells.withColumn(f"_goal_{m}", share * F.lit(sums["all"]) * F.lit(1.0 if keep is None else keep))
    cells = cells.withColumn("_fit", F.col("_weight") * F.lit(1.0 if keep is None else keep))
    for number in range(rounds):
        for m in MARGINS:
            own = F.sum("_fit").over(Window.partitionBy(f"_{m}"))
            fit = F.when(own > 0, F.col("_fit") * F.col(f"_goal_{m}") / own).otherwise(0.0)
            cells = cells.withColumn("_fit", fit if keep is None else F.least(fit, F.col("_weight")))
        if number % CUT_EVERY == CUT_EVERY - 1:
            cells = cut(cells)
    return cells.select(*[f"_{m}" for m in MARGINS], "_weight", "_fit", *[f"_goal_{m}" for m in MARGINS])


def margins(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", by: Column | None = None, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """For each value of each margin that has tokens: its share of all, its ``target``, and what is ``reached`` in expectation,
    as shares of the tokens asked for (``keep`` of all)."""
    cells = cut(rake(marked(docs, id, source, lang, text, by), targets, temper, rounds, keep))
    asked = cells.agg((F.sum("_weight") * F.lit(keep)).alias("_asked"))
    out = None
    for m in MARGINS:
        one = cells.groupBy(F.lit(m).alias("margin"), F.nullif(F.col(f"_{m}"), F.lit(NONE)).alias("value"), F.col(f"_goal_{m}").alias("_goal")).agg(F.sum("_weight").alias("_weight"), F.sum("_fit").alias("_fit"))
        out = one if out is None else out.unionByName(one)
    shares = {"share": F.col("_weight") * F.lit(keep), "target": F.col("_goal"), "reached": F.col("_fit")}
    return out.crossJoin(F.broadcast(asked)).select("margin", "value", *[(v / F.col("_asked")).alias(k) for k, v in shares.items()])


def chances(frame: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """The marked frame with ``_chance``, rounded to nine places."""
    names = [f"_{m}" for m in MARGINS]
    small = cut(rake(frame, targets, temper, rounds, keep).select(*names, F.round(F.col("_fit") / F.col("_weight"), 9).alias("_chance")))
    small = F.broadcast(small) if small.count() <= BROADCAST_CELLS else small
    return frame.join(small, names, "left").withColumn("_chance", F.coalesce("_chance", F.lit(1.0)))


def draw(id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", by: Column | None = None, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """Per document: id, ``topic``, ``n_tokens``, ``probability`` (six places) and ``kept``."""
    packed = docs.select(*[F.col(v).alias(k) for k, v in {"id": id, "source": source, "lang": lang, "text": text}.items()])
    out = chances(marked(packed, "id", "source", "lang", "text", by).drop("text"), targets, keep, temper, rounds)
    return out.select(F.col("id").alias(id), F.nullif(F.col("_topic"), F.lit(NONE)).alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_chance", 6).alias("probability"), (draw("id", seed) < F.col("_chance")).alias("kept"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", by: Column | None = None, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The kept rows with all their columns, whatever those are called.  ``by`` may name ``id``, ``source``, ``lang``, ``text``."""
    packed = docs.select(F.struct("*").alias("row"), *[F.col(v).alias(k) for k, v in {"id": id, "source": source, "lang": lang, "text": text}.items()])
    out = chances(marked(packed, "id", "source", "lang", "text", by), targets, keep, temper, rounds)
    return out.filter(draw("id", seed) < F.col("_chance")).select("row.*")


def oracle(keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """DuckDB SQL for the rows of :func:`mixed` over ``documents`` without targets."""
    steps, last = [], "c2"
    for i in range(rounds):
        for m in MARGINS:
            now = f"r{i}_{m}"
            own = f"sum(fit) OVER (PARTITION BY {m})"
            steps.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (least(CASE WHEN {own} > 0 THEN fit * goal_{m} / {own} ELSE 0 END, weight) AS fit) FROM {last})")
            last = now
    sums = ", ".join(f"sum(weight) OVER (PARTITION BY {m}) AS sum_{m}" for m in MARGINS)
    goals = ", ".join(f"pow(sum_{m}, {temper}) / (SELECT sum(pow(sum_{m}, {temper}) * weight / sum_{m}) FROM c1) * (SELECT sum(weight) FROM c1) * {keep} AS goal_{m}" for m in MARGINS)
    names = ", ".join(MARGINS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, chr(0) || 'none') AS source, coalesce(lang, chr(0) || 'none') AS lang, coalesce(text, '') AS x,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 20 THEN 'fragment' WHEN contains(x, '|') THEN 'table'
  WHEN regexp_matches(x, '[0-9]{{3}}') THEN 'numbers' ELSE 'prose' END AS topic FROM t),
c0 AS (SELECT {names}, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
c1 AS MATERIALIZED (SELECT *, {sums} FROM c0),
c2 AS MATERIALIZED (SELECT *, weight * {keep} AS fit, {goals} FROM c1),
{", ".join(steps)},
p AS (SELECT {names}, round(fit / weight, 9) AS chance FROM {last})
SELECT doc_id, topic, n_tokens, round(coalesce(chance, 1.0), 6) AS probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(chance, 1.0) AS kept
FROM d LEFT JOIN p USING ({names})"""
