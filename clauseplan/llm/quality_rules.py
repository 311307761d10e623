"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample of documents: those with the least hashes of all partitions,
bounded in rows and in characters of each.  The rule with the most rejections per second comes first; the others are
measured again on what it leaves, with the facts that are known by then, and so on.  A document leaves at the first rule
that rejects it.  The order changes how much work is done, never the verdict: a document is kept if, and only if, no rule
rejects it.  What a rule needs of a text (its words, lines, repeated windows) is computed at first use and shared by
later rules.  Costs are times, so rules of about the same gain may change places between runs.

Defined results: a null text counts as empty and has no words; a null id passes through; an empty table gives an
empty result; repeated rows are judged alike, one by one; columns beside the two named are never read.
"""

from __future__ import annotations

import copy
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import SPACE, WORD_PATTERN, map_chunks, whole_text

_WORD = re.compile(WORD_PATTERN)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents on which costs and selectivities are estimated, and the characters of each that are looked at for that.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 4096


class Facts:
    """What rules ask about one text, each computed once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.text.split("\n") if x.strip(SPACE)]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of eight words that the text holds twice or more."""
        n = self.n_words
        if n <= WINDOW:
            return 0
        seen: dict[str, int] = {}
        ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        if n - len(seen) < WINDOW:  # the second of two equal windows, even if they overlap, has eight words seen before
            return 0
        step = 1
        while step < WINDOW:  # ranks of windows of 2, 4 and 8 words: equal ranks, equal windows
            _, ranks = np.unique(ranks[:-step] * np.int64(n + 1) + ranks[step:], return_inverse=True)
            step *= 2
        twice = np.bincount(ranks)[ranks] > 1
        change = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
        return int((np.cumsum(change[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects(facts)`` is true for a document that must go."""

    name: str
    rejects: Callable[[Facts], bool]


def _too_few(x: Facts) -> bool:
    return x.n_words < 20


def _repeats(x: Facts) -> bool:
    return 100 * x.n_repeat_words > 30 * x.n_words


def _symbols(x: Facts) -> bool:
    return 100 * x.n_symbols > 10 * x.n_words


def _same_lines(x: Facts) -> bool:
    return 100 * x.n_dup_lines > 30 * x.n_lines


def _word_length(x: Facts) -> bool:
    return not 2 * x.n_words <= x.word_chars <= 20 * x.n_words


BASE_RULES = (Rule("too_few_words", _too_few), Rule("repeated_windows", _repeats))
RULES = (*BASE_RULES, Rule("symbols", _symbols), Rule("same_lines", _same_lines), Rule("word_length", _word_length))


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """The openings of the texts with the least hashes of id and opening: the same for the same rows, however dealt."""
    share = min(1.0, 4 * rows / max(docs.count(), 1))  # so that partitions don't each send ``rows`` openings to the driver
    opening = F.substring(whole_text(text), 1, chars)
    hashed = docs.select(F.xxhash64(F.col(id), opening).alias("_h"), opening.alias("_opening"))
    few = hashed.filter(F.shiftrightunsigned("_h", 33) < F.lit(int(share * (1 << 31)))).orderBy("_h", "_opening").limit(rows)
    return [r["_opening"] for r in few.collect()]  # rows * chars characters at most


def measured(rule: Rule, facts: list[Facts]) -> tuple[list[bool], float]:
    """A rule's verdicts and seconds on texts of which some facts are known; what it adds to them is not kept."""
    own = [copy.copy(x) for x in facts]
    began = time.perf_counter()
    verdicts = [rule.rejects(x) for x in own]
    return verdicts, time.perf_counter() - began


def ordered(rules: tuple[Rule, ...], estimates: list[dict]) -> tuple[Rule, ...]:
    """Rules by falling rejections per second; ties, and an empty sample, leave them as given."""
    gain = [-(e["rejected"] / e["seconds"]) if e["seconds"] else 0.0 for e in estimates]
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (gain[i], i)))


def planned(rules: tuple[Rule, ...], texts: list[str], measure: Callable = measured) -> tuple[Rule, ...]:
    """The cascade's order: the rule with the most rejections per second, then the one with the most on what that leaves, and
    so on.  Rules that reject nothing there come last, as given."""
    left, out = list(rules), []
    facts = [Facts(x) for x in texts]
    while left and facts:
        found = [measure(rule, facts) for rule in left]
        first = ordered(tuple(left), [{"rejected": sum(v), "seconds": t} for v, t in found])[0]
        verdicts, _ = found[left.index(first)]
        if not any(verdicts):
            break
        left.remove(first)
        out.append(first)
        for x in facts:
            first.rejects(x)  # its facts are known from now on
        facts = [x for x, gone in zip(facts, verdicts, strict=True) if not gone]
    return (*out, *left)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: its id, ``rejected_by`` (the first rule in the estimated order that rejects it, or null) and ``kept``.
    Which of several rejecting rules is named may differ between runs; ``kept`` may not."""
    order = planned(rules, sample(docs, id, text, sample_rows))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            names = []
            for x in batch.column("_text").to_pylist():
                facts = Facts(x)
                names.append(next((r.name for r in order if r.rejects(facts)), None))
            return {"_id": batch.column("_id"), "rejected_by": names}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    out = map_chunks(source, make, f"_id {kind}, rejected_by string", "_text")
    return out.select(F.col("_id").alias(id), "rejected_by", F.col("rejected_by").isNull().alias("kept"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document its counts beside the cascade's verdict.  The counts are wanted of every document, so the cascade
    saves only the rules that need more than them."""
    order = planned(rules, sample(docs, id, text, sample_rows))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in (*counts, "base_failed", "kept")}
            for x in batch.column("_text").to_pylist():
                facts = Facts(x)
                kept = not any(r.rejects(facts) for r in order)
                failed = any(r.rejects(facts) for r in BASE_RULES)
                for k in counts:
                    out[k].append(getattr(facts, k))
                out["base_failed"].append(failed)
                out["kept"].append(kept and not failed)
            return out | {"_id": batch.column("_id")}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    out = map_chunks(source, make, f"_id {kind}, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean", "_text")
    return out.withColumnRenamed("_id", id)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns, in one pass and without a shuffle."""
    order = planned(rules, sample(docs, id, text, sample_rows))
    at = docs.columns.index(text)

    def run(batches):
        from .batches import slices

        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=names), f"c{at}"):
                keep = []
                for x in part.column(at).to_pylist():
                    facts = Facts(x or "")
                    keep.append(not any(r.rejects(facts) for r in order))
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep, pa.bool_())).columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
