"""LM scoring by prediction by partial matching: byte contexts, escape estimation, symbol exclusion.

The model is pretrained on the training documents: the counts of every context of up to ``ORDER`` bytes and its next byte.
A byte is predicted from its longest context that the counts know; a byte not seen there escapes to the next shorter
one, from which all bytes seen in the longer are excluded, and in the end to equal shares of what is left.  With ``n``
counts and ``d`` distinct bytes left in a context, a byte seen ``c`` times has ``(2 c - 1) / (2 n)`` and the escape
``d / (2 n)``.
A text is coded as its UTF-8 bytes with A-Z lower-cased and one end; it starts in a context of ends.

An event is a full context with its next byte.  Its probability depends on nothing else, so the trie is walked once for
each distinct event of the corpus.  Documents are dealt by hash to parts of about ``PART_BYTES``; each part asks once for
every distinct event and word in it (``asked``), and gets probabilities and counts back by one join (``scores``), whatever
their number.  So texts are read twice at every size, and a task holds the distinct events of its part.

The trie is walked in groups that share the last two bytes of the context and hold the whole subtrie below them.  A context
with more than one in ``GROUPS`` of all events is split by its next byte, and so on down to full contexts, which have 256
events at most.  What a group needs of the shorter contexts it lies under are at most 256 events for each of these; contexts
that were split are fewer than ``GROUPS`` an order, so these tables are broadcast.

Defined results: a null text counts as empty, and has the end alone; a null id is held out (as the empty text); repeated
rows train as often as they occur and score alike (rows equal in id and text share a part, which streams them); without training documents every byte has 1/256, and ``base_score`` is
taken with ``N = V = 0``; an empty table gives an empty result; columns beside the two named are never read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LOWER, Words, joined_bytes, map_chunks, whole_text
from .shared import checkpoint_folder, cut

ORDER, END, ALPHABET = 5, 0xFF, 256
#: Bytes of text in a part, events that a task holds before it passes them on, and groups that all events are cut into at least.
PART_BYTES, BLOCK, GROUPS = 32 << 20, 4_000_000, 1024
#: Bytes of text at once, for counting and for scoring: every byte becomes several 64-bit numbers.
TEXT_BYTES, SCORED_BYTES = 2 << 20, 1 << 19


class Trie:
    """One text's or one small corpus's contexts in memory: the adaptive form, and the reference for the distributed one."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, {}

    def probability(self, context: bytes, symbol: int) -> float:
        p, excluded = 1.0, frozenset()
        for k in range(min(self.order, len(context)), -1, -1):
            counts = self.seen.get(context[len(context) - k :])
            if not counts:
                continue
            left = {s: c for s, c in counts.items() if s not in excluded}
            total = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / total
            if left:
                p *= len(left) / total
            excluded = counts.keys()
        return p / (ALPHABET - len(excluded))

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            counts = self.seen.setdefault(context[len(context) - k :], {})
            counts[symbol] = counts.get(symbol, 0) + 1

    def events(self, text: str):
        data = bytes([END]) * self.order + text.encode().lower() + bytes([END])
        return ((data[i - self.order : i], data[i]) for i in range(self.order, len(data)))

    def train(self, text: str) -> None:
        for context, symbol in self.events(text):
            self.add(context, symbol)

    def score(self, text: str, adaptive: bool = False) -> float:
        """The base-10 logarithm of the text's probability; with ``adaptive``, learning from it on the way."""
        out = 0.0
        for context, symbol in self.events(text):
            out += math.log10(self.probability(context, symbol))
            if adaptive:
                self.add(context, symbol)
        return out


def adaptive_scores(docs: DataFrame, order: int = ORDER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and ``score``, by a model that starts empty and learns from the document alone."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"_id": batch.column("_id"), "score": [Trie(order).score(x, adaptive=True) for x in batch.column("_text").to_pylist()]}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    return map_chunks(source, make, f"_id {source.schema['_id'].dataType.simpleString()}, score double", "_text").withColumnRenamed("_id", id)


def held_out(id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def events(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The events of a chunk as numbers (context bytes, then the byte), end to end, and the bounds of its rows."""
    data, offsets = joined_bytes(column)
    rows = len(offsets) - 1
    gap = order + 1  # before each row a context of ends; behind the last its end
    wide = np.full(len(data) + gap * rows, END, np.int64)
    sizes = np.diff(offsets)
    starts = np.arange(rows) * gap + offsets[:-1] + order
    wide[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = LOWER[data]
    key = np.zeros(max(len(wide) - order, 0), np.int64)
    for k in range(order + 1):
        key = key << 8 | wide[k : k + len(key)]
    upto = np.concatenate([[0], np.cumsum(sizes + 1)])
    return key[np.arange(upto[-1]) + np.repeat(starts - order - upto[:-1], sizes + 1)], upto


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, counts, len(own)).astype(np.int64)


def asked(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``part``, ``word``, ``key`` and ``n``: the distinct events (``word`` is false) and hashes of words of each part, and how
    often the training documents in it have them (0 if only others do).  A part that holds more than ``BLOCK`` may name a key
    more than once."""

    def make():
        held: dict[bool, list] = {False: [], True: []}
        part: list[int] = []

        def settle(word: bool, force: bool):
            keys, counts = (np.concatenate(x) for x in zip(*held[word], strict=True))
            held[word][:] = [_sums(keys, counts)]
            if force or len(held[word][0][0]) > BLOCK:
                keys, counts = held[word].pop()
                yield {"part": np.full(len(keys), part[0]), "word": np.full(len(keys), word), "key": keys, "n": counts}

        def work(batch: pa.RecordBatch):
            part[:] = [batch.column("_part")[0].as_py()]
            text, train = batch.column("_text"), ~batch.column("_held").to_numpy(zero_copy_only=False)
            keys, upto = events(text, order)
            words = Words(text, LOWER)
            for word, every, per in (False, keys, np.diff(upto)), (True, words.hashes().view(np.int64), np.diff(words.bounds)):
                mine = np.repeat(train, per)
                rest = np.unique(every[~mine])
                held[word] += [_sums(every[mine]), (rest, np.zeros(len(rest), np.int64))]
                if len(held[word]) > 16:
                    yield from settle(word, False)

        def finish():
            for word in held:
                if held[word]:
                    yield from settle(word, True)

        work.finish = finish
        return work

    return map_chunks(docs, make, "part int, word boolean, key long, n long", "_text", TEXT_BYTES)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class _Level:
    """Counts of one order: per event, and per context its sum and its distinct bytes."""

    def __init__(self, events: np.ndarray, counts: np.ndarray):
        self.events, self.counts = _sums(events[counts > 0], counts[counts > 0])
        self.contexts, at = np.unique(self.events >> 8, return_inverse=True)
        self.total = np.bincount(at, self.counts, len(self.contexts))
        self.distinct = np.bincount(at, minlength=len(self.contexts))


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> np.ndarray:
    """The base-10 logarithms of the probabilities of some events.  ``keys`` and ``counts`` must hold every event whose
    context ends in the bytes that these contexts share, ``len(low)`` in number; ``low``: of each order below that, from 0 on, the
    events, sorted, and their counts, at least those in the contexts that these bytes end in."""
    out = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    above: _Level | None = None
    for k in range(order, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        mine = keys & mask
        if k >= len(low):
            level = _Level(mine, counts)
        else:
            context = int(mine[0]) >> 8
            at = slice(*np.searchsorted(low[k][0], [context << 8, (context + 1) << 8]))
            level = _Level(low[k][0][at], low[k][1][at])
        c = _lookup(level.events, level.counts, mine)
        total = _lookup(level.contexts, level.total, mine >> 8)
        distinct = _lookup(level.contexts, level.distinct, mine >> 8)
        if above is not None:  # what the next longer context has seen is excluded
            shadow = _lookup(level.events, level.counts, above.events & mask)
            at = np.searchsorted(above.contexts, above.events >> 8)
            taken = np.bincount(at, shadow, len(above.contexts))
            longer = keys >> 8 & mask
            total = total - _lookup(above.contexts, taken, longer)
            distinct = distinct - _lookup(above.contexts, above.distinct, longer)
        hit = open_ & (c > 0)
        miss = open_ & (c == 0) & (distinct > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2 * total[hit]))
        out[miss] += np.log10(distinct[miss] / (2 * total[miss]))
        open_ &= ~hit
        above = level
    seen = len(above.events)
    out[open_] -= np.log10(ALPHABET - seen) if seen < ALPHABET else 0.0
    return out


def event_table(counts: DataFrame, order: int = ORDER, groups: int = GROUPS) -> DataFrame:
    """``event`` and ``lp``, the base-10 logarithm of its probability, from ``event`` and ``n``.  ``groups`` changes no result."""
    context, seen = F.shiftright("event", 8), counts.filter("n > 0")

    def suffix(length: int) -> Column:
        return context.bitwiseAND(F.lit((1 << 8 * length) - 1))

    def lower(frame: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The events of order k, and their counts."""
        part = frame.groupBy(F.col("event").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("e")).agg(F.sum("n").alias("n")).toArrow()
        return _sums(*(part.column(c).to_numpy().astype(np.int64) for c in ("e", "n")))

    low = [lower(seen, 0), lower(seen, 1)]  # 256 and 65,536 at most
    most = max(counts.count() // groups, 1)
    depth = F.lit(2)
    for k in range(2, order):
        crowded = counts.filter(depth == k).groupBy(suffix(k).alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > most)
        crowded = crowded.select("c").toArrow().column("c").to_pylist()  # fewer than ``groups``
        if not crowded:
            break
        split = (depth == k) & suffix(k).isin(crowded)
        low.append(lower(seen.filter(split), k))  # 256 a context at most
        depth = F.when(split, k + 1).otherwise(depth)
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        keys = table.column("event").to_numpy()
        return pa.table({"event": keys, "lp": log_probabilities(keys, table.column("n").to_numpy(), shared.value[: key[0].as_py()], order)})

    dealt = counts.select("event", "n", depth.alias("depth")).withColumn("suffix", suffix_of(context, F.col("depth")))
    return dealt.groupBy("depth", "suffix").applyInArrow(walk, "event long, lp double")


def suffix_of(context: Column, length: Column) -> Column:
    """The last bytes of a context, ``length`` in number."""
    return context.bitwiseAND(F.pow(F.lit(256), length).cast("long") - 1)


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, part_bytes: int = PART_BYTES, groups: int = GROUPS) -> DataFrame:
    """Per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``part_bytes`` and ``groups`` change no result.  The result reads what parts ask for from the shared checkpoint folder."""
    if not 2 <= order <= 6:
        raise ValueError("an order from 2 to 6 fits a 64-bit event")
    spark = docs.sparkSession
    source = docs.select(F.col(id).alias("_id"), held_out(id).alias("_held"), whole_text(text).alias("_text"))
    facts = source.agg(F.coalesce(F.sum(F.octet_length("_text") + 1), F.lit(0)).alias("bytes"), F.count_if(~F.col("_held")).alias("ends")).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-facts["bytes"] // part_bytes))
    source = source.withColumn("_part", F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)).cast("int"))

    folder = f"{checkpoint_folder(spark)}/asked-{uuid.uuid4().hex}"
    asked(source.drop("_id").repartitionById(parts, "_part"), order).write.parquet(folder)
    wanted = spark.read.parquet(folder)
    counts = cut(wanted.groupBy("word", "key").agg(F.sum("n").alias("n")))
    words = counts.filter("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends, total = facts["ends"], words["n"] + facts["ends"]
    share = math.log10(total + 0.1 * (words["v"] + (ends > 0) + 1))

    table = event_table(counts.filter("not word").select(F.col("key").alias("event"), "n"), order, groups)
    values = table.select(F.lit(False).alias("word"), F.col("event").alias("key"), F.col("lp").alias("value"))
    values = values.unionByName(counts.filter("word").select("word", "key", F.col("n").cast("double").alias("value")))
    answers = wanted.select("part", "word", "key").join(values, ["word", "key"]).withColumnRenamed("part", "_part")
    every = source.unionByName(answers, allowMissingColumns=True).repartitionById(parts, "_part")
    every = every.sortWithinPartitions(F.col("_text").isNotNull())  # a part's answers come before its documents

    def make():
        held: dict[bool, list] = {False: [], True: []}
        known: dict[bool, tuple] = {}

        def take(batch: pa.RecordBatch) -> None:
            word = batch.column("word").to_numpy(zero_copy_only=False).astype(bool)
            key, value = batch.column("key").to_numpy(), batch.column("value").to_numpy()
            for kind in held:
                held[kind].append((key[word == kind], value[word == kind]))

        def settle() -> None:
            for kind, taken in held.items():
                keys, values = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64), np.zeros(0))
                by_key = np.argsort(keys)
                known[kind] = keys[by_key], values[by_key]
                taken.clear()

        def look_up(kind: bool, wanted: np.ndarray) -> np.ndarray:
            keys, values = known[kind]
            order = np.argsort(wanted)  # in order, neighbours are found in the same cache lines
            wanted = wanted[order]
            at = np.searchsorted(keys, wanted)
            if len(at) and (at[-1] == len(keys) or (keys[at] != wanted).any()):
                raise RuntimeError("a part holds a text that it did not ask for; the input changed between two reads")
            out = np.empty(len(order))
            out[order] = values[at]
            return out

        def work(batch: pa.RecordBatch):
            is_text = pc.is_valid(batch.column("_text"))
            if answer := batch.num_rows - is_text.true_count:
                take(batch.slice(0, answer))
                batch = batch.slice(answer)
            if not batch.num_rows:
                return
            if not known:
                settle()
            text = batch.column("_text")
            wanted, upto = events(text, order)
            words = Words(text, LOWER)
            per = np.diff(words.bounds)
            row = np.repeat(np.arange(len(per)), per)
            c = look_up(True, words.hashes().view(np.int64))
            base = np.bincount(row, np.log10(c + 0.1), len(per)) + math.log10(ends + 0.1) - (per + 1) * share
            found = np.bincount(row, c > 0, len(per)).astype(np.int64) + (ends > 0)
            yield {
                "_id": batch.column("_id"),
                "held_out": batch.column("_held"),
                "n_tokens": per + 1,
                "n_known": found,
                "train_tokens": np.full(len(per), total),
                "base_score": base,
                "score": np.add.reduceat(look_up(False, wanted), upto[:-1]),
            }

        return work

    kind = source.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_chunks(every, make, shape, "_text", SCORED_BYTES).withColumnRenamed("_id", id)
