"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles; MinHash bands find what SimHash can't.

A text is the set of its runs of five words (A-Z lower-cased; a shorter text is one run).  Two texts link where their
sets share four fifths of their union or more, counted in full on 64-bit hashes of the runs; groups are what links reach.
Candidates come first from the SimHash operator: fingerprints of the whole texts that multi-index hashing finds within
its radius.  Every such pair is then checked by its sets.  Texts at similarity 0.8 differ in about 10 bits of a fingerprint,
so the pairs beyond the radius are candidates too if they agree in all four MinHash values of one of 32 bands: a pair at
exactly 0.8 has none with probability (1 - 0.8**4)**32, under 1e-7, and closer pairs with less.

Sets are moved only of documents that are in a candidate pair, and whole documents only if they may go: a table of bits of
fixed size lets the others pass, and joins decide on the rest.

Equal sets are one node.  Nodes that meet under one band value are compared with the first of them; only those that are
still apart after that, and only under values that three or more share, are compared with each other, in the task that
meets them; they leave as a forest, never as all their pairs.

Defined results: a null text counts as empty, all texts without words are equal; rows with a null id link nothing;
columns beside the two named are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .batches import LOWER, Words, map_chunks, mixed, powers, whole_text
from .shared import components, marked, marks, settled, spread_join
from .simhash import _united

SHINGLE, BANDS, ROWS = 5, 32, 4
_STEP = powers(SHINGLE + 1, 0xD1342543DE82EF95)
_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
#: Members, and hashes, that a matrix holds when the members under one value are compared.
_BLOCK, _WIDTH = 512, 4096
#: Members and hashes of them that a task takes of one value; of more, it takes pairs of such parts.
MOST, MOST_HASHES = 2048, 1 << 21


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of each text, joined, and the ``n + 1`` bounds of its rows."""
    words = Words(column, LOWER)
    hashes, bounds = words.hashes(), words.bounds
    sizes = np.diff(bounds)
    runs = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), runs)
    start = bounds[:-1][row] + np.arange(len(row)) - (np.cumsum(runs) - runs)[row]
    found = np.minimum(sizes[row], SHINGLE).astype(np.uint64) * _STEP[SHINGLE]
    for k in range(SHINGLE):
        there = sizes[row] > k
        found[there] += hashes[start[there] + k] * _STEP[k]
    found = mixed(found)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(sizes)))])


def _node(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for the empty one."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    if len(some := np.flatnonzero(sizes)):
        out[some] = mixed(np.add.reduceat(mixed(found + np.uint64(1)), bounds[some]) + sizes[some].astype(np.uint64))
    return out


def _described(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The node (a hash of the set), the size and the band keys of each text."""
    found, bounds = shingles(column)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    if len(some):
        at = bounds[some]
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                key = mixed(key * _STEP[1] + np.minimum.reduceat((found ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), at))
            keys[some, band] = key
    return _node(found, bounds), sizes, keys


def _nodes(docs: DataFrame, id: str, text: str) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            node, sizes, keys = _described(batch.column("_text"))
            fps = np.array([simhash.fingerprint(x) for x in batch.column("_text").to_pylist()], np.uint64)
            return {"_id": batch.column("_id"), "node": node.view(np.int64), "n": sizes, "keys": [k.tobytes() for k in keys], "fp": fps.view(np.int64)}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    return map_chunks(source, make, f"_id {source.schema['_id'].dataType.simpleString()}, node long, n long, keys binary, fp long", "_text")


def _sets(docs: DataFrame, id: str, text: str, asked: np.ndarray) -> DataFrame:
    """The sets of the documents whose ids ``asked`` marks."""
    table = docs.sparkSession.sparkContext.broadcast(asked)

    def make():
        def work(batch: pa.RecordBatch) -> dict | tuple:
            batch = batch.filter(pa.array(marked(table.value, batch.column("_at").to_numpy())))
            if not batch.num_rows:
                return ()
            found, bounds = shingles(batch.column("_text"))
            return {"_id": batch.column("_id"), "_of": _node(found, bounds).view(np.int64), "hashes": [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

        return work

    source = docs.select(F.col(id).alias("_id"), F.xxhash64(id).alias("_at"), whole_text(text).alias("_text"))
    return map_chunks(source, make, f"_id {source.schema['_id'].dataType.simpleString()}, _of long, hashes binary", "_text")


def _by_key(work):
    """``work(columns)`` over rows sorted by the column ``key``, with whole keys only."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            keys = table.column("key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last:
                yield from work({c: table.column(c).to_numpy()[:last] for c in table.column_names})
            held = table.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield from work({c: held.column(c).to_numpy(zero_copy_only=False) for c in held.schema.names})

    return run


def _sorted_by_key(frame: DataFrame) -> DataFrame:
    return frame.repartition("key").sortWithinPartitions("key", "node")


def _heads(batches):
    """Under each key, of rows sorted by it, the first node with every other one, and whether more than two meet there.  Of a
    key that goes on in the next batch only its first row is kept once a third has come, so a crowded key streams through."""
    held = {c: np.zeros(0, np.int64) for c in ("key", "node", "n")}
    crowded = False

    def out(rows, head, rest, many):
        columns = [rows["key"][rest], rows["node"][head], rows["node"][rest], rows["n"][head], rows["n"][rest], many]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b", "na", "nb", "many"])

    for batch in batches:
        rows = {c: np.concatenate([held[c], batch.column(c).to_numpy()]) for c in held}
        keys = rows["key"]
        if not len(keys):
            continue
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [len(keys)]]))
        many = size > 2
        many[0] |= crowded
        crowded = bool(many[-1])
        head = np.repeat(first, size)
        rest = np.flatnonzero(head != np.arange(len(keys)))
        if not crowded:  # whether a third row comes isn't known yet
            rest = rest[rest < first[-1]]
        yield out(rows, head[rest], rest, np.repeat(many, size)[rest])
        held = {c: rows[c][first[-1] : first[-1] + 1 if crowded else None] for c in held}
    rest = np.arange(1, len(held["key"]))
    yield out(held, rest * 0, rest, np.zeros(len(rest), bool))


def _across(rows: dict):
    """Under each key the links between nodes with different labels, as a forest of labels."""
    keys = rows["key"]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        names, label = np.unique(rows["label"][a:b], return_inverse=True)
        if len(names) == 1:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"][a:b]]
        parent = np.arange(len(names))
        for left, right in _similar(sets, rows["n"][a:b], label):
            _united(parent, label[left], label[right])
        tied = np.flatnonzero(parent != np.arange(len(names)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[parent[tied]])], names=["a", "b"])


def _similar(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray):
    """All links between sets of different labels, in blocks; shared hashes are counted by products of 0-1 matrices."""
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    width = int(shared[-1]) + 1
    row = np.repeat(np.arange(len(sets)), n)
    keep = times[column] > 1
    row, column = row[keep], shared[column[keep]]
    bounds = np.searchsorted(row, np.arange(len(sets) + 1))

    def matrix(i, j, low, high):
        r, c = row[bounds[i] : bounds[j]] - i, column[bounds[i] : bounds[j]]
        here = (c >= low) & (c < high)
        out = np.zeros((j - i, high - low), np.float32)
        out[r[here], c[here] - low] = 1
        return out

    for i in range(0, len(sets), _BLOCK):
        for j in range(i, len(sets), _BLOCK):
            x, y = slice(i, min(i + _BLOCK, len(sets))), slice(j, min(j + _BLOCK, len(sets)))
            apart = (label[x, None] != label[None, y]) & _fits(n[x, None], n[None, y])
            if not apart.any():
                continue
            both = np.zeros(apart.shape, np.int64)
            for low in range(0, width, _WIDTH):
                high = min(low + _WIDTH, width)
                both += (matrix(i, x.stop, low, high) @ matrix(j, y.stop, low, high).T).astype(np.int64)
            left, right = np.nonzero(apart & (5 * both >= 4 * (n[x, None] + n[None, y] - both)))
            yield left + i, right + j


def _fits(na, nb):
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets share four fifths of their union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb")).hint("merge")
    return settled(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _parts(apart: DataFrame, most: int) -> DataFrame:
    """The nodes under values with more than one label, once for values with the same nodes, large ones as pairs of parts."""
    h = F.xxhash64("node")
    size = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / MOST_HASHES))
    open = apart.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y"), (F.min("label") != F.max("label")).alias("differ"), size.alias("g"))
    open = open.filter("differ").groupBy("k", "x", "y").agg(F.min("key").alias("_key"), F.first("g").alias("g"))
    dealt = apart.join(open.select("_key", "g").hint("merge"), F.col("key") == F.col("_key")).withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), "g"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", "n", "label")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes, with sizes, that SimHash links: fingerprints within its radius meet by multi-index
    hashing, and of equal ones each node is paired with the least."""
    heads = settled(nodes.groupBy(F.col("fp").alias("_fp")).agg(F.min(F.struct("node", "n")).alias("head")))
    segments = 3 if heads.count() <= simhash.THREE_SEGMENTS_UPTO else 2
    links = simhash.links(heads.select(F.col("_fp").alias("fp")), segments=segments)
    left, right = (heads.select(F.col("_fp").alias(f"_{c}"), F.col("head").alias(f"h{c}")).hint("merge") for c in "ab")
    across = links.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("ha", "hb")
    equal = spread_join(nodes.select("node", "n", "fp"), heads.hint("merge"), "fp", "_fp", F.col("node"))
    equal = equal.select(F.col("head").alias("ha"), F.struct("node", "n").alias("hb")).filter("ha.node != hb.node")
    every = across.unionByName(equal)
    return settled(every.select(F.col("ha.node").alias("a"), F.col("hb.node").alias("b"), F.col("ha.n").alias("na"), F.col("hb.n").alias("nb")))


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``_id`` and ``component_id``, the smallest id that links reach, for every row that has an id."""
    every = settled(_nodes(docs.filter(F.col(id).isNotNull()), id, text))
    nodes = settled(every.groupBy("node").agg(F.min("_id").alias("_first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("fp").alias("fp")))
    near = _by_fingerprint(nodes.filter("n > 0"))

    def enter(batches):
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
                columns = [keys, *(np.repeat(part.column(c).to_numpy(), BANDS) for c in ("node", "n"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n"])

    entries = nodes.filter("n > 0").select("node", "n", "keys").mapInArrow(enter, "key long, node long, n long")
    met = settled(_sorted_by_key(entries).mapInArrow(_heads, "key long, a long, b long, na long, nb long, many boolean"))
    reps = nodes.select("node", "_first")
    pairs = near.unionByName(met.select("a", "b", "na", "nb")).filter(_fits(F.col("na"), F.col("nb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = near.select("a", "b").unionByName(met.select("a", "b")).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = settled(wanted.join(reps.hint("merge"), "node"))
    own = _sets(docs, id, text, marks(wanted.select("_first")))
    sets = settled(wanted.hint("merge").join(own, (F.col("node") == F.col("_of")) & (F.col("_first") == F.col("_id"))).select("node", "hashes").dropDuplicates(["node"]))
    edges = _linked(pairs, sets)
    labels = settled(components(edges)).withColumnRenamed("node", "_node")
    apart = met.filter("many").select("key", F.col("b").alias("node"), F.col("nb").alias("n"))
    apart = settled(apart.join(labels.hint("merge"), F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    more = settled(_sorted_by_key(_parts(apart, most).join(sets.hint("merge"), "node")).mapInArrow(_by_key(_across), "a long, b long"))
    if not more.isEmpty():
        labels = settled(components(edges.unionByName(more))).withColumnRenamed("node", "_node")
    named = reps.join(labels.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "_first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("_first").alias("component_id"))
    named = named.join(least.hint("merge"), "label").select(F.col("node").alias("_named"), "component_id")
    return spread_join(every.select("_id", "node"), named.hint("merge"), "node", "_named", F.col("_id")).select("_id", "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its group, with all their columns; rows with a null id stay."""
    gone = settled(grouped(docs, id, text).filter("component_id < _id").select(F.col("_id").alias("_gone")).distinct())
    table = docs.sparkSession.sparkContext.broadcast(marks(gone))

    @F.pandas_udf("boolean")
    def may_go(hashes: pd.Series) -> pd.Series:
        return pd.Series(marked(table.value, hashes.to_numpy()))

    may = may_go(F.xxhash64(F.col(id)))
    gone = gone.alias("_g").hint("merge")  # one plan at every size: how many go has no bound
    return docs.filter(~may).union(docs.filter(may).alias("_d").join(gone, F.col(f"_d.`{id}`") == F.col("_g._gone"), "left_anti"))
