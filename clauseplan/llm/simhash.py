"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits.  Cut into segments, two linked fingerprints differ by
at most ``radius // segments`` bits in one of them.  Each distinct fingerprint is entered in a table under the value of
each segment, and probes the values of the small Hamming ball around it; whoever meets is compared in full.  With a ball
of one bit, only bits that are off are flipped on: of two values one bit apart, exactly one probes the other.

Equal fingerprints are one entry, so exact copies cost nothing here.  Entries that meet under one value are united in
that task and leave as a forest, never as all their pairs.  A value that more than ``most`` entries meet under is not
compared pair by pair at all: two fingerprints are within 4 bits if, and only if, some 64-bit string is within 2 bits of
both, so its entries are united through those strings, by a distributed aggregate that grows in proportion to them.

Defined results: a null text counts as empty, an empty text has fingerprint zero; rows with a null id get a fingerprint,
link nothing and have a null component; repeated rows share their component; an empty table gives an empty result;
columns beside the two named are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_chunks, whole_text
from .shared import components, cut, spread_join

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Entries under one table value that are compared pair by pair.
MOST = 4096
#: Up to so many distinct fingerprints three segments keep the lists under a value short; beyond, two segments do.
THREE_SEGMENTS_UPTO = 1 << 27
_PAIRS = 2 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    counts = np.zeros(64, np.int64)
    ends = (ends - 1)[shingle - 1 :].tolist()
    for k in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 15)], ends[k : k + (1 << 15)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id`` and ``fp``, the fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(x) for x in batch.column("_text").to_pylist()], np.uint64)
            return {"_id": batch.column("_id"), "fp": found.view(np.int64)}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    return map_chunks(source, make, f"_id {source.schema['_id'].dataType.simpleString()}, fp long", "_text")


def _cuts(segments: int) -> list[tuple[int, int]]:
    """The shift and the width of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def table_entries(fps: np.ndarray, segments: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all entries: own values (even keys), then probed values (odd keys)."""
    reach = radius // segments
    fps = fps.view(np.uint64)
    keys, owners = [], []
    one = np.uint64(1)
    for number, (shift, width) in enumerate(_cuts(segments)):
        value = fps >> np.uint64(shift) & np.uint64((1 << width) - 1)
        top = np.uint64(number << (width + 1))
        keys.append(top + (value << one))
        owners.append(fps)
        if reach == 1:
            for bit in range(width):
                off = value >> np.uint64(bit) & one == 0
                keys.append(top + ((value[off] | np.uint64(1 << bit)) << one) + one)
                owners.append(fps[off])
        else:
            for k in range(1, reach + 1):
                for bits in combinations(range(width), k):
                    keys.append(top + ((value ^ np.uint64(sum(1 << b for b in bits))) << one) + one)
                    owners.append(fps)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners).view(np.int64)


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite positions a[i] and b[i]; roots are the smallest positions."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(parent, a, b)


def meetings(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by key, with whole values only: forest edges, as two arrays, and the fingerprints under values
    that more than ``most`` entries meet under."""
    value = keys >> 1
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(keys)]]))
    own = np.add.reduceat((keys & 1 == 0).astype(np.int64), first) if len(keys) else size
    hot = (size > most) & (own > 0)
    crowd = np.unique(fps[np.repeat(hot, size)])
    place = np.arange(len(keys)) - np.repeat(first, size)
    partners = np.where(np.repeat(hot, size), 0, np.minimum(place, np.repeat(own, size)))
    parent = np.arange(len(keys))
    upto = np.cumsum(partners)
    at = 0
    while at < len(keys):
        base = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + _PAIRS, side="right")))
        n = partners[at:stop]
        right = np.repeat(np.arange(at, stop), n)
        left = np.repeat(np.repeat(first, size)[at:stop], n) + np.arange(len(right)) - np.repeat(upto[at:stop] - n - base, n)
        near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= radius
        _united(parent, left[near], right[near])
        at = stop
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    tied = np.flatnonzero(parent != np.arange(len(keys)))
    return fps[tied], fps[parent[tied]], crowd


def links(fps: DataFrame, radius: int = RADIUS, segments: int = 3, most: int = MOST) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct fingerprints in column ``fp`` exactly as all links would."""

    def enter(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy()
            for k in range(0, len(every), 4096 if segments > 2 else 256):
                keys, owners = table_entries(every[k : k + (4096 if segments > 2 else 256)], segments, radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], names=["key", "fp"])

    entries = fps.mapInArrow(enter, "key long, fp long")
    dealt = entries.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def meet(batches):
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowded = None  # the value whose entries pass straight through, as more than ``most`` are known to meet under it

        def edges(a, b):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b)], names=["a", "b"])

        def out(keys, own):
            a, b, crowd = meetings(keys, own, radius, most)
            return edges(np.concatenate([a, crowd]), np.concatenate([b, crowd]))

        for batch in batches:
            keys, own = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            if crowded is not None:
                n = int(np.searchsorted(keys, crowded << 1 | 1, side="right"))
                if owned:
                    yield edges(own[:n], own[:n])
                keys, own = keys[n:], own[n:]
            keys, own = np.concatenate([held_keys, keys]), np.concatenate([held, own])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1] >> 1 << 1))  # the last value may go on in the next batch
            yield out(keys[:last], own[:last])
            held_keys, held, crowded = keys[last:], own[last:], None
            if len(held) > most:  # a value's own entries come first; without one, its entries have no partner
                crowded, owned = int(held_keys[0]) >> 1, held_keys[0] & 1 == 0
                if owned:
                    yield edges(held, held)
                held_keys, held = held_keys[:0], held[:0]
        if len(held):
            yield out(held_keys, held)

    found = cut(dealt.mapInArrow(meet, "a long, b long"))
    edges = found.filter("a != b")
    crowd = found.filter("a = b").select(F.col("a").alias("fp")).distinct()
    if radius != 4 or crowd.isEmpty():
        return edges
    masks = [0, *(sum(1 << b for b in bits) for k in (1, 2) for bits in combinations(range(64), k))]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    around = crowd.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    around = around.repartition("centre")  # moved once, for the least and for the join; no centre has over 2081 rows
    least = around.groupBy("centre").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("centre", "b")
    through = around.join(least, "centre").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return edges.unionByName(through)


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int | None = None, most: int = MOST) -> DataFrame:
    """Per document: id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``, the smallest id that links reach."""
    every = cut(fingerprints(docs, id, text))
    nodes = every.filter("_id is not null").groupBy("fp").agg(F.min("_id").alias("_first"))
    if radius != RADIUS and most < 1 << 40:
        most = 1 << 40  # the way through centres holds for 4 bits
    if segments is None:
        segments = 3 if nodes.count() <= THREE_SEGMENTS_UPTO else 2
    labels = cut(components(links(nodes.select("fp"), radius, segments, most)))
    tied = labels.join(nodes, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("_first").alias("_least"))
    least = labels.join(tied, "label").select(F.col("node").alias("_node"), "_least")
    named = nodes.join(least, F.col("fp") == F.col("_node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("_least", "_first").alias("component_id"))
    joined = spread_join(every, named, "fp", "_fp", F.col("_id"))
    return joined.select(F.col("_id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns; rows with a null id stay."""
    gone = grouped(docs, id, text).filter(F.col("component_id") < F.col(id)).select(F.col(id).alias("_gone")).distinct()
    gone = gone.alias("_g").hint("merge")  # one plan at every size: how many go has no bound
    return docs.alias("_d").join(gone, F.col(f"_d.`{id}`") == F.col("_g._gone"), "left_anti")
