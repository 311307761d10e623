"""Suffix-array dedup: bytes covered by a long string that starts in a document with a smaller id are removed.

The suffix array is built in linear time by grouping.  Phase one keeps suffixes in groups by a prefix of their Lyndon
prefix and takes the groups in falling order: each suffix of the group points to the nearest position before it that is
in a lower group, and the suffixes so pointed at move, by how often, into new groups right above their old ones.
Then a group is one Lyndon prefix.  Phase two goes through the array once and puts each suffix, and along the pointers
those before it, at the next free place of its group.  No rank is ever renamed recursively.

Whole texts are not sorted in one place.  A match of ``LENGTH`` bytes is a window; what is shared is found in steps:

1.  Texts are cut where their content says so, about every 256 bytes.  Of equal blocks (with the bytes that windows of
    the block reach into) the one with the smallest id stays; the windows of the others are settled.
2.  Every window left has an anchor, the 20 bytes in it with the least hash.  Anchors that two documents have are found by
    their hashes, dealt to tasks by hash.
3.  The windows around such an anchor, as one segment, meet under the anchor's hash; equal segments meet as one.  Where
    different segments meet, their suffix array says which windows are equal, and which ids hold them.

A block or segment that many documents hold leaves each chunk of documents once, and a segment that a document repeats
leaves it once, with its places as progressions.  An anchor that many documents hold with different surroundings is found
beforehand in chunks, or, if it crowds none of them, by the task that counts its documents; its windows then meet by their
own content, one by one, so no task gathers them.  Which anchors those are changes no result.

So blocks and windows are found by hashes, and the suffix array has the last word on windows of different segments.  Blocks
are equal if their 128-bit digests are; segments and pieces are compared byte by byte wherever a shorter hash has matched.
Texts longer than ``PART`` are worked on in parts that overlap by a window, so memory doesn't grow with a text's length
beyond the text itself.

Ids are longs.  Defined results: a null text counts as empty; rows with a null id lose nothing and take nothing from
others; rows with equal ids take nothing from each other; repeated rows give equal rows; texts under ``LENGTH`` bytes
stay; an empty table gives an empty result; columns beside the two named are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import joined_bytes, map_chunks, mixed, powers, whole_text
from .shared import settled

LENGTH, ANCHOR = 50, 20
SPAN = LENGTH - ANCHOR + 1
TILE = 1 << 15
#: Bytes of one text that are worked on at once.
PART = 1 << 20
NO_HASH = 0
#: Blocks end at grams of 16 bytes with eight zero bits in their hash and no such gram in the 32 bytes before.
BLOCK_BITS, BLOCK_GRAM, BLOCK_GAP = 8, 16, 32
#: Anchors treated window by window: so many at most, each in this share of some chunk's documents.
COMMON, COMMON_SHARE, COMMON_LEAST = 4096, 0.01, 8
#: Documents of an anchor from which on its windows go by their own content.
HEAVY = 1024
#: Bytes of different pieces that share one suffix array, at least those of a whole anchor.
ARRAY_BYTES = 128 << 10
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of some non-negative numbers of which the last is smaller than all others."""
    n = len(text)
    if n <= 1:
        return list(range(n))
    array = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(array):
        if text[i] != text[array[start]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    before = [-1] * n

    low = n
    while low > 0:
        low = group[array[low - 1]]
        if size[low] == 1:
            i = array[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0 and size[g := group[p]] > 1:
                top = g + size[g] - 1
                j, at = array[top], place[p]
                array[at], array[top], place[j], place[p] = j, p, at, top
                size[g] -= 1
                size[top], group[p] = 1, top
            continue
        hits: dict[int, int] = {}
        for i in sorted(array[low : low + size[low]]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        by_hits: dict[int, list[int]] = {}
        for p, k in hits.items():
            by_hits.setdefault(k, []).append(p)
        for k in sorted(by_hits, reverse=True):
            moved: dict[int, int] = {}
            for p in by_hits[k]:  # to the end of its group
                g = group[p]
                done = moved.get(g, 0)
                top = g + size[g] - 1 - done
                j, at = array[top], place[p]
                array[at], array[top], place[j], place[p] = j, p, at, top
                moved[g] = done + 1
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    new = g + size[g]
                    size[new] = m
                    for at in range(new, new + m):
                        group[array[at]] = new

    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def window_owners(segments: list[bytes], ids: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each segment (in which it starts at 0, 1, ...), the smallest id of any segment that has it."""
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text = data.astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    order = np.array(suffix_array([*text.tolist(), 0]))[1:]
    starts = ends - sizes
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    whole = order[order + length <= ends[owner[order]]]
    same = np.zeros(len(whole), bool)
    reach = np.arange(length)
    for k in range(1, len(whole), 1 << 15):
        a, b = whole[k - 1 : k - 1 + (1 << 15)], whole[k : k + (1 << 15)]
        same[k : k + len(b)] = (data[a[: len(b), None] + reach] == data[b[:, None] + reach]).all(axis=1)
    first = np.flatnonzero(~same)
    held = np.array(ids, np.int64)[owner[whole]]
    least = np.repeat(np.minimum.reduceat(held, first), np.diff(np.concatenate([first, [len(whole)]]))) if len(whole) else held
    found = np.zeros(len(data), np.int64)
    found[whole] = least
    return [found[a : a + max(n - length + 1, 0)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


class Chunk:
    """Hashes over the joined bytes of a chunk."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = joined_bytes(column)
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, size: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes that start from ``start`` up to ``end``."""
        n = len(self.data) - size + 1
        end = n if end is None else min(n, end)
        if end <= start:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[start + size : end + size] - self.sums[start:end]) * self.back[start:end] + np.uint64(size))

    def windows(self) -> np.ndarray:
        """Which positions start a whole window of their row."""
        out = np.ones(len(self.data), bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            out[max(a, b - LENGTH + 1) : b] = False
        return out

    def segments(self, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run of fresh windows with one anchor, and the anchor's hash.  Where a tile ends a
        run may come in two parts, which meet under the same anchor all the same."""
        nothing = np.zeros(0, np.int64)
        n = len(self.data) - ANCHOR + 1
        if n < SPAN or not fresh.any():
            return nothing, nothing, np.zeros(0, np.uint64)
        starts, lasts, hashes = [], [], []
        for tile in range(0, n - SPAN + 1, TILE):  # small enough for a processor's cache
            end = min(tile + TILE, n - SPAN + 1)
            at = np.flatnonzero(fresh[tile:end])
            if not len(at):
                continue
            h = self.grams(ANCHOR, tile, end + SPAN - 1)
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= SPAN:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = SPAN - width
            least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            own = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            starts.append(at[first] + tile)
            lasts.append(at[np.concatenate([first[1:], [len(at)]]) - 1] + tile)
            hashes.append(h[own[first]])
        return np.concatenate(starts), np.concatenate(lasts), np.concatenate(hashes)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1


def _parts(batch: pa.RecordBatch):
    """The batch and 0; or, of a single text longer than ``PART``, a batch for each part of it and where the part begins.
    Parts overlap by a window less one byte, so each window is whole in just one."""
    column = batch.column("_text")
    size = pc.binary_length(column[0]).as_py() if batch.num_rows == 1 else 0
    if size <= PART:
        yield batch, 0
        return
    body = column[0].as_buffer()
    others = {c: batch.column(c) for c in batch.schema.names}
    for start in range(0, size - LENGTH + 1, PART):
        part = pa.array([body.slice(start, min(PART + LENGTH - 1, size - start)).to_pybytes()], pa.binary())
        yield pa.RecordBatch.from_pydict(others | {"_text": part}), start


def _merged(rows: np.ndarray) -> np.ndarray:
    """Ranges of each document with those united that overlap or touch."""
    rows = rows[np.lexsort((rows["a"], rows["s"], rows["i"]))]
    if not len(rows):
        return rows
    doc = np.zeros(len(rows), np.int64)
    doc[_firsts(rows["i"], rows["s"])] = 1
    base = np.cumsum(doc) << 33
    reach = np.maximum.accumulate(base + rows["b"])
    first = np.flatnonzero(np.concatenate([[True], base[1:] + rows["a"][1:] > reach[:-1]]))
    out = rows[first]
    out["b"] = reach[np.concatenate([first[1:], [len(rows)]]) - 1] - base[first]
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` are those from ``b``, for each pair of places, in blocks of a bounded number of bytes."""
    out = np.ones(len(a), bool)
    upto = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 20), side="right")) - 1)
        n = size[at:stop]
        shift = np.arange(upto[stop] - upto[at]) - np.repeat(upto[at:stop] - upto[at], n)
        differs = data[np.repeat(a[at:stop], n) + shift] != data[np.repeat(b[at:stop], n) + shift]
        out[at:stop] = ~np.logical_or.reduceat(differs, upto[at:stop] - upto[at])
        at = stop
    return out


def _alike(chunk: Chunk, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each string of the chunk, the same for equal strings only.  Strings that share a 64-bit hash with the
    first of their kind but not its bytes get numbers of their own."""
    _, one, kind = np.unique(chunk.hashes(a, b), return_index=True, return_inverse=True)
    first = one[kind]
    odd = np.flatnonzero((b - a) != (b - a)[first])
    even = np.flatnonzero((b - a) == (b - a)[first])
    odd = np.concatenate([odd, even[~_same(chunk.data, a[even], a[first[even]], (b - a)[even])]])
    kind = kind.copy()
    kind[odd] = len(one) + np.arange(len(odd))
    return kind


_TIMES = np.dtype([("start", "<u4"), ("step", "<u4"), ("times", "<u4")])


def _progressions(start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted within each group (groups are numbers in order) as progressions with steps up to ``LENGTH``, and the
    group of each: the places of a segment in a text of short period are one."""
    n = len(start)
    step = np.zeros(n, np.int64)
    step[1:] = np.where(group[1:] == group[:-1], start[1:] - start[:-1], 0)
    step[step > LENGTH] = 0
    new = np.ones(n, bool)  # a place goes on if it is as far from the one before as that is from its own predecessor, or second
    before = np.zeros(n, np.int64)
    before[1:] = step[:-1]
    second = (step > 0) & (before == 0)
    new[(step > 0) & (step == before)] = False
    turn = (step > 0) & (before > 0) & (step != before)  # such a place starts anew
    follows = np.zeros(n, bool)
    follows[1:] = turn[:-1]
    new[second & ~follows] = False
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate([first, [n]]))
    out = np.zeros(len(first), _TIMES)
    out["start"], out["times"] = start[first], times
    nxt = np.minimum(first + 1, max(n - 1, 0))
    out["step"] = np.where(times > 1, step[nxt] if n else 0, 0)
    return out, group[first]


def _pairs(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<u4").reshape(-1, 2).astype(np.int64)


_ROW = np.dtype([("i", "<i8"), ("s", "<i8"), ("a", "<u4"), ("b", "<u4")])
_PACKED = "home int, body binary"


def _rows(ids, sums, starts, ends) -> np.ndarray:
    out = np.zeros(len(ids), _ROW)
    out["i"], out["s"], out["a"], out["b"] = ids, sums, starts, ends
    return out


def _sent(rows: np.ndarray, homes: int):
    """Ranges packed by the task that gathers their documents: per document its id, its sum and its number of ranges."""
    order = np.lexsort((rows["a"], rows["s"], rows["i"]))
    rows = rows[order]
    home = (mixed(rows["s"].astype(np.int64).view(np.uint64) ^ rows["i"].astype(np.int64).view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(homes + 1))
    for h in np.flatnonzero(np.diff(cuts)).tolist():
        own = rows[order[cuts[h] : cuts[h + 1]]]
        first = _firsts(own["i"], own["s"])
        head = np.array([len(first), len(own)], "<i8")
        counts = np.diff(np.concatenate([first, [len(own)]])).astype("<i4")
        yield {"home": [h], "body": [b"".join(x.tobytes() for x in (head, own["i"][first], own["s"][first], counts, own["a"], own["b"]))]}


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _unpacked(body: bytes) -> np.ndarray:
    n, m = np.frombuffer(body, "<i8", 2).tolist()
    counts = np.frombuffer(body, "<i4", n, 16 + 16 * n)
    out = np.zeros(m, _ROW)
    out["i"], out["s"] = (np.repeat(np.frombuffer(body, "<i8", n, at), counts) for at in (16, 16 + 8 * n))
    out["a"], out["b"] = (np.frombuffer(body, "<u4", m, 16 + 20 * n + at) for at in (0, 4 * m))
    return out


def _gathered(packed: DataFrame, name: str) -> DataFrame:
    """One row for each document that has ranges: ``_i``, ``_s`` and its ranges, packed, under ``name``."""
    homes = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def make():
        held: list[np.ndarray] = []

        def work(batch: pa.RecordBatch) -> None:
            held.extend(_unpacked(x) for x in batch.column("body").to_pylist())

        def finish():
            if held:
                rows = np.concatenate(held)
                held.clear()
                rows = rows[np.lexsort((rows["a"], rows["s"], rows["i"]))]
                first = _firsts(rows["i"], rows["s"])
                cuts = np.concatenate([first, [len(rows)]]).tolist()
                pairs = np.stack([rows["a"], rows["b"]], axis=1)
                yield {"_i": rows["i"][first], "_s": rows["s"][first], name: [pairs[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]}

        work.finish = finish
        return work

    return map_chunks(packed.repartition(homes, "home"), make, f"_i long, _s long, {name} binary", "body", 64 << 20)


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of anchors that crowd some chunk, sorted; ``COMMON`` at most."""

    def make():
        def work(batch: pa.RecordBatch):
            for part, _ in _parts(batch):
                yield crowding(part)

        def crowding(batch: pa.RecordBatch) -> dict:
            texts = batch.column("_text")
            chunk = Chunk(texts)
            fresh = chunk.windows()
            seen = set()
            for row, digest in enumerate(batch.column("_s").to_pylist()):  # copies of a whole text don't count
                if digest in seen:
                    fresh[chunk.offsets[row] : chunk.offsets[row + 1]] = False
                seen.add(digest)
            first, _, h = chunk.segments(fresh)
            row = chunk.rows(first)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            if len(h):  # an anchor counts once for each document
                h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])]
            keys, n = np.unique(h, return_counts=True)
            at = n >= max(COMMON_LEAST, COMMON_SHARE * len(texts))
            return {"h": keys[at].view(np.int64), "n": n[at]}

        return work

    found = map_chunks(docs.select("_text", "_s"), make, "h long, n long", "_text").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().astype(np.int64))


def copied_blocks(docs: DataFrame) -> DataFrame:
    """Ranges of windows whose whole block a smaller id has, packed."""
    homes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def make():
        def work(batch: pa.RecordBatch):
            for part, shift in _parts(batch):
                yield from blocks(part, shift)

        def blocks(batch: pa.RecordBatch, shift: int):
            chunk = Chunk(batch.column("_text"))
            ids, sums = batch.column("_i").to_numpy(), batch.column("_s").to_numpy()
            g = chunk.grams(BLOCK_GRAM)
            marks = np.flatnonzero(g & np.uint64((1 << BLOCK_BITS) - 1) == 0)
            marks = marks[np.diff(marks, prepend=-BLOCK_GAP) >= BLOCK_GAP]
            starts = np.unique(np.concatenate([marks, chunk.offsets[:-1]]))
            starts = starts[starts < len(chunk.data)]
            row = chunk.rows(starts)
            limit = chunk.offsets[row + 1]
            ends = np.minimum(np.concatenate([starts[1:], [len(chunk.data)]]), limit - LENGTH + 1)
            some = ends > starts
            starts, ends, row = starts[some], ends[some], row[some]
            least: dict[bytes, int] = {}
            view = memoryview(chunk.data)
            keys = [hashlib.blake2b(view[a : b + LENGTH - 1], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            own = ids[row].tolist()
            for key, i in zip(keys, own, strict=True):
                if i < least.get(key, 1 << 63):
                    least[key] = i
            base = chunk.offsets[row] - shift
            lost = np.array([least[key] < i for key, i in zip(keys, own, strict=True)], bool)  # the others may have it from elsewhere
            sent_at, lost_at = np.flatnonzero(~lost), np.flatnonzero(lost)
            for at, key in ((sent_at, True), (lost_at, False)):
                yield {"block": [keys[k] for k in at.tolist()] if key else [None] * len(at), "_i": ids[row[at]], "_s": sums[row[at]], "a": starts[at] - base[at], "b": ends[at] - base[at]}

        return work

    def gather():
        held: list[pa.RecordBatch] = []

        def work(batch: pa.RecordBatch) -> None:
            held.append(batch)

        def finish():
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, sums, a, b = (table.column(c).to_numpy() for c in ("_i", "_s", "a", "b"))
            own = table.column("block").combine_chunks()
            known = ~own.is_null().to_numpy(zero_copy_only=False)
            lost = ~known
            if known.any():
                raw = np.frombuffer(joined_bytes(own.filter(pa.array(known)))[0].tobytes(), "V16")
                _, place = np.unique(raw.view("<u8").reshape(-1, 2).view([("x", "<u8"), ("y", "<u8")]).ravel(), return_inverse=True)
                least = np.full(place.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, place, ids[known])
                lost[known] = ids[known] > least[place]
            yield from _sent(_merged(_rows(ids[lost], sums[lost], a[lost], b[lost])), homes)

        work.finish = finish
        return work

    sent = map_chunks(docs, make, "block binary, _i long, _s long, a long, b long", "_text")
    return map_chunks(sent.repartition(F.when(F.col("block").isNotNull(), F.xxhash64("block")).otherwise(F.xxhash64("_s", "_i"))), gather, _PACKED, "block", 64 << 20)


def _fresh(chunk: Chunk, copied: list, shift: int = 0) -> np.ndarray:
    """Whole windows that are not settled by a copied block.  ``shift``: where the text's part in the chunk begins."""
    out = chunk.windows()
    for base, end, blobs in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), copied, strict=True):
        ranges = _pairs(blobs) - shift + base
        ranges = np.clip(ranges[(ranges[:, 1] > base) & (ranges[:, 0] < end)], base, end)
        for a, b in ranges.tolist():
            out[a:b] = False
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def _known(batch: pa.RecordBatch, row: np.ndarray, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a chunk are shared, by their bucket and low half, and which of those many documents hold."""
    pairs = [_pairs(x) for x in batch.column("repeated").to_pylist()]
    own = np.repeat(np.arange(len(pairs)), list(map(len, pairs)))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    full = pairs[:, 1] >> 1 << 32 | pairs[:, 0]
    kinds = np.unique(full)
    wanted = _bucket(h, buckets) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.minimum(np.searchsorted(kinds, wanted), max(len(kinds) - 1, 0))
    there = kinds[at] == wanted if len(kinds) else np.zeros(len(h), bool)
    code = at * (len(batch) + 1) + row
    codes = np.searchsorted(kinds, full) * (len(batch) + 1) + own
    heavy = (pairs[:, 1] & 1).astype(bool)
    return there & np.isin(code, codes), there & np.isin(code, codes[heavy])


def shared_anchors(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Low halves of the hashes of those anchors that another document has too, packed; a document with a common anchor has
    one more entry, which stands for none."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(common)

    def make():
        def work(batch: pa.RecordBatch):
            for part, shift in _parts(batch):
                yield from anchors(part, shift)

        def anchors(batch: pa.RecordBatch, shift: int):
            chunk = Chunk(batch.column("_text"))
            first, _, h = chunk.segments(_fresh(chunk, batch.column("copied").to_pylist(), shift))
            rare = ~np.isin(h.view(np.int64), shared.value)
            often = np.unique(chunk.rows(first[~rare]))
            first, h = first[rare], h[rare]
            row = chunk.rows(first)
            order = np.lexsort((h, row))  # an anchor counts once for each document
            once = order[_firsts(row[order], h[order])]
            row, h = row[once], h[once]
            bucket = _bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids, sums = batch.column("_i").to_numpy(), batch.column("_s").to_numpy()
            if len(often):  # common anchors need no finding, but their documents must be looked at again
                yield {"bucket": [-1], "body": [np.stack([ids[often], sums[often]]).astype("<i8").tobytes()]}
            low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                own, place = np.unique(row[at], return_inverse=True)
                body = [np.array([len(own), len(at)], "<i8"), ids[own], sums[own], low[at], place.astype("<i4")]
                yield {"bucket": [b], "body": [b"".join(x.tobytes() for x in body)]}

        return work

    def gather():
        bodies: list[bytes] = []

        marks: list[int] = []

        def work(batch: pa.RecordBatch):
            for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if bucket < 0:
                    ids, sums = np.frombuffer(body, "<i8").reshape(2, -1)
                    yield from _sent(_rows(ids, sums, NO_HASH, NO_HASH), buckets)
                else:
                    marks.append(bucket)
                    bodies.append(body)

        def finish():
            if not bodies:
                return
            ids, sums, low, place, base = [], [], [], [], 0
            for body, bucket in zip(bodies, marks, strict=True):
                n, m = np.frombuffer(body, "<i8", 2).tolist()
                ids.append(np.frombuffer(body, "<i8", n, 16))
                sums.append(np.frombuffer(body, "<i8", n, 16 + 8 * n))
                low.append(np.frombuffer(body, "<u4", m, 16 + 16 * n).astype(np.int64) | bucket << 32)
                place.append(np.frombuffer(body, "<i4", m, 16 + 16 * n + 4 * m) + base)
                base += n
            bodies.clear()
            ids, sums, low, place = map(np.concatenate, (ids, sums, low, place))
            order = np.argsort(low, kind="stable")
            low, place = low[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            own = ids[place]
            several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
            holders = np.diff(np.concatenate([first, [len(low)]]))
            keep = np.repeat(several, holders)
            heavy = np.repeat(holders > HEAVY, holders)[keep]
            low, place = low[keep], place[keep]
            yield from _sent(_rows(ids[place], sums[place], low & 0xFFFFFFFF, low >> 32 << 1 | heavy), buckets)  # packs as a range does

        work.finish = finish
        return work

    return map_chunks(map_chunks(docs, make, "bucket int, body binary", "_text").repartition(buckets, F.when(F.col("bucket") < 0, F.xxhash64("body")).otherwise(F.col("bucket").cast("long"))), gather, _PACKED, "body", 64 << 20)


def shared_windows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Byte ranges to remove beyond those of copied blocks, packed."""
    homes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        def work(batch: pa.RecordBatch):
            for part, shift in _parts(batch.filter(batch.column("repeated").is_valid())):
                yield from windows(part, shift)

        def windows(batch: pa.RecordBatch, shift: int):
            chunk = Chunk(batch.column("_text"))
            first, last, h = chunk.segments(_fresh(chunk, batch.column("copied").to_pylist(), shift))
            again, heavy = _known(batch, chunk.rows(first), h, homes)
            often = heavy | np.isin(h.view(np.int64), shared.value)
            plain = again & ~often
            runs = last[often] - first[often] + 1  # windows of crowded anchors go one by one
            single = np.arange(runs.sum()) + np.repeat(first[often] - (np.cumsum(runs) - runs), runs)
            a = np.concatenate([first[plain], single])
            b = np.concatenate([last[plain], single]) + LENGTH
            if not len(a):
                return
            key = np.concatenate([h[plain], chunk.hashes(single, single + LENGTH)]).view(np.int64)
            row = chunk.rows(a)
            ids, sums = batch.column("_i").to_numpy(), batch.column("_s").to_numpy()
            own = ids[row]
            kind = _alike(chunk, a, b)
            order = np.lexsort((a, row, own, kind))  # each kind by its ids; under a document by place
            a, b, key, row, own, kind = (x[order] for x in (a, b, key, row, own, kind))
            start = _firsts(kind)
            lost = own > np.repeat(own[start], np.diff(np.concatenate([start, [len(kind)]])))
            base = chunk.offsets[row] - shift
            gone = _merged(_rows(own[lost], sums[row[lost]], a[lost] - base[lost], b[lost] - base[lost]))
            a, b, key, row, own, kind, base = (x[~lost] for x in (a, b, key, row, own, kind, base))
            at = _firsts(kind, row)  # a document sends a segment once
            group = np.zeros(len(a), np.int64)
            group[at] = 1
            places, owner = _progressions(a - base, np.cumsum(group) - 1)
            cuts = np.searchsorted(owner, np.arange(len(at) + 1)).tolist()
            size = b[at] - a[at]
            upto = np.concatenate([[0], np.cumsum(size)])
            body = chunk.data[np.arange(upto[-1]) + np.repeat(a[at] - upto[:-1], size)]
            segs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(upto.astype("<i8").tobytes()), pa.py_buffer(body.tobytes())])
            for k in range(0, len(at), 1 << 18):  # 32-bit offsets hold that many segments
                some = slice(k, min(k + (1 << 18), len(at)))
                yield {"anchor": key[at[some]], "segment": segs[some], "_i": own[at[some]], "_s": sums[row[at[some]]], "at": [places[x:y].tobytes() for x, y in zip(cuts[some], cuts[k + 1 : some.stop + 1], strict=True)], "home": pa.nulls(len(at[some]), pa.int32())}
            for x in _sent(gone, homes):
                yield {"anchor": [None], "segment": x["body"], "_i": [None], "_s": [None], "at": [None], "home": x["home"]}

        return work

    def meet():
        held: list[pa.RecordBatch] = []  # rows of the last anchor, which may go on

        def work(batch: pa.RecordBatch):
            ready = batch.column("home").is_valid()
            if ready.true_count:
                gone = batch.filter(ready)
                yield {"home": gone.column("home"), "body": gone.column("segment")}
                batch = batch.filter(pc.invert(ready))
            if not batch.num_rows:
                return
            anchors = batch.column("anchor").to_numpy()
            if held and held[0].column("anchor")[0].as_py() != anchors[0]:
                yield from _sent(met(_one(held)), homes)
                held.clear()
            last = int(np.searchsorted(anchors, anchors[-1]))
            if last:
                yield from _sent(met(_one([*held, batch.slice(0, last)])), homes)
                held.clear()
            held.append(batch.slice(last))

        def finish():
            if held:
                yield from _sent(met(_one(held)), homes)

        work.finish = finish
        return work

    sent = map_chunks(docs, make, "anchor long, segment binary, _i long, _s long, at binary, home int", "_text")
    dealt = sent.repartition(F.coalesce("anchor", F.xxhash64("segment"))).sortWithinPartitions("anchor")
    return map_chunks(dealt, meet, _PACKED, "segment", 8 << 20)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def met(batch: pa.RecordBatch, length: int = LENGTH) -> np.ndarray:
    """Byte ranges lost among segments that are sorted by anchor, with whole anchors only.

    A segment that a smaller id has too is lost whole.  Of the others, windows whose hash another segment under the anchor
    has are cut out as pieces, equal pieces count as one, and the suffix array of the pieces tells whose windows are equal.
    """
    chunk = Chunk(batch.column("segment"))
    anchors, ids, sums = (batch.column(c).to_numpy() for c in ("anchor", "_i", "_s"))
    blobs = batch.column("at").to_pylist()
    places = np.frombuffer(b"".join(blobs), _TIMES)
    counts = np.array([len(x) // _TIMES.itemsize for x in blobs], np.int64)
    place_from = np.concatenate([[0], np.cumsum(counts)])

    def ranges(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte ranges of documents from those within some rows' segments, at each place of the segment."""
        n = counts[rows]
        which = np.repeat(np.arange(len(rows)), n)
        own = places[np.arange(n.sum()) + np.repeat(place_from[rows] - (np.cumsum(n) - n), n)]
        reach = own["start"].astype(np.int64) + own["step"].astype(np.int64) * (own["times"].astype(np.int64) - 1)
        return _merged(_rows(ids[rows][which], sums[rows][which], own["start"] + a[which], reach + b[which]))

    start, end = chunk.offsets[:-1], chunk.offsets[1:]
    content = batch.column("segment").dictionary_encode().indices.to_numpy()
    order = np.lexsort((ids, content, anchors))
    first = _firsts(anchors[order], content[order])
    least = np.zeros(len(ids), np.int64)
    least[order] = np.repeat(ids[order][first], np.diff(np.concatenate([first, [len(ids)]])))
    whole = np.flatnonzero(ids > least)
    out = [ranges(whole, np.zeros(len(whole), np.int64), (end - start)[whole])]
    whole = ids > least

    kinds = _firsts(anchors[order][first])  # anchors with one content have no more to tell
    several = np.repeat(np.diff(np.concatenate([kinds, [len(first)]])) > 1, np.diff(np.concatenate([first[kinds], [len(ids)]])))
    rest = np.zeros(len(ids), bool)
    rest[order] = several
    rest = np.flatnonzero(rest & ~whole)
    size = (end - start)[rest] - length + 1
    row = np.repeat(rest, size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
    h = chunk.grams(length)[place] if len(place) else np.zeros(0, np.uint64)
    by_hash = np.argsort(h, kind="stable")
    runs = _firsts(h[by_hash])
    again = np.zeros(len(h), bool)
    differs = np.zeros(0, bool)
    if len(h):
        own = ids[row[by_hash]]
        differs = np.minimum.reduceat(own, runs) < np.maximum.reduceat(own, runs)
        again[by_hash] = np.repeat(differs, np.diff(np.concatenate([runs, [len(h)]])))
    row, place = row[again], place[again]
    if not len(row):
        return out[0]
    piece = np.ones(len(row), bool)
    piece[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    piece = np.flatnonzero(piece)
    windows = np.diff(np.concatenate([piece, [len(row)]]))
    a, owner = place[piece], row[piece]
    b = a + windows - 1 + length
    _, one, which = np.unique(_alike(chunk, a, b), return_index=True, return_inverse=True)
    holder = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(holder, which, ids[owner])
    found: list[np.ndarray | None] = [None] * len(one)
    # pieces with a window in common have its anchor in common, so whole anchors go into one array
    todo = np.argsort(anchors[owner[one]], kind="stable")
    bounds = np.concatenate([_firsts(anchors[owner[one]][todo]), [len(todo)]]).tolist()
    ready: list[int] = []
    bytes_ = 0
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        ready += todo[x:y].tolist()
        bytes_ += int((b - a)[one[todo[x:y]]].sum())
        if bytes_ >= ARRAY_BYTES or y == bounds[-1]:
            texts = [chunk.data[a[one[k]] : b[one[k]]].tobytes() for k in ready]
            for k, owners in zip(ready, window_owners(texts, [int(holder[k]) for k in ready], length), strict=True):
                found[k] = owners
            ready, bytes_ = [], 0
    flat = np.concatenate(found)
    upto = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    least = flat[np.arange(len(row)) + np.repeat(upto[which] - piece, windows)]
    lost = np.flatnonzero(least < ids[row])
    row, place = row[lost], place[lost]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    new = np.flatnonzero(new)
    stop = np.concatenate([new[1:], [len(row)]]).astype(np.int64) - 1
    who = row[new]
    return np.concatenate([*out, ranges(who, place[new] - start[who], place[stop] + length - start[who])])


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``_id``, ``_text`` and, packed, ``copied`` (window ranges) and ``lost`` (byte ranges)."""
    every = docs.select(F.col(id).cast("long").alias("_id"), whole_text(text).alias("_text")).withColumn("_sum", F.xxhash64("_text"))
    rows = every.filter("_id is not null").select(F.col("_id").alias("_i"), F.col("_sum").alias("_s"), "_text")
    common = common_anchors(rows)
    copied = settled(_gathered(copied_blocks(rows), "copied"))
    first = rows.join(copied, ["_i", "_s"], "left")
    # the texts are moved anew for the last steps, so anchors and segments are never on disk together
    repeated = settled(_gathered(shared_anchors(first, common), "repeated"))
    second = first.join(repeated, ["_i", "_s"], "left")
    lost = _gathered(shared_windows(second, common), "lost")
    last = rows.join(copied, ["_i", "_s"], "left").join(lost, ["_i", "_s"], "left").select(F.col("_i").alias("_id"), "_text", "copied", "lost")
    nothing = F.lit(None).cast("binary")
    return last.unionByName(every.filter("_id is null").select("_id", "_text", nothing.alias("copied"), nothing.alias("lost")))


def runs_of(size: int, copied, lost) -> np.ndarray:
    """The maximal removed runs of a text, as rows of start and end."""
    blocks = _pairs(copied)
    pairs = np.concatenate([blocks + [0, LENGTH - 1], _pairs(lost)])
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    return np.stack([pairs[first, 0], reach[np.concatenate([first[1:], [len(pairs)]]) - 1]], axis=1)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (removed runs) and, with
    ``keep_text``, ``kept`` (the bytes that remain, which may cut a character)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            data, offsets = joined_bytes(batch.column("_text"))
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for a, b, copied, lost in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("copied").to_pylist(), batch.column("lost").to_pylist(), strict=True):
                body = data[a:b].tobytes()
                runs = runs_of(b - a, copied, lost).tolist()
                at, parts = 0, []
                for x, y in runs:
                    parts.append(body[at:x])
                    at = y
                kept = b"".join([*parts, body[at:]])
                for k, v in zip(out, (len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in runs], kept), strict=True):
                    out[k].append(v)
            return out | {"_id": batch.column("_id")}

        return work

    shape = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * keep_text
    return map_chunks(removals(docs, id, text), make, shape, "_text").withColumnRenamed("_id", id)
