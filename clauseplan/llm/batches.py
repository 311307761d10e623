"""Arrow plumbing shared by the operators that run Python on executors.

Every operator reads its documents through :func:`map_chunks`.  A chunk holds at most
``CHUNK_BYTES`` of text, or one document if that alone is longer, so the memory of a task
depends on the chunk and on the longest document, never on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20

#: What the contracts call white space: blank and the bytes 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds at most ``limit`` bytes in each slice (one row at least)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def map_chunks(
    frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str, text: str = "text", limit: int = CHUNK_BYTES
) -> DataFrame:
    """``mapInArrow`` over chunks.  ``make()`` runs once in each task and returns the function applied to each
    chunk; that yields dictionaries of columns, in any number and of any length.  If the function has an
    attribute ``finish``, its dictionaries follow after the last chunk."""
    spark = frame.sparkSession
    shape = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches):
        work = make()

        def emit(made):
            for columns in [made] if isinstance(made, dict) else made or ():
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for part in slices(batch, text, limit):
                yield from emit(work(part))
        if finish := getattr(work, "finish", None):
            yield from emit(finish())

    return frame.mapInArrow(run, shape)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one array, and the ``n + 1`` offsets of its rows (null: empty)."""
    if column.null_count:  # also as a fresh copy without an offset
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Byte tables: A-Z to a-z; and, beside that, a blank for all ASCII that is no letter or digit.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
LETTERS = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in LOWER.tolist()], np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a chunk: their starts and ends in the joined bytes, the row of each, and where rows begin."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        """``table``: what each byte counts as."""
        data, self.offsets = joined_bytes(column)
        self.data = data = data if table is None else table[data]
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        power = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        raw = sums[self.ends] - sums[self.starts]
        inverse = powers(n + 1, pow(_BASE, -1, 1 << 64))
        return mixed(raw * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
