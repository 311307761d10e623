"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM decoded across blocks, PCM resampled.

A column of RIFF/WAVE bytes goes in; 16-bit PCM at the wanted rate comes out.  ADPCM is sequential within a block, so
blocks are stacked and decoded in lock step, one numpy operation for the same sample of every block in a chunk.

Defined results: null media give null results; bytes that are no readable WAVE file give null PCM and a reason; empty
audio gives empty PCM; repeated rows and an empty table need no special case; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import joined_bytes, map_chunks, whole_text

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
UNIT = 192


def mulaw_table() -> np.ndarray:
    """The 16-bit value of each mu-law byte, by the G.711 expansion rule."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 16-bit value of each A-law byte, by the G.711 expansion rule."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    part, level = code & 15, code >> 4 & 7
    size = np.where(level == 0, (part << 4) + 8, (part << 4) + 264 << np.maximum(level - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()

#: The step sizes and index changes of IMA ADPCM.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _ima_moves() -> np.ndarray:
    """The signed move for each (step index, nibble)."""
    step, code = IMA_STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32).ravel()


_MOVES = _ima_moves()
_NEXT = np.clip(np.arange(89)[:, None] + IMA_CHANGES[np.arange(16) & 7][None, :], 0, 88).astype(np.int32).ravel()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (rows of bytes) to rows of 16-bit samples.  A step index beyond 88 counts as 88."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = value
    for i, row in enumerate(codes):
        for half, code in ((1, row & 15), (2, row >> 4)):
            at = (index << 4) + code
            value += _MOVES[at]
            np.clip(value, -32768, 32767, out=value)
            index = _NEXT[at]
            out[2 * i + half] = value
    return np.ascontiguousarray(out.T)


def ima_encode(samples: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``1 + 2 * (width - 4)`` samples to mono IMA ADPCM blocks of ``width`` bytes, again across blocks."""
    samples = samples.astype(np.int32)
    n = len(samples)
    out = np.zeros((n, width), np.uint8)
    value, index = samples[:, 0].copy(), np.zeros(n, np.int32)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, samples.shape[1]):
        step, gap = IMA_STEPS[index], samples[:, k] - value
        code, left = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            code |= np.where(hit, bit, 0)
            left -= np.where(hit, part, 0)
        at = (index << 4) + code
        value = np.clip(value + _MOVES[at], -32768, 32767)
        index = _NEXT[at]
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out


def to_mulaw(pcm: np.ndarray) -> np.ndarray:
    """The mu-law byte whose value is nearest to each sample (the smaller value on a tie)."""
    order = np.argsort(MULAW_PCM, kind="stable")
    values = MULAW_PCM[order].astype(np.int32)
    return order[np.searchsorted((values[:-1] + values[1:]) / 2, pcm, side="left")].astype(np.uint8)


def _half_band(reach: int = 8) -> np.ndarray:
    at = np.arange(-reach + 0.5, reach)
    taps = np.sinc(at) * (0.54 + 0.46 * np.cos(np.pi * at / reach))
    return taps / taps.sum()


_TAPS = _half_band()


def doubled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and between each two comes a windowed-sinc value (ends repeat)."""
    if not len(pcm):
        return pcm.astype(np.int16)
    reach = len(_TAPS) // 2
    wide = np.pad(pcm.astype(np.float64), (reach - 1, reach), mode="edge")
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(np.convolve(wide, _TAPS, mode="valid")), -32768, 32767)[: len(pcm)]
    return out


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Doubling while that does not pass ``to``, then straight lines to the exact rate."""
    while rate * 2 <= to:
        pcm, rate = doubled(pcm), rate * 2
    if rate != to and len(pcm):
        at = np.arange(len(pcm) * to // rate) * (rate / to)
        pcm = np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)
    return pcm.astype(np.int16)


@dataclass
class Wave:
    kind: int
    rate: int
    block: int
    data: np.ndarray


def write_wave(data: bytes, kind: int = MULAW, rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file around coded bytes."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA: 4}[kind]
    samples = {PCM: len(data) // 2, IMA: len(data) // max(block, 1) * (1 + 2 * (block - 4))}.get(kind, len(data))
    per_block = 1 + 2 * (block - 4) if kind == IMA else 1
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per_block, block, bits) + (struct.pack("<HH", 2, per_block) if kind == IMA else struct.pack("<H", 0))
    parts = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def read_wave(media: bytes) -> Wave:
    """The coded bytes of a mono RIFF/WAVE file; ``ValueError`` says what is wrong with any other."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("cut short")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("short format")
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None:
                raise ValueError("no format")
            if form[1] != 1 or form[0] not in (PCM, ALAW, MULAW, IMA) or not form[2]:
                raise ValueError("another coding")
            if form[0] == PCM and (form[5] != 16 or size % 2) or form[0] == IMA and (form[4] <= 4 or size % form[4]):
                raise ValueError("broken blocks")
            return Wave(form[0], form[2], form[4], np.frombuffer(media, np.uint8, size, at + 8))
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def expand(wave: Wave) -> np.ndarray:
    """16-bit PCM of a wave at its own rate."""
    if wave.kind == MULAW:
        return MULAW_PCM[wave.data]
    if wave.kind == ALAW:
        return ALAW_PCM[wave.data]
    if wave.kind == PCM:
        return wave.data.view("<i2")
    return ima_decode(wave.data.reshape(-1, wave.block)).ravel()


def decoded(media: DataFrame, column: str = "media", rate: int = 16000) -> DataFrame:
    """All columns, and ``pcm`` (binary, 16-bit little-endian mono at ``rate``) and ``problem``; columns so called before
    are replaced.  The ADPCM blocks of all rows of a chunk that share a block size are decoded together."""
    media = media.drop(*({"pcm", "problem"} - {column}))
    at = media.columns.index(column)
    from pyspark.sql import types as T

    shape = T.StructType([*media.schema.fields, T.StructField("pcm", T.BinaryType()), T.StructField("problem", T.StringType())])

    def run(batches):
        from .batches import slices

        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            for part in slices(pa.RecordBatch.from_arrays(batch.columns, names=names), f"c{at}"):
                waves, why = [], []
                for x in part.column(at).to_pylist():
                    wave = problem = None
                    if x is not None:
                        try:
                            wave = read_wave(x)
                        except ValueError as e:
                            problem = str(e)
                    waves.append(wave)
                    why.append(problem)
                done: dict[int, np.ndarray] = {}
                for block in {w.block for w in waves if w and w.kind == IMA}:
                    own = [i for i, w in enumerate(waves) if w and w.kind == IMA and w.block == block]
                    rows = [waves[i].data.reshape(-1, block) for i in own]
                    flat = ima_decode(np.concatenate(rows))
                    for i, x in zip(own, np.split(flat, np.cumsum([len(r) for r in rows])[:-1]), strict=True):
                        done[i] = x.ravel()
                out = [None if w is None else resampled(done[i] if i in done else expand(w), w.rate, rate).astype("<i2").tobytes() for i, w in enumerate(waves)]
                kinds = [f.type for f in batch.schema] + [pa.binary(), pa.string()]
                arrays = [c.cast(t) for c, t in zip([*part.columns, pa.array(out, pa.binary()), pa.array(why, pa.string())], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "pcm", "problem"])

    return media.mapInArrow(run, shape)


def carried(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """Texts carried as mu-law audio: the padded bytes become the samples of a WAVE file, are read back from it and
    heard three ways: as mu-law, as A-law, and as ADPCM blocks of ``unit`` bytes.  What is heard as mu-law is resampled to
    twice the rate and kept as a WAVE file of 16-bit PCM; ``pcm_bytes`` and ``pcm_sha256`` are that file's."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            data, offsets = joined_bytes(batch.column("_text"))
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "pcm_sha256")}
            payloads, lines = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                body = data[a:b].tobytes()
                size = max(unit, -(-len(body) // unit) * unit)
                media = write_wave(body.ljust(size, b" "))
                wave = read_wave(media)
                back = wave.data.tobytes()
                pcm = expand(wave)
                stored = write_wave(resampled(pcm, wave.rate, 2 * wave.rate).astype("<i2").tobytes(), PCM, 2 * wave.rate, 2)
                wide = read_wave(stored).data
                level = pcm.astype(np.int64)
                payloads.append(wave.data)
                lines.append([int(np.abs(level).max()), round(float(np.sqrt((level * level).mean())), 3), int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum()), f"{zlib.crc32(wide.tobytes()):08x}", f"{zlib.crc32(ALAW_PCM[wave.data].astype('<i2').tobytes()):08x}"])
                for k, v in zip(out, (len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(stored), hashlib.sha256(stored).hexdigest()), strict=True):
                    out[k].append(v)
            if payloads:
                blocks = np.concatenate(payloads).reshape(-1, unit)
                heard = ima_decode(blocks).astype("<i2")
                ends = np.cumsum([len(p) // unit for p in payloads]).tolist()
                for line, a, b in zip(lines, [0, *ends[:-1]], ends, strict=True):
                    line.append(f"{zlib.crc32(heard[a:b].tobytes()):08x}")
            return out | {"_id": batch.column("_id"), "feature": ["peak={} rms={:.3f} crossings={} pcm16k={} alaw={} ima={}".format(*x) for x in lines]}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pcm_bytes long, pcm_sha256 string, feature string"
    return map_chunks(source, make, shape, "_text", 1 << 20).withColumnRenamed("_id", id)
