"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model's protobuf is parsed here, without generated classes: its pieces, scores, types, and the settings of trainer
and normaliser.  From them the ``tokenizers`` model is rebuilt: unigram scores, or for a merge model the merges that the
scores imply; byte fallback; the meta space marker.  Where no piece holds the marker behind another character, a text
falls apart at the markers into words that never share a piece, so each distinct word is encoded once per task, in
multithreaded batches, and remembered up to a bound.  With any other model (one that trims blanks, maps characters, or
joins words in a piece) whole texts are encoded in batches.  All ids come from the ``tokenizers`` library.  Parity is
verified in full: every distinct word, or text, is also encoded by the ``sentencepiece`` library; ``n_checked`` and
``n_differ`` count a document's words, or texts, and those that differ (with ``one_in`` above 1, of a sample by a hash).

Defined results: a null text counts as empty and has no tokens; an empty table gives an empty result; repeated rows give
equal rows; columns beside the two named are never read.  A literal marker character in a text decodes to a blank, as
in the ``sentencepiece`` library.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_chunks, whole_text

MARK = "▁"
#: Distinct words that a task remembers before it starts anew.
WORDS_KEPT = 400_000
#: Bytes of text at once: their words and ids are Python objects for a while.
TEXT_BYTES = 1 << 20
#: New words that are encoded in one batch.
LEARNED_AT_ONCE = 20_000
#: One in so many words is encoded by both libraries: all of them.
CHECKED = 1
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """The (number, value) pairs of a protobuf message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind = trainer.get(3, 1)
                if kind not in (1, 2):
                    raise ValueError(f"model type {kind}")
                out.unigram, out.byte_fallback = kind == 1, bool(trainer.get(35, 0))
            elif number == 3:
                rule = dict(_fields(value))
                out.charsmap = rule.get(2, b"")
                out.dummy_prefix, out.trim, out.escape = (bool(rule.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def separable(self) -> bool:
        """No piece holds the marker behind another character, and blanks are kept as they are."""
        return self.escape and not self.trim and self.dummy_prefix and not self.charsmap and not any(MARK in p.lstrip(MARK) for p in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two others, best score first, then by the parts' ids."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        found = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((-self.scores[i], left, right))
        return [(self.pieces[a], self.pieces[b]) for _, a, b in sorted(found)]

    def backend(self, whole: bool = True):
        """A ``tokenizers.Tokenizer``; with ``whole=False`` one that takes words already marked and split."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), None)
        if self.unigram:
            core = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk_id=unknown, byte_fallback=self.byte_fallback)
        else:
            ids = {p: i for i, p in enumerate(self.pieces)}
            core = models.BPE(ids, self.merges(), unk_token=None if unknown is None else self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0 if not whole else 10_000)
        out = Tokenizer(core)
        if whole:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.trim:
                steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
            steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)] * self.escape
            out.normalizer = normalizers.Sequence(steps)
            if self.separable:
                out.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD.pattern), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        out = []
        for p, t in zip(self.pieces, self.types, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        return out


class Coder:
    """Encodes and decodes in one task.  ``data``: the bytes of the model file."""

    def __init__(self, data: bytes, one_in: int = CHECKED):
        import sentencepiece

        self.one_in = one_in
        self.model = Model.parse(data)
        self.by_word = self.model.separable
        self.core = self.model.backend(whole=not self.by_word)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.out = self.model.piece_bytes()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.checked, self.bad = np.zeros(0, bool), np.zeros(0, bool)

    def _verified(self, units: list[str], ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Which units are encoded by the other library too, and which of them differ."""
        checked = np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.one_in == 0 for x in units), bool, len(units))
        bad = np.zeros(len(units), bool)
        at = np.flatnonzero(checked).tolist()
        own = [units[i][1:].replace(MARK, " ") if self.by_word else units[i] for i in at]
        for i, x in zip(at, self.reference.encode(own, num_threads=1), strict=True):
            if self.by_word and units[i] == MARK:  # a last blank; alone it is no text
                x = [self.reference.piece_to_id(MARK)]
            bad[i] = x != ids[i]
        return checked, bad

    def _learn(self, new: list[str]) -> None:
        ids = [x.ids for x in self.core.encode_batch_fast(new, add_special_tokens=False)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(new)))])
        checked, bad = self._verified(new, ids)
        self.checked, self.bad = np.concatenate([self.checked, checked]), np.concatenate([self.bad, bad])

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.core.encode_batch_fast(texts, add_special_tokens=False)]
        checked, bad = self._verified(texts, ids)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        return np.fromiter((i for x in ids for i in x), np.int32), ends, checked.astype(np.int64), bad.astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offsets of each text in them, how many of its words both libraries have encoded, and on how many of
        those they differ."""
        if not self.by_word:
            return self._encode_whole(texts)
        if len(self.place) > WORDS_KEPT:
            self.forget()
        words, counts = [], []
        for x in texts:
            own = _WORD.findall(MARK + x.replace(" ", MARK)) if x else []
            words += own
            counts.append(len(own))
        new = sorted(dict.fromkeys(words).keys() - self.place.keys())
        for k in range(0, len(new), LEARNED_AT_ONCE):
            self._learn(new[k : k + LEARNED_AT_ONCE])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)]
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        checked, bad = (np.concatenate([[0], np.cumsum(x[at])]) for x in (self.checked, self.bad))
        return ids, upto[bounds], checked[bounds[1:]] - checked[bounds[:-1]], bad[bounds[1:]] - bad[bounds[:-1]]

    def decode(self, ids) -> str:
        """The text of some ids; broken bytes become replacement characters."""
        out = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " and (self.model.dummy_prefix or self.model.trim) else out


def encoded(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", keep_ids: bool = True, one_in: int = CHECKED) -> DataFrame:
    """Per document: id, ``ids`` (if ``keep_ids``), ``n_tokens``, ``ids_sha256`` (of the ids as little-endian 32-bit
    integers), ``round_trip`` (decoding gives the text back), ``n_checked`` and ``n_differ``.  The model travels with the
    task: it has a few hundred kilobytes and does not grow with the data."""

    def make():
        coder = Coder(model, one_in)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("_text").to_pylist()
            ids, ends, checked, differ = coder.encode(texts)
            ends = ends.tolist()
            raw, every = ids.astype("<i4").tobytes(), ids.tolist()
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            out = {
                "_id": batch.column("_id"),
                "n_tokens": [b - a for a, b in spans],
                "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans],
                "round_trip": [coder.decode(every[a:b]) == x for (a, b), x in zip(spans, texts, strict=True)],
                "n_checked": checked,
                "n_differ": differ,
            }
            return out | ({"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))} if keep_ids else {})

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, round_trip boolean, n_checked long, n_differ long"
    return map_chunks(source, make, shape, "_text", TEXT_BYTES).withColumnRenamed("_id", id)


def decoded(tokens: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """All columns, and the text of ``ids`` in column ``to`` (null for null); a column so called before is replaced."""
    from pyspark.sql import types as T

    tokens = tokens.drop(to)
    at = tokens.columns.index(ids)
    shape = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        coder = Coder(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [None if x is None else coder.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return tokens.mapInArrow(run, shape)
