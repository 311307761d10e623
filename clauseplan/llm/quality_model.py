"""A quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model.

Indicators are hashed: byte 3-grams, words, pairs of words, and how many runs of four words a text repeats.  The model is
fitted on the driver, on at most ``fit_rows`` of the labelled training rows that have a document, chosen by a hash of their
id: log-count ratios, then a linear model by dual coordinate descent.  A fifth of those rows is held back from both and
turns margins into probabilities.  All documents are scored.

Defined results: a null text counts as empty and gets the score of no indicators; training rows with a null id, label or
text, or a label other than 0 and 1, are left out; repeated rows count and score each; without training rows of both labels
every score is 0.5; an empty table gives an empty result; columns beside those named are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LOWER, Words, map_chunks, mixed, whole_text

BITS = 17
#: The bound on the labelled rows that the model is fitted on.
FIT_ROWS = 8000
THRESHOLD = 0.7


def indicators(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct indicators of each row, end to end, and the bounds of the rows."""
    words = Words(column)
    shift = np.uint64(64 - bits)
    data = words.data.astype(np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(words.offsets))
    parts = []
    if len(data) > 2:
        same = row[2:] == row[:-2]
        grams = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
        parts.append((row[2:][same], mixed(grams[same] + np.uint64(1 << 40)) >> shift))
    low = Words(column, LOWER).hashes()
    word_row = np.repeat(np.arange(len(column)), np.diff(words.bounds))
    if len(low):
        parts.append((word_row, low >> shift))
        same = word_row[1:] == word_row[:-1]
        pair = mixed(low[:-1] * np.uint64(0x9FB21C651E98DF25) + low[1:])
        parts.append((word_row[1:][same], pair[same] >> shift))
        if len(low) > 3:
            same = word_row[3:] == word_row[:-3]
            four = mixed(pair[:-2] * np.uint64(0xD6E8FEB86659FD93) + pair[2:])[same]
            own = word_row[3:][same]
            order = np.lexsort((four, own))
            again = (four[order][1:] == four[order][:-1]) & (own[order][1:] == own[order][:-1])
            repeats = np.bincount(own[order][1:][again], minlength=len(column))
            share = 16 * repeats // np.maximum(np.bincount(own, minlength=len(column)), 1)
            level = np.where(repeats > 0, 1 + share, 0)
            parts.append((np.arange(len(column)), mixed(level.astype(np.uint64) + np.uint64(1 << 50)) >> shift))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    keys = np.unique(np.concatenate([r.astype(np.int64) << bits | f.astype(np.int64) for r, f in parts]))
    return keys & ((1 << bits) - 1), np.searchsorted(keys, np.arange(len(column) + 1) << bits)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, cost: float = 0.05, passes: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over indicators times ``scale``, by coordinate descent in the dual."""
    weights, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) * np.sqrt(50.0) for r in rows]
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            slope = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if (step := new - alpha[i]) != 0.0:
                weights[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4 * cost:
            break
    return weights, bias


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The logarithm of each indicator's share among those of label 1 over its share among those of label 0, counts from one."""
    counts = np.ones((2, 1 << bits))
    for r, k in zip(rows, labels, strict=True):
        counts[k, r] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, by Newton steps on smoothed targets."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


@dataclass
class Model:
    """``scale`` holds the log-count ratios, ``weights`` the linear model over the scaled indicators."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(self.scale[features] * self.weights[features])])
        size = np.concatenate([[0.0], np.cumsum(self.scale[features] ** 2)])
        norm = np.sqrt(np.maximum(size[bounds[1:]] - size[bounds[:-1]], 1e-18))
        return (upto[bounds[1:]] - upto[bounds[:-1]]) / norm * np.sqrt(50.0) * (np.diff(bounds) > 0) + self.bias

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features, bounds) + self.offset, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS) -> DataFrame:
    """``label`` and ``own`` (packed indicators) of at most ``fit_rows`` labelled documents: those whose ids have the least
    hashes.  Their ids are so few that they are broadcast, and texts stay where they are."""
    known = labels.select(F.col(id).alias("_key"), F.col(label).cast("int").alias("_label")).filter("_key is not null and _label in (0, 1)")
    there = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("_there"))
    known = known.join(there, F.col("_key") == F.col("_there"), "left_semi")
    few = known.orderBy(F.xxhash64("_key"), "_key", "_label").limit(fit_rows)
    source = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text")).filter("_text is not null")
    source = source.join(F.broadcast(few), F.col("_id") == F.col("_key")).select("_text", "_label")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            features, bounds = indicators(batch.column("_text"), bits)
            return {"label": batch.column("_label"), "own": [features[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]}

        return work

    made = map_chunks(source, make, "label int, own binary", "_text")
    return made.orderBy(F.xxhash64("own", "label")).limit(fit_rows)  # more only where ids repeat


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS) -> Model | None:
    """The model of labelled documents; None unless both labels are there."""
    chosen = training_rows(docs, labels, fit_rows, id, text, label, bits).toArrow()
    own, marks = (chosen.column(c).to_pylist() for c in ("own", "label"))
    if len(set(marks)) < 2:
        return None
    order = sorted(range(len(own)), key=lambda i: (zlib.crc32(own[i]), own[i], marks[i]))
    rows = [np.frombuffer(own[i], "<i4") for i in order]
    labels = np.array(marks)[order]
    back = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    scale = log_count_ratios([r for r, b in zip(rows, back, strict=True) if not b], labels[~back], bits)
    weights, bias = dual_descent([r for r, b in zip(rows, back, strict=True) if not b], scale, np.where(labels[~back] == 1, 1.0, -1.0))
    model = Model(scale, weights, bias)
    if back.any() and len(set(labels[back])) == 2:
        held = [r for r, b in zip(rows, back, strict=True) if b]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in held])])
        model.slope, model.offset = calibrated(model.margins(np.concatenate(held), bounds), labels[back])
    return model


def scored(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, ``score`` and ``predicted``.  The model has ``2 ** BITS`` weights however large the data."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            if own is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = own.scores(*indicators(batch.column("_text")))
            return {"_id": batch.column("_id"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

        return work

    source = docs.select(F.col(id).alias("_id"), whole_text(text).alias("_text"))
    return map_chunks(source, make, f"_id {source.schema['_id'].dataType.simpleString()}, score double, predicted int", "_text", 2 << 20).withColumnRenamed("_id", id)


def fold(id: str = "doc_id", folds: int = 4) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo ``folds`` (a null id as the empty text)."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds


def trained_and_scored(docs: DataFrame, labels: DataFrame, held_fold: int = 2, id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled documents outside ``held_fold``, score all: id, ``held_out``, ``score``, ``predicted``."""
    model = fitted(docs, labels.filter(fold(id) != held_fold), fit_rows, id, text, label)
    return scored(docs, model, id, text).select(F.col(id), (fold(id) == held_fold).alias("held_out"), "score", "predicted")
