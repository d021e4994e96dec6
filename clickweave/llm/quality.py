"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model on them.

A text's n-grams are byte trigrams, 1- to 4-grams of its outline (runs of capitals, small letters, digits and each other sign) and
buckets of how often its words repeat, all hashed to a fixed number of features. Each feature present counts its class
log-count ratio; vectors have length one. The model is fitted by dual coordinate descent, and the margins become
scores through a logistic curve fitted on margins of rows that were left out in turn.

Only labelled rows are learnt from, at most ``sample`` of them (the lowest hashes of doc_id, so every size of corpus is treated
alike); their features, and no texts, reach the driver. Of one document's contradicting labels the majority counts, a
tie counting as good. Without any label, or with labels of one class only, every score is the share of good labels
(0.5 without labels).

Null and empty texts have no n-grams and get the score of the bias alone. Repeated rows are scored each. An empty table
gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm import bytescan
from clickweave.llm.shared import in_arrow, rows_in_arrow

FEATURES = 1 << 18
#: Most labelled rows the model is fitted on.
SAMPLE = 8000
ROUNDS = 12
_CAPITAL, _SMALL, _DIGIT, _GAP = 1, 2, 3, 4
_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[ord("A"):ord("Z") + 1] = _CAPITAL
_OUTLINE[ord("a"):ord("z") + 1] = _SMALL
_OUTLINE[128:] = _SMALL
_OUTLINE[ord("0"):ord("9") + 1] = _DIGIT
_OUTLINE[[0x20, 9, 11, 12, 13]] = _GAP


class Model(NamedTuple):
    weights: np.ndarray  # one for each feature, to be added up over the features present and divided by their norm
    squares: np.ndarray  # squares of the scales, for the norm
    bias: float
    slope: float
    shift: float


def _bucket(values: np.ndarray, salt: int) -> np.ndarray:
    return (bytescan.mixed(values.astype(np.uint64) + np.uint64(salt << 40)) & np.uint64(FEATURES - 1)).astype(np.int32)


def _grams(signs: np.ndarray, n: int, salt: int) -> np.ndarray:
    if len(signs) < n:
        return np.zeros(0, np.int32)
    wide = signs.astype(np.uint64)
    value = wide[:len(wide) - n + 1].copy()
    for i in range(1, n):
        value = (value << np.uint64(8)) | wide[i:len(wide) - n + 1 + i]
    return _bucket(value, salt)


def features(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The features present in a text of these bytes and word hashes, each once."""
    outline = _OUTLINE[data]
    turns = outline[np.flatnonzero(np.diff(outline, prepend=np.uint8(255)))] if len(outline) else outline
    found = [_grams(data, 3, 1)] + [_grams(turns, n, 1 + n) for n in (1, 2, 3, 4)]
    n = len(hashes)
    if n:
        distinct = len(np.unique(hashes)) / n
        same = float(np.mean(hashes[1:] == hashes[:-1])) if n > 1 else 0.0
        found.append(_bucket(np.array([int(n).bit_length() * 32 + int(distinct * 16)]), 9))
        found.append(_bucket(np.array([int(distinct * 16), 100 + int(same * 16)]), 10))
    return np.unique(np.concatenate(found))


def _each_text(batch, column: int):
    """(row, features) of every text of a batch."""
    for chunk in bytescan.chunks(batch.column(column)):
        found = bytescan.words(chunk)
        hashes = bytescan.word_hashes(chunk, found)
        for i in range(len(chunk.bounds) - 1):
            yield chunk.first + i, features(chunk.data[chunk.bounds[i]:chunk.bounds[i + 1]], hashes[found.bounds[i]:found.bounds[i + 1]])


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of a feature's share among good rows to its share among bad ones."""
    counts = [np.ones(FEATURES), np.ones(FEATURES)]
    for row, label in zip(rows, good, strict=True):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: np.ndarray,
                            rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias with the least hinge loss: each step solves for one row's multiplier with the others held."""
    y = np.where(good, 1.0, -1.0)
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row, value = rows[i], values[i]
            gradient = y[i] * (w[row] @ value + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[row] += step * value
                bias += step
                alpha[i] = new
    return w, bias


def logistic_fit(margins: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton's method with smoothed labels."""
    n1 = good.sum()
    n0 = len(good) - n1
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([((p - t) * margins).sum(), (p - t).sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    return [ratios[row] / max(1e-12, float(np.linalg.norm(ratios[row]))) for row in rows]


def _costs(good: np.ndarray) -> np.ndarray:
    """Both classes weigh the same in the loss, up to a factor of the square root of their ratio."""
    share = good.mean()
    return np.where(good, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))


def fit(rows: list[np.ndarray], good: np.ndarray, folds: int = 3) -> Model:
    good = np.asarray(good, bool)
    if not len(good) or good.all() or not good.any():
        share = min(max(float(good.mean()) if len(good) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold, margins = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in range(folds):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if good[inside].all() or not good[inside].any():
            continue
        part = [rows[i] for i in inside]
        ratios = log_count_ratios(part, good[inside])
        w, bias = dual_coordinate_descent(part, _scaled(part, ratios), good[inside], _costs(good[inside]))
        left_out = [rows[i] for i in outside]
        margins[outside] = [w[row] @ value + bias for row, value in zip(left_out, _scaled(left_out, ratios), strict=True)]
    ratios = log_count_ratios(rows, good)
    w, bias = dual_coordinate_descent(rows, _scaled(rows, ratios), good, _costs(good))
    slope, shift = logistic_fit(margins, good)
    return Model((w * ratios).astype(np.float32), (ratios * ratios).astype(np.float32), bias, max(slope, 1e-6), shift)


def score(model: Model, present: np.ndarray) -> float:
    norm = float(np.sqrt(model.squares[present].sum())) if len(present) else 0.0
    margin = model.bias + (float(model.weights[present].sum()) / norm if norm else 0.0)
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -40, 40))))


def is_held_out(doc_id: Column) -> Column:
    """The third of the documents that is never learnt from; a row without an id is never learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    doc_id = F.col("doc_id")
    known = labels.select(doc_id.cast("long").alias("doc_id"), "quality").where(~is_held_out(doc_id) & F.col("quality").isNotNull())
    chosen = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # At most ``sample`` rows: of the texts that share an id the least is learnt from.
    learnt = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in batches:
            found = [present.tobytes() for _, present in _each_text(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                                             names=["doc_id", "good", "features"])

    rows = in_arrow(learnt, extract, "doc_id long, good boolean, features binary").collect()
    rows.sort(key=lambda row: (row.doc_id, row.features))
    return fit([np.frombuffer(row.features, np.int32) for row in rows], np.array([row.good for row in rows], bool))


def quality_scores(documents: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, score. The model's size is fixed by the number of features."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            scores = [score(sent.value, present) for _, present in _each_text(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_arrow(texts, each, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    scored = quality_scores(documents, fit_model(documents, labels, sample))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose text scores ``threshold`` or more, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    text = documents.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.binary())], names=["text"])
            good = np.zeros(batch.num_rows, bool)
            for row, present in _each_text(texts, 0):
                good[row] = score(sent.value, present) >= threshold
            yield batch.filter(pa.array(good))

    return rows_in_arrow(documents, keep)
