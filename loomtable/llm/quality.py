"""Document quality by Naive Bayes support vectors (NB-SVM).

Features are indicators of n-grams of the whole text, hashed into a fixed table: runs of three bytes, and runs of one and
two words, where a word that equals the one before it is written as a repeat mark.  Each indicator is scaled by its class
log-count ratio, each text to unit length, and a linear hinge-loss model is fitted by dual coordinate descent;
the intercept is one more feature.  Two numbers fitted on margins of held-back training rows turn a margin into a score.

The model is fitted on at most ``max_rows`` labelled texts (a bound, not a share: the rows with the smallest
fingerprints of their ids, half of the bound for each class), so the driver's work is the same for every corpus.
Scoring is one pass over all texts; the weights are one array of fixed size.

Defined results: a null or empty text has no n-grams and gets the score of the intercept alone; labels that are null
or contradict each other for one id are not learned from; rows are scored one by one, so repeated rows each get a
row; a table with fewer than two classes of labelled texts gives the share of label 1 (0.5 without labels) as every
score; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomtable.llm.tables import columns
from loomtable.llm.words import Words, batches_of_bytes, mixed

BITS = 18
_FIRST, _SECOND, _REPEAT = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """The distinct feature numbers of one text; ``words`` are its words' fingerprints."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, bool) if len(b) > 4096 else None
    grams = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS) if len(b) > 2 else b[:0]
    w = words.copy()
    w[1:][words[1:] == words[:-1]] = _REPEAT
    pairs = mixed(w[:-1] * _FIRST + w[1:] * _SECOND) if len(w) > 1 else w[:0]
    top = np.uint64(64 - BITS)
    parts = [grams.astype(np.int64), (mixed(w * _FIRST) >> top).astype(np.int64), (pairs >> top).astype(np.int64)]
    if seen is None:
        return np.unique(np.concatenate(parts))
    for p in parts:
        seen[p] = True
    return np.flatnonzero(seen)


def _featured(texts: list[bytes]) -> Iterator[np.ndarray]:
    words = Words(texts, fold=False)
    for d, text in enumerate(texts):
        yield features(text, words.hash[words.first[d]:words.first[d + 1]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    ratio: np.ndarray

    def margin(self, own: np.ndarray) -> float:
        """The weights already hold the log-count ratios; the length of the scaled text divides."""
        length = np.sqrt((self.ratio[own] ** 2).sum()) if len(own) else 0.0
        return float(self.weights[own].sum() / length + self.bias if length else self.bias)

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(own) + self.offset, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 1 << BITS))
    for own, label in zip(rows, labels):
        counts[int(label)][own] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float,
                            epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over the scaled indicators (L1 loss, 0 <= a <= cost), and the weight of the constant feature."""
    y = labels * 2.0 - 1
    values = []
    for own in rows:
        v = ratio[own]
        length = np.sqrt((v ** 2).sum())
        values.append(v / length if length else v)
    square = np.array([1.0 + (1.0 if len(v) and v.any() else 0.0) for v in values])
    w, bias, a = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(a[i] - gradient / square[i], 0.0), cost)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(new - a[i]))
                a[i] = new
        if largest < 1e-3:
            break
    return w * ratio, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, cost: float = 1.0, epochs: int = 10) -> Model:
    """``share`` of label 1 among all labelled rows: the score's prior, as the sample holds the classes evenly."""
    if len(set(labels.tolist())) < 2:
        flat = np.zeros(1 << BITS)
        return Model(flat, 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0 * (share >= 1) - 40.0 * (share <= 0), flat)
    fold = np.arange(len(rows)) % 4 == 0
    part = [r for r, f in zip(rows, fold) if not f]
    ratio = log_count_ratio(part, labels[~fold])
    weights, bias = dual_coordinate_descent(part, labels[~fold], ratio, cost, epochs)
    trial = Model(weights, bias, 1, 0, ratio)
    margins = np.array([trial.margin(r) for r, f in zip(rows, fold) if f])
    slope, offset = sigmoid(margins, labels[fold])
    ratio = log_count_ratio(rows, labels)
    weights, bias = dual_coordinate_descent(rows, labels, ratio, cost, epochs)
    return Model(weights, bias, slope, offset, ratio)


def sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the logistic loss with smoothed targets; the slope is positive."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(labels == 1, 0.5 / max(up, 1), 0.5 / max(down, 1)) * len(labels)
    p = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        g = x.T @ (weight * (q - target)) + 1e-3 * p
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
    return max(float(p[0]), 1e-6), float(p[1])


def is_held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 6000) -> Model:
    """Fits on labelled texts that are not held out; at most ``max_rows`` of them reach the driver."""
    named = columns(labels, id=id_col, label=label_col).filter("id is not null and label in (0, 1)")
    one = (named.filter(F.coalesce(~is_held_out("id"), F.lit(False))).groupBy("id")
           .agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label"))
    shares = one.agg(F.avg("label")).first()[0]
    pick = [one.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for c in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    # the chosen ids are at most max_rows, so this side is sent to every task
    texts = columns(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("k"), "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own in batches_of_bytes(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(own)), batch.column(2).slice(at, len(own)).cast(pa.int32()),
                                       pa.array([f.astype(np.int32).tobytes() for f in _featured(own)], pa.binary())],
                                      names=["k", "label", "own"])

    got = texts.mapInArrow(run, "k long, label int, own binary").collect()
    got.sort(key=lambda r: (r.k, r.own))
    return fit([np.frombuffer(r.own, np.int32) for r in got], np.array([r.label for r in got], int), 0.5 if shares is None else shares)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own in batches_of_bytes(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(own)),
                                       pa.array([shared.value.score(f) for f in _featured(own)], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = columns(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(is_held_out("id"), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))
