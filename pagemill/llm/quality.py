"""Quality classifier: a support vector machine over naive Bayes features.

A document is the set of its n-grams: hashed 3-byte grams as they stand, and 3-grams of character shapes
(lower, upper, digit, space, each mark by itself).  Each indicator is scaled by its log-count ratio
between the classes, the vector is brought to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent.  A logistic curve through the margins of documents that the
model was not fitted on turns margins into scores.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows, the first in the order of a
hash of doc_id.  Fitting reads their whole texts; what the driver gets of each is its set of features, at
most ``SIZE`` bits, so the whole sample is at most ``SAMPLE_ROWS * SIZE / 8`` bytes (246 MB) whatever the
texts' lengths.  Scoring reads every whole text where it lies, without a shuffle, very long ones in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 6000
RAW_BITS, SHAPE_BITS = 16, 18
RAW, SHAPES = 1 << RAW_BITS, 1 << SHAPE_BITS
SIZE = RAW + SHAPES
#: Texts are read in pieces of this many bytes, so a very long one needs no more memory.
PIECE = 1 << 20


def _shape_table() -> np.ndarray:
    """A class below 64 for every byte: marks keep their own, letters and digits share one."""
    table = np.zeros(256, np.uint32)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(marks):
        table[b] = 8 + i
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            table[b] = 1
        elif "A" <= c <= "Z":
            table[b] = 2
        elif "0" <= c <= "9":
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif b <= 32:
            table[b] = 5
    return table


SHAPE = _shape_table()


class Grams:
    """Distinct feature numbers of texts; keeps a scratch table from one text to the next."""

    def __init__(self) -> None:
        self.seen = np.zeros(SIZE, np.int64)

    def _distinct(self, codes: np.ndarray) -> np.ndarray:
        turn = np.arange(len(codes))
        self.seen[codes] = turn
        return codes[self.seen[codes] == turn]

    def _piece(self, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) < 3:
            return np.zeros(0, np.int64)
        plain = ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - RAW_BITS)
        s = SHAPE[b]
        shape = (s[:-2] << 12 | s[1:-1] << 6 | s[2:]) + np.uint32(RAW)
        return self._distinct(np.concatenate([plain, shape]).astype(np.int64))

    def of(self, text: str | None) -> np.ndarray:
        """All features of a text, each once; none for a null or empty text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = [self._piece(raw[i : i + PIECE + 2]) for i in range(0, len(raw), PIECE)]
        return parts[0] if len(parts) == 1 else self._distinct(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def packed(codes: np.ndarray) -> bytes:
    """A set of features as numbers, or as bits where that is shorter."""
    if 4 * len(codes) < SIZE // 8:
        return np.sort(codes).astype("<u4").tobytes()
    bits = np.zeros(SIZE, bool)
    bits[codes] = True
    return np.packbits(bits).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    if len(row) == SIZE // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))
    return np.frombuffer(row, "<u4")


class Model:
    """Weights by feature number, bias, and the score curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift

    def margin(self, codes: np.ndarray) -> float:
        r = self.ratio[codes]
        size = float(np.sqrt(np.dot(r, r)))
        return (float(np.dot(r, self.weight[codes])) / size if size else 0.0) + self.bias

    def score(self, codes: np.ndarray) -> float:
        z = self.slope * self.margin(codes) + self.shift
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def log_count_ratios(rows: list[bytes], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """ln of a feature's share in class 1 over its share in class -1, smoothed."""
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for codes, label in zip(rows, y):
        (p if label > 0 else q)[unpacked(codes)] += 1
    return (np.log(p / (alpha * 2 + (y > 0).sum())) - np.log(q / (alpha * 2 + (y < 0).sum()))).astype(np.float32)


def dual_descent(rows: list[bytes], y: np.ndarray, ratio: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """The hinge-loss SVM by dual coordinate descent; classes weigh the same in total."""
    n, rng = len(rows), np.random.default_rng(seed)
    upper = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    w, bias, a = np.zeros(SIZE, np.float64), 0.0, np.zeros(n)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            codes = unpacked(rows[i])
            v = ratio[codes].astype(np.float64)
            size = np.sqrt(v @ v)
            v = v / size if size else v
            gradient = y[i] * (v @ w[codes] + bias) - 1
            new = min(max(a[i] - gradient / (v @ v + 1), 0.0), upper[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                moved = max(moved, abs(step))
                w[codes] += step * v
                bias += step
                a[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32), bias


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton's method."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[margins, np.ones(len(margins))]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[bytes], labels: np.ndarray) -> Model:
    """``rows`` are packed sets of features, labels are 1 or 0.  A fifth of the rows places the curve and is then fitted on as well.

    With one class or no rows the model scores every text by the share of class 1 (one half without rows).
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y)) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 5 == 0
    slope, shift = 4.0, 0.0
    if len(set(y[aside])) == 2 == len(set(y[~aside])):
        part = [r for r, out in zip(rows, aside) if not out]
        ratio = log_count_ratios(part, y[~aside])
        m = Model(ratio, *dual_descent(part, y[~aside], ratio), 1.0, 0.0)
        slope, shift = curve(np.array([m.margin(unpacked(r)) for r, out in zip(rows, aside) if out]), y[aside])
    ratio = log_count_ratios(rows, y)
    return Model(ratio, *dual_descent(rows, y, ratio), slope, shift)


def fold(doc_id) -> object:
    """crc32 of doc_id as text, modulo 3, as a Column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows outside fold 1, at most ``sample_rows`` of them.

    Null labels and documents with conflicting labels are left out; a repeated label counts once.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(known), F.col("d") == F.col("doc_id"))  # at most sample_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            codes = [packed(grams.of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["doc_id", "quality", "codes"])

    got = chosen.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(lean(run), "doc_id long, quality int, codes binary").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (zlib.crc32(str(got["doc_id"][i]).encode()), got["doc_id"][i], got["codes"][i]))
    return fit([got["codes"][i] for i in order], np.array([got["quality"][i] for i in order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> their columns and ``score``; null and empty texts too.

    A ``score`` that the documents bring gives way to the model's.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.shift))
    names, at = docs.columns, docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), Model(*sent.value)
        for batch in batches:
            scores = pa.array([m.score(grams.of(t.as_py())) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, "score"])

    return docs.mapInArrow(lean(run), schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all their columns whatever their names.

    Null and empty texts are scored like any other; repeated rows stay or go together; an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.slope, model.shift))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), Model(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([m.score(grams.of(t.as_py())) >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, ``labels`` -> doc_id, held_out, score, predicted, one row per input row.

    Only doc_id and text are read, so other columns may have any name.  Null and empty texts have no
    features and score the model's bias; very long texts are read whole, in pieces; repeated rows and
    equal texts are scored alike; an empty table gives an empty result, no labels a score of one half.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(slim, train(slim, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
