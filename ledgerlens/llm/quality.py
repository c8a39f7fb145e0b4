"""Operator 1: quality classifier by naive Bayes support vectors.

Indicators of word unigrams, word bigrams and byte trigrams, hashed to ``1 << BITS`` features, are scaled by the
class log-count ratios and normalised to length one; dual coordinate descent fits a linear model with hinge loss on
them, and a logistic curve fitted on rows that the model hasn't seen turns margins into scores.

The model is fitted on a bounded sample, ``sample`` labelled rows outside the held-out fold in the order of a hash of
their doc_id (16,000 by default, in one task); every text is scored whole.

Defined results: a null text counts as empty; a text without features gets the score of the intercept; a null label or
a label without its document isn't learned from; with labels of one class only, or none, each score is the share of
label 1 with one row added to either class; a null doc_id counts as held out; repeated rows get a row each, and of a doc_id
on several rows one text, that of the least hash, is learned from. doc_ids may be of any type. Empty tables give an empty table; texts are
handled about a megabyte at a time, a longer one alone; further columns, whatever their names, are ignored by scores and
kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_values, chunks, is_word, mixed, only, prefix_hash, span_hash, spans, table, utf8

BITS = 18
SAMPLE = 16_000
THRESHOLD = 0.3
FOLDS = 5
_WORD = is_word()


def features(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The distinct features of each row of a slice of chunks()."""
    data, offsets = utf8(part.column("text"))
    starts, ends, first = spans(_WORD[data], offsets)
    words = span_hash(prefix_hash(byte_values(data)), starts, ends)
    shift = np.uint64(64 - BITS)
    one = (words >> shift).astype(np.int32)
    two = (mixed(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.int32)
    wide = data.astype(np.uint64)
    three = (mixed(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) >> shift).astype(np.int32)
    stamp = np.zeros(1 << BITS, np.int32)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        found = np.concatenate([one[a:b], two[a : max(a, b - 1)], three[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]])
        order = np.arange(len(found), dtype=np.int32)
        stamp[found] = order
        yield found[stamp[found] == order]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) where p and q count the rows of label 1 and 0 that hold a feature."""
    counts = np.full((2, 1 << BITS), smoothing)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], scaled: list[np.ndarray], labels: np.ndarray, cost: float, rounds: int, seed: int = 1) -> np.ndarray:
    """Weights, the last of them the intercept's, that minimise |w|^2 / 2 + cost * sum of hinge losses (Hsieh et al. 2008)."""
    weights, alpha, sign = np.zeros((1 << BITS) + 1), np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    norm = np.array([x @ x + 1.0 for x in scaled])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ scaled[i] + weights[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if step := (new - alpha[i]) * sign[i]:
                weights[rows[i]] += step * scaled[i]
                weights[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) with P(label 1) about 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed targets (Platt 1999)."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones_like(margins)])
    at = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * at)
        at = at - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def normalised(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[row]
    return values / max(np.sqrt(values @ values), 1e-12)


class Model:
    """ratios: log-count ratios; weights: of scaled features, the intercept last; a, b: the logistic curve."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, a: float, b: float):
        self.ratios, self.weights, self.a, self.b = ratios, weights, a, b

    @classmethod
    def constant(cls, labels: np.ndarray) -> Model:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return cls(np.zeros(1 << BITS), np.zeros((1 << BITS) + 1), 0.0, float(np.log(share / (1 - share))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 20) -> Model:
        if not 0 < labels.sum() < len(labels):
            return cls.constant(labels)
        fold = np.arange(len(rows)) % FOLDS
        margins = np.zeros(len(rows))
        for k in range(FOLDS):
            seen = np.flatnonzero(fold != k)
            ratios = log_count_ratios([rows[i] for i in seen], labels[seen])
            weights = dual_coordinate_descent([rows[i] for i in seen], [normalised(rows[i], ratios) for i in seen], labels[seen], cost, rounds)
            for i in np.flatnonzero(fold == k):
                margins[i] = weights[rows[i]] @ normalised(rows[i], ratios) + weights[-1]
        a, b = logistic(margins, labels)
        ratios = log_count_ratios(rows, labels)
        return cls(ratios, dual_coordinate_descent(rows, [normalised(x, ratios) for x in rows], labels, cost, rounds), a, b)

    def score(self, row: np.ndarray) -> float:
        margin = self.weights[row] @ normalised(row, self.ratios) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -700, 700))))

    def packed(self) -> bytes:
        return np.concatenate([self.ratios, self.weights, [self.a, self.b]]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        x, n = np.frombuffer(data, np.float32).astype(np.float64), 1 << BITS
        return cls(x[:n], x[n : 2 * n + 1], float(x[-2]), float(x[-1]))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The packed model. What reaches the driver is the model alone, of a fixed size."""
    chosen = only(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    rows = rows.select(F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("which"), "text", "quality")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, found, order = [], [], []
        for part in chunks(batches):
            kept += list(features(part))
            found += part.column("quality").to_pylist()
            order += zip(part.column("place").to_pylist(), part.column("which").to_pylist(), strict=True)
        by = sorted(range(len(order)), key=order.__getitem__)
        by = [i for k, i in enumerate(by) if not k or order[i][0] != order[by[k - 1]][0]]  # one row a doc_id
        model = Model.fit([kept[i] for i in by], np.array([found[i] for i in by], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(fit, "model binary").first()
    return bytes(found.model) if found else Model.constant(np.zeros(0)).packed()  # no task runs for no rows


def scores_of(batch: pa.RecordBatch, fitted: Model) -> np.ndarray:
    return np.array([fitted.score(row) for part in chunks(iter([batch.select(["text"])])) for row in features(part)], np.float64)


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score) of each row: of the texts alone."""
    of = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model.unpacked(of.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores_of(batch, fitted))], names=["doc_id", "score"])

    rows = only(docs, "doc_id", "text")
    return rows.mapInArrow(score, StructType([rows.schema["doc_id"], StructField("score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scored = score_quality(docs, fit_quality(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    of = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model.unpacked(of.value)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(batch, fitted) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
