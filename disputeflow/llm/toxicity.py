"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its distinct lower-cased words, with a mark at both ends
of a word, hashed to BUCKETS numbers; a feature counts with the logarithm of the number of
words that have it, in vectors of length 1. Each is scaled by the log ratio of its smoothed
means in toxic and other texts, and a logistic regression weighs the scaled values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from disputeflow.llm import labelled
from disputeflow.llm.frames import batches, raw, rows
from disputeflow.llm.hashing import mix, pieces

LENGTHS = (3, 5, 7)
BITS = 18
BUCKETS = 1 << BITS
#: The model is fitted on at most so many documents of either label.
PER_LABEL = 2_000
#: Added to a feature's mean value in the texts of either label.
SMOOTHING = 0.001
PENALTY = 1e-6
STEPS = 80
RATE = 1.0
#: Rows of the sample that a gradient step takes together.
BATCH = 200
PARTS, PART = 5, 0


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of a text, ascending, and in how many words each occurs."""
    words: set[str] = set()
    for piece in pieces(text):
        words.update(piece.decode().lower().split())
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    inner = np.cumsum(codes == 32)
    found = []
    for n in LENGTHS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count]
        # a space may stand at the ends only
        crossing = inner[n - 2 : n - 2 + count] - inner[:count] if n > 2 else np.zeros(count, int)
        found.append((mix(value[crossing == 0]) >> np.uint64(64 - BITS)).astype(np.int64))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(np.concatenate(found), return_counts=True)


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values, a vector of length 1 (none for an empty text)."""
    numbers, counts = features(text)
    values = np.log1p(counts)
    return numbers, values / np.sqrt((values * values).sum()) if len(values) else values


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        numbers, values = vector(text)
        total = self.bias + float((self.weights[numbers] * values).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def fit_rows(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray) -> Model:
    """Naive Bayes ratios, then logistic regression by gradient steps with momentum.

    ``shares`` weighs the rows, so that a sample balanced by label gives the probabilities of
    the whole. Without rows of both labels every score is the share of label 1, or 0.5.
    """
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    toxic = labels == 1
    p, q = (
        _sums([f for f, own in zip(found, side) if own]) / side.sum() + SMOOTHING  # unseen: a ratio of 0
        for side in (toxic, ~toxic)
    )
    ratio = np.log(p / q)
    weights, bias = np.ones(BUCKETS), 0.0
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    shares = shares / shares.sum()
    for step in range(1, STEPS + 1):
        scaled = weights * ratio
        slope = np.zeros(BUCKETS + 1)
        for start in range(0, len(found), BATCH):
            rows_ = slice(start, start + BATCH)
            index = np.concatenate([numbers for numbers, _ in found[rows_]])
            value = np.concatenate([values for _, values in found[rows_]])
            owner = np.repeat(np.arange(len(found[rows_])), [len(numbers) for numbers, _ in found[rows_]])
            total = np.bincount(owner, value * scaled[index], len(found[rows_])) + bias
            error = (1 / (1 + np.exp(-np.clip(total, -35, 35))) - labels[rows_]) * shares[rows_]
            slope[:-1] += np.bincount(index, value * error[owner], BUCKETS)
            slope[-1] += error.sum()
        slope[:-1] = slope[:-1] * ratio + PENALTY * (weights - 1)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model((weights * ratio).astype(np.float32), float(bias))


def _sums(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for numbers, values in found:
        total[numbers] += values
    return total


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Fits on a bounded sample of labelled documents outside the held-out part.

    Tasks turn the sampled texts into feature numbers; the driver gets at most
    ``2 * per_label`` rows of at most BUCKETS numbers.
    """
    training = labelled.training_labels(labels, label, labelled.held_out(PARTS, PART)).cache()
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("found", pa.binary()), ("value", pa.binary())])

    def extract(parts):
        def each():
            for doc_id, value, text in rows(parts):
                numbers, values = vector(text)
                yield doc_id, value, numbers.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()

        return batches(each(), schema)

    chosen = labelled.sample(docs, training, per_label)
    made = chosen.select("doc_id", "label", raw("text")).mapInArrow(
        extract, "doc_id bigint, label int, found binary, value binary"
    )
    sample = made.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    n = labelled.totals(training)
    training.unpersist()
    values = np.array([r["label"] for r in sample], np.int64)
    taken = np.maximum(np.bincount(values, minlength=2), 1)
    shares = np.array([n[v] / taken[v] for v in values], float)
    found = [(np.frombuffer(r["found"], np.int32), np.frombuffer(r["value"], np.float32)) for r in sample]
    return fit_rows(found, values, shares)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    The score depends on the text alone; null and empty texts have no features and get the
    model's bias. Texts are read in pieces, whole. Null ids are never held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def score(parts):
        model = shared.value
        return batches(((i, out, model.score(text)) for i, out, text in rows(parts)), schema)

    slim = docs.select(
        F.col("doc_id").cast("bigint"), labelled.held_out(PARTS, PART).alias("held_out"), raw("text").alias("text")
    )
    found = slim.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return found.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
