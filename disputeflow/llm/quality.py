"""Quality: a compression classifier with zstandard dictionaries.

One dictionary is built from good and one from bad labelled text. A text is compressed in
blocks of CHUNK bytes with either, so that the dictionaries and not the text's own history
decide; the difference of the two sizes by the text's size, calibrated by a logistic curve,
is the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from disputeflow.llm import labelled
from disputeflow.llm.frames import batches, raw, rows

CHUNK = 512
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: At most so many documents of either label are learnt from: half of them for the
#: dictionaries, of which at most so many bytes of whole texts, and half for the calibration.
PER_LABEL = 3_000
DICTIONARY_TEXT = 16 << 20
#: Added to a text's size, so that a few bytes of a very short text do not decide.
SLACK = 32
THRESHOLD = 0.7
PARTS, PART = 4, 2


def blocks(text: bytes) -> list[bytes]:
    return [text[start : start + CHUNK] for start in range(0, len(text), CHUNK)]


@dataclass
class Dictionaries:
    """Contents of the two dictionaries; good, then bad."""

    contents: tuple[bytes, bytes]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.contents:
            known = zstandard.ZstdCompressionDict(content) if content else None
            if known:
                known.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        return made


def difference(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
    """(size with the bad dictionary - size with the good one) / size; 0 for no text."""
    good, bad = (c.compress for c in compressors)
    total = sum(len(bad(block)) - len(good(block)) for block in blocks(text))
    return total / (len(text) + SLACK)


def dictionary(found: list[bytes]) -> bytes:
    """Trained on ``found``; where that is too little to train on, ``found`` itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(found)[-DICTIONARY_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps with a small ridge."""
    if not len(x):
        return 0.0, 0.0
    design = np.column_stack([x, np.ones(len(x))])
    beta, shares = np.zeros(2), shares / shares.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        slope = design.T @ (shares * (p - y)) + 1e-3 * beta
        curve = (design * (shares * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12) * max(1.0, np.abs(beta).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    dictionaries: Dictionaries
    slope: float
    intercept: float

    def scorer(self):
        compressors = self.dictionaries.compressors()

        def score(text: bytes) -> float:
            total = self.slope * difference(text, compressors) + self.intercept
            return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

        return score


def _within(chosen: DataFrame, limit: int) -> DataFrame:
    """The documents that are taken, by rank, while their texts make no more than ``limit`` bytes a label.

    Texts are taken whole or not at all. There are at most ``per_label`` rows of either label, of
    which sizes alone are looked at.
    """
    sizes = chosen.groupBy("doc_id", "label", "rank").agg(F.max(F.octet_length("text")).cast("bigint").alias("size"))
    order = Window.partitionBy("label").orderBy("rank", "doc_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sizes.where(F.col("size") <= limit).withColumn("upto", upto).where(F.col("upto") <= limit).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Fits on a bounded sample of labelled documents outside the held-out part.

    The driver gets at most ``2 * DICTIONARY_TEXT`` bytes of whole texts and ``per_label`` differences.
    Without labels every score is 0.5; a label without documents leaves its dictionary empty.
    """
    training = labelled.training_labels(labels, label, labelled.held_out(PARTS, PART)).cache()
    chosen = labelled.sample(docs, training, per_label).select("doc_id", "label", "rank", raw("text").alias("text"))
    first = F.pmod(F.col("rank"), F.lit(2)) == 0
    block_schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("blocks", pa.list_(pa.binary()))])

    def cut(parts):
        return batches(((i, v, blocks(text)) for i, v, text in rows(parts)), block_schema, 64)

    taken = chosen.where(first).join(F.broadcast(_within(chosen.where(first), DICTIONARY_TEXT)), "doc_id", "left_semi")
    cuts = taken.select("doc_id", "label", "text").mapInArrow(
        cut, "doc_id bigint, label int, blocks array<binary>"
    ).dropDuplicates(["doc_id"])
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in cuts.orderBy("doc_id").collect():
        found[row["label"]] += [bytes(block) for block in row["blocks"]]
    dictionaries = Dictionaries((dictionary(found[1]), dictionary(found[0])))

    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.float64())])

    def differ(parts):
        compressors = dictionaries.compressors()
        return batches(((i, v, difference(text, compressors)) for i, v, text in rows(parts)), schema)

    rest = chosen.where(~first).select("doc_id", "label", "text").mapInArrow(differ, "doc_id bigint, label int, x double")
    points = rest.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    n = labelled.totals(training)
    training.unpersist()
    y = np.array([r["label"] for r in points], np.int64)
    counted = np.maximum(np.bincount(y, minlength=2), 1)
    shares = np.array([n[v] / counted[v] for v in y], float)
    slope, intercept = calibrate(np.array([r["x"] for r in points], float), y, shares)
    return Model(dictionaries, slope, intercept)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each text, which depends on the text alone.

    Null and empty texts get the curve's intercept. Rows stay as they are; a column of that
    name is replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def score(parts):
        of = shared.value.scorer()
        for batch in parts:
            scores = [of(text.as_buffer().to_pybytes()) for text in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(scores, pa.float64())], [*kept, name]
            )

    inner = docs.select(*(docs[c] for c in kept), raw("text").alias("input of the scorer"))
    schema = docs.select(*(docs[c] for c in kept)).withColumn(name, F.lit(0.0)).schema
    return inner.mapInArrow(score, schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; null ids are not held out."""
    found = with_score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", labelled.held_out(PARTS, PART).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good."""
    name = "score of the filter"
    return with_score(docs, model, name).where(F.col(f"`{name}`") >= THRESHOLD).select(*docs.columns)
