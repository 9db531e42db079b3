"""Bounded, reproducible samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(parts: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have a null remainder."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(remainder(parts) == part, F.lit(False))


def training_labels(labels: DataFrame, label: str, out: Column) -> DataFrame:
    """``(doc_id, label)`` of documents that may be learnt from, one row a document.

    Null ids and labels are left out; of contradicting labels the larger counts.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~out)
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, training: DataFrame, per_label: int) -> DataFrame:
    """Texts of at most ``per_label`` documents of either label: ``(doc_id, label, rank, text)``.

    The documents are those with the smallest hash of their id. There are at most
    ``2 * per_label`` such ids, so they are broadcast and no text is shuffled to find them.
    """
    def first(value: int) -> DataFrame:
        rows = training.where(F.col("label") == value).withColumn("rank", F.xxhash64("doc_id"))
        return rows.orderBy("rank", "doc_id").limit(per_label)

    chosen = first(0).unionByName(first(1))
    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "rank", "text")


def totals(training: DataFrame) -> tuple[int, int]:
    """Documents with label 0 and with label 1."""
    found = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.get(0, 0), found.get(1, 0)
