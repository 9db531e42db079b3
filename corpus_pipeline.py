"""Documents to token ids: the training-data operators of ``disputeflow.llm`` in order.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written and read
again as the next stage's documents. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disputeflow.llm import bpe, decontamination, near_dedup, quality, suffix_dedup
from disputeflow.llm.frames import kept
from disputeflow.llm.queries import table

#: Pre-tokens that a worker remembers. Executors hold what the earlier stages left as well: fewer than ``encode`` does alone.
REMEMBERED = 1 << 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are at least 80 % alike."""
    return near_dedup.one_of_each(docs, width=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier."""
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 1 in 20 words is in a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, which decode to the text."""
    return bpe.encode(docs, bpe.public_ranks(), remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The stages fit models, sort hashes and merge bytes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
