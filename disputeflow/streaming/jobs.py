"""Streams of transactions, investigations and review decisions.

Each batch writes to its own ``batch_id=n`` folder in overwrite mode, so a batch
repeated after a failure replaces its earlier output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from disputeflow import constants as C
from disputeflow.operators import audit, features, report, retrieval
from disputeflow.operators.skew import COPIES
from disputeflow.plans.modelling import score
from disputeflow.sources.audit_store import AuditStore
from disputeflow.sources.sinks import load_model, model_path


def read_stream(
    spark: SparkSession, folder: str, schema, glob: str | None = None, max_files: int = 1000
) -> DataFrame:
    """A parquet folder as a stream; ``glob`` picks files by name.

    ``max_files`` bounds a micro-batch, and with it what one hot key can bring at once.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def enrich(
    transactions: DataFrame,
    customers: DataFrame,
    orders: DataFrame,
    guard: str = "nonpositive",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Stream-static left joins and the shared feature expressions.

    Each micro-batch is a small fact table; Spark broadcasts a static side only
    when its measured size allows it. ``hot`` is the stored ``skew.replication`` table of the
    customers in earlier transactions: a customer with a third of them is spread by it, since
    a stream cannot be counted. Without it no customer is taken to be hot.
    """
    if hot is None:
        hot = customers.select("customer_id", F.lit(1).alias(COPIES)).limit(0)
    rows = features.with_customers(transactions, customers, hot).join(
        orders.select(*features.ORDER_COLUMNS, "delivery_status", "refund_status"),
        "transaction_id",
        "left",
    )
    return features.derive_features(features.add_calendar(rows), guard)


def score_stream(enriched: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    return report.score_records(score(model, enriched), name)


def start_table(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append to a parquet folder; without ``every`` all available input, then stop."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(path)
    )


def start_batches(
    rows: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        rows.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


@contextmanager
def held(batch: DataFrame):
    """The batch in memory, so that its several writes read the source once."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch_id={batch_id}")


class ModelFile:
    """A saved model, loaded again only when its saved copy has changed."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder, name
        self.version, self.model = None, None

    def current(self) -> PipelineModel:
        path = f"{model_path(self.folder, self.name)}/metadata"
        saved = self.spark.read.json(path).select("uid", "timestamp").first()
        if saved != self.version:
            self.model, self.version = load_model(self.folder, self.name), saved
        return self.model


def score_batches(model: ModelFile, folder: str) -> Callable[[DataFrame, int], None]:
    """Scores each batch with the newest saved model."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(score_stream(batch, model.current(), model.name), folder, batch_id)

    return each


def investigate_batches(
    corpus: DataFrame, index: retrieval.Index, folder: str, model: str = C.RANDOM_FOREST
) -> Callable[[DataFrame, int], None]:
    """Retrieval for the batch's distinct queries, then signals, routing and report.

    Requests hold transaction_id, query, risk_probability and the transaction's columns.
    Requests without a usable probability go to a side table.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            usable, rejected = report.reject_incomplete(
                batch, ["transaction_id", "risk_probability"]
            )
            # one id may carry several texts: the text itself is the key
            usable = usable.withColumn("query_id", F.sha2("query", 256))
            queries = usable.select("query_id", "query").distinct()
            hits = retrieval.retrieve(corpus, queries, index=index)
            write_batch(retrieval.pack_hits(hits, corpus), f"{folder}/policy-hits", batch_id)
            packed = batch.sparkSession.read.parquet(f"{folder}/policy-hits/batch_id={batch_id}")
            done = report.investigate(report.attach_policies(usable, packed), model)
            write_batch(done, f"{folder}/reports", batch_id)
            write_batch(rejected, f"{folder}/rejects", batch_id)

    return each


def review_batches(store: AuditStore, folder: str) -> Callable[[DataFrame, int], None]:
    """Valid decisions to the audit store, the others to a side table below ``folder``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            accepted, rejected = audit.split_by_decision(batch)
            store.append(audit.audit_records(accepted), batch_id)
            write_batch(rejected, f"{folder}/rejects", batch_id)

    return each
