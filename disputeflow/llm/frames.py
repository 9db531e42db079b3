"""Small helpers shared by the operators: Arrow rows in and out, input columns, storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from disputeflow.session import shared_folder, stored

ROWS = 2_000
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def raw(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, made longer until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``batches``, a slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield from zip(*(column.to_pylist() for column in part.columns))


def batches(found: Iterable[tuple], schema: pa.Schema, size: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    buffer: list[tuple] = []
    for row in found:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(buffer: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*buffer), schema)], schema=schema)


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``staged`` within are deleted at the end; what is to last is ``kept``."""
    folder = shared_folder(spark, "scratch")
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, folder)


def spent(frame: DataFrame) -> None:
    """Deletes the scratch tables that ``frame`` reads: no frame over them is to run again."""
    folder = _SCRATCH.get()
    if folder is None:
        return
    within = f"/{folder.rsplit('/', 1)[-1]}/"
    for name in {f.split(within, 1)[1].split("/", 1)[0] for f in frame.inputFiles() if within in f}:
        delete(frame.sparkSession, f"{folder}/{name}")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them has ended, not when the driver's memory is next cleaned."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` written once to the shared folder and read back: later passes reread it.

    Within ``scratch`` it goes with the other scratch tables.
    """
    folder = _SCRATCH.get()
    if folder is None:
        return stored(frame, purpose)
    path = f"{folder}/{purpose.replace(' ', '-')}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def kept(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` written to the shared folder to stay, and read back."""
    return stored(frame, purpose)
