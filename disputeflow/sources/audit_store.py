"""The audit table: declared once, appended in batches, read by what was committed.

Below the store's folder, ``data/batch=../attempt=../review_date=..`` has the rows and
``manifest/batch=..`` one row for each batch: which attempt counts and how many rows it has. A
batch is written to an attempt of its own first, and committed by its manifest row. An attempt
that failed half-way is never read, and a batch that is committed is not written again,
so a replayed batch adds nothing. Tables, streams and single reviews use the same layout.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from disputeflow.sources import schemas

PLACES = "batch string, attempt string, review_date date"
MANIFEST = "attempt string, n_rows bigint, columns string, batch string"
DECLARED = "declared"


class AuditStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.data, self.manifest = f"{folder.rstrip('/')}/data", f"{folder.rstrip('/')}/manifest"

    def declare(self) -> AuditStore:
        """Creates the empty table; nothing if it is there, an error if its columns differ."""
        columns = " ".join(schemas.AUDIT.split())
        known = [r["columns"] for r in self._committed(DECLARED)]
        if known and known != [columns]:
            raise ValueError(f"the audit table was declared as {known[0]}")
        if not known:
            empty = self.spark.createDataFrame([], f"{schemas.AUDIT}, review_date date")
            self._commit(DECLARED, self._write(empty, DECLARED), columns)
        return self

    def append(self, audit: DataFrame, batch: str | int) -> int:
        """Rows that ``batch`` has added: none when it was committed before.

        A NULL in a column that was declared NOT NULL fails the batch, which leaves nothing behind.
        """
        batch = str(batch)
        if batch == DECLARED or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not the name of a batch: {batch!r}")
        if self._committed(batch):
            return 0
        kinds = self.spark.createDataFrame([], schemas.AUDIT).schema
        checked = audit.select(*(self._checked(f.name, f.nullable).cast(f.dataType).alias(f.name) for f in kinds))
        attempt = self._write(checked.withColumn("review_date", F.to_date("timestamp")), batch)
        return self._commit(batch, attempt)

    def read(self) -> DataFrame:
        """All committed rows, with the declared columns."""
        rows = self.spark.read.schema(f"{schemas.AUDIT}, {PLACES}").parquet(self.data)
        manifest = self.spark.read.schema(MANIFEST).parquet(self.manifest).select("batch", "attempt")
        names = [c for c in rows.columns if c not in ("batch", "attempt", "review_date")]
        return rows.join(manifest, ["batch", "attempt"], "left_semi").select(*names)

    def batches(self) -> DataFrame:
        """(batch, n_rows) of each commit."""
        rows = self.spark.read.schema(MANIFEST).parquet(self.manifest)
        return rows.where(F.col("batch") != DECLARED).select("batch", "n_rows")

    @staticmethod
    def _checked(name: str, nullable: bool) -> Column:
        if nullable:
            return F.col(name)
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"NULL in the audit column {name}")))

    def _committed(self, batch: str) -> list:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self.manifest)
        except AnalysisException:  # no manifest yet
            return []
        return rows.where(F.col("batch") == batch).collect()

    def _write(self, rows: DataFrame, batch: str) -> str:
        attempt = uuid.uuid4().hex
        rows.write.partitionBy("review_date").parquet(self._attempt(batch, attempt))
        return attempt

    def _attempt(self, batch: str, attempt: str) -> str:
        return f"{self.data}/batch={batch}/attempt={attempt}"

    def _commit(self, batch: str, attempt: str, columns: str | None = None) -> int:
        n = self.spark.read.schema(f"{schemas.AUDIT}, review_date date").parquet(self._attempt(batch, attempt)).count()
        row = self.spark.createDataFrame([(attempt, n, columns)], "attempt string, n_rows bigint, columns string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.manifest}/batch={batch}")
        return n
