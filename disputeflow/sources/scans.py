"""Scans of tables and text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from disputeflow import constants as C
from disputeflow.sources import schemas


def read_table(spark: SparkSession, path: str, name: str, file_format: str = "csv") -> DataFrame:
    """A canonical table with its declared schema; never inferred."""
    reader = spark.read.schema(schemas.TABLES[name])
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path)


def require_column(rows: DataFrame, name: str = C.TARGET) -> DataFrame:
    if name not in rows.columns:
        raise ValueError(f"column {name!r} was not found; available: {rows.columns}")
    return rows


def read_model_table(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """The feature table; fails if the path or the target column is absent.

    A CSV file has its columns in any order; their types are those of the declared feature table, and
    columns that it does not name are text. Nothing is inferred from the data.
    """
    if file_format != "csv":
        return require_column(spark.read.format(file_format).load(path))
    reader = spark.read.option("header", True)
    declared = {f.name: f for f in spark.createDataFrame([], schemas.MODEL_TABLE).schema}
    header = reader.option("enforceSchema", False).csv(path).columns
    kinds = ", ".join(f"`{c}` {declared[c].dataType.simpleString() if c in declared else 'string'}" for c in header)
    return require_column(reader.schema(kinds).csv(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_RESULTS).option("header", True).csv(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.THRESHOLD_RESULTS).option("header", True).csv(path)


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per whole UTF-8 file."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )
