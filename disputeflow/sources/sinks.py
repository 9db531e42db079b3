"""Writers of the model table, result tables, documents and models; audit rows have their own store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from disputeflow.functions.texts import slug
from disputeflow.sources import schemas


def write_table(rows: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def write_results(results: DataFrame, path: str) -> None:
    """Model comparison or threshold table: a handful of rows, one CSV file."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_thresholds(sweep: DataFrame, path: str) -> None:
    """The threshold table in its published column order."""
    write_results(sweep.select(*[part.split()[0] for part in schemas.THRESHOLD_RESULTS.split(",")]), path)


def write_document(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def model_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{slug(name)}"


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = model_path(folder, name)
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(model_path(folder, name))
