"""Column statistics that need no task to hold a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from disputeflow import constants as C
from disputeflow.operators.selection import select_ranks


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, rows in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(C.TARGET).agg(F.count(F.lit(1)).alias("transactions")).orderBy(C.TARGET)


def label_summary(rows: DataFrame) -> DataFrame:
    """Positives, negatives, positive rate and negatives per positive."""
    positives = F.count_if(F.col(C.TARGET) == 1)
    negatives = F.count_if(F.col(C.TARGET) == 0)
    return rows.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.round(F.avg(C.TARGET), 6).alias("positive_rate"),
        F.round(F.try_divide(negatives.cast("double"), positives.cast("double")), 6).alias(
            "imbalance_ratio"
        ),
    )


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight n / (2 * n_class) per label (two rows)."""
    counts = rows.groupBy(C.TARGET).agg(F.count(F.lit(1)).alias("class_rows"))
    total = counts.agg(F.sum("class_rows").alias("n")).scalar()
    return counts.withColumn(
        "class_weight", total.cast("double") / (F.col("class_rows") * 2)
    )


def missing_cells(rows: DataFrame) -> DataFrame:
    """NULLs (and NaN) over all cells, in one pass."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    per_column = []
    for name, kind in kinds.items():
        empty = F.col(name).isNull()
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            empty = empty | F.isnan(name)
        per_column.append(F.count_if(empty))
    total = per_column[0]
    for count in per_column[1:]:
        total = total + count
    return rows.agg(total.alias("missing_cells"), F.count(F.lit(1)).alias("row_count"))


def _long(rows: DataFrame, columns: list[str], kind: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(kind).alias("value"))
        for c in columns
    ]
    return rows.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def exact_medians(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, median) with the exact, interpolated median of each column.

    The two middle ranks are found digit by digit, so that no task holds or sorts a column and
    no sketch decides. ``rows`` is read once a round, two or three times mostly: store it first.
    NULL and NaN do not count; a column without values has a NULL median.
    """
    medians = list(median_map(rows, columns).items())
    return rows.sparkSession.createDataFrame(medians, "column_name string, median double")


def median_map(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """The medians as a dict: one number per column reaches the driver."""
    cells = [F.struct(F.lit(c).alias("group"), F.col(c).cast("double").alias("value")) for c in columns]
    middle = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1}
    found = select_ranks(rows.select(F.inline(F.array(*cells))), middle) if columns else {}
    return {c: (found[c, "low"] + found[c, "high"]) / 2 if (c, "low") in found else None for c in columns}


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return (
        _long(rows, columns, "string")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest one on a tie."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value")))
    return (
        value_counts(rows, columns)
        .groupBy("column_name")
        .agg(best.alias("best"))
        .select(
            "column_name",
            F.col("best.value").alias("mode_value"),
            (-F.col("best.minus_n")).alias("mode_count"),
        )
    )


def scaler_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation per column, in one pass."""
    wide = rows.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*cells)))


def category_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column in order, one row each."""
    return value_counts(rows, columns).orderBy("column_name", "value")
