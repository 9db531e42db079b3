"""Flagship job: raw tables to transactions, disputes and money per risk band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import risk_level
from disputeflow.operators.features import feature_table


def risk_summary(tables: dict[str, DataFrame], score: Column) -> DataFrame:
    rows = feature_table(
        tables["transactions"], tables["customers"], tables["orders"], tables["chargebacks"]
    )
    return (
        rows.select("amount", C.TARGET, risk_level(score).alias("risk_level"))
        .groupBy("risk_level")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(C.TARGET).alias("disputes"),
            F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"),
        )
    )
