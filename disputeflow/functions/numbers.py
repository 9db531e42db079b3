"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from disputeflow import constants as C


def clean_number(value: Column) -> Column:
    """NaN and the infinities become NULL."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def safe_ratio(top: Column, bottom: Column, guard: str = "zero") -> Column:
    """``top / bottom`` with 0 wherever the quotient is undefined.

    guard="zero" refuses only a zero denominator (batch rule),
    guard="nonpositive" refuses negative ones too (request rule).
    """
    if guard not in ("zero", "nonpositive"):
        raise ValueError(f"unknown guard {guard!r}")
    bottom = bottom.cast("double")
    usable = bottom != 0 if guard == "zero" else bottom > 0
    quotient = F.try_divide(top.cast("double"), F.when(usable, bottom))
    return F.coalesce(clean_number(quotient), F.lit(0.0))


def flag(condition: Column) -> Column:
    """A condition as 0/1, undefined counting as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability.isNull() | F.isnan(probability), C.UNKNOWN_LEVEL)
        .when(probability >= C.HIGH_RISK, "HIGH")
        .when(probability >= C.MEDIUM_RISK, "MEDIUM")
        .otherwise("LOW")
    )


def normalise_probability(value: Column) -> Column:
    """Percentages (above 1) are divided by 100, then clamped to [0, 1]; NaN is NULL."""
    value = value.cast("double")
    value = F.when(~F.isnan(value), value)
    scaled = F.when(value > 1, value / 100).otherwise(value)
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def percentage(probability: Column) -> Column:
    return F.round(probability * 100, 2)


def percent_over(amount: Column, average: Column) -> Column:
    """How far the amount is above the average, one digit; NULL unless above it."""
    applies = (amount > 0) & (average > 0) & (amount > average)
    return F.when(applies, F.round(F.try_divide(amount - average, average) * 100, 1))


def first_number(*values: Column) -> Column:
    """The first value that is neither NULL nor zero, else 0."""
    return F.coalesce(*[F.nullif(v.cast("double"), F.lit(0.0)) for v in values], F.lit(0.0))
