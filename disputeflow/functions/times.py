"""Calendar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from disputeflow.functions.numbers import flag


def parse_time(value: Column) -> Column:
    """A timestamp, or NULL for text that is none."""
    return F.try_to_timestamp(value.cast("string"))


def hour_of_day(time: Column) -> Column:
    return F.hour(time)


def day_of_week(time: Column) -> Column:
    """Monday is 0."""
    return F.weekday(time)


def weekend(time: Column) -> Column:
    return flag(day_of_week(time) >= 5)
