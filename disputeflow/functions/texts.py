"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from disputeflow import constants as C


def trim_space(text: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def money_text(amount: Column, whole: Column | None = None) -> Column:
    """Thousands separated by commas and all digits of the fraction, at least one: 1,249.0.

    Where ``whole`` is true, by default for columns of whole numbers, there is no fraction: 1,249.
    """
    text = F.call_function("format_number", amount.cast("double"), F.lit(C.MONEY_FORMAT))
    if whole is None:  # known when the plan is made, so that one branch is left
        whole = F.typeof(amount).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, F.format_number(amount, 0)).otherwise(text)


def decimal_text(value: Column, digits: int) -> Column:
    """A rounded number without trailing zeros, one digit kept: 0.5, 12.0, 0.0005."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d+?)0+$", "$1")


def first_text(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def numbered(prefix: str, number: Column, width: int) -> Column:
    """Zero-padded identifier; longer numbers keep all digits.

    Padding stays in generated code, unlike ``format_string``, which starts a
    formatter for each row.
    """
    number = number.cast("bigint")
    digits = F.abs(number).cast("string")
    room = F.greatest(F.length(digits), F.when(number < 0, width - 1).otherwise(width))
    sign = F.when(number < 0, f"{prefix}-").otherwise(prefix)
    return F.concat(sign, F.lpad(digits, room, F.lit("0")))


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def tokens(text: Column) -> Column:
    """Lower-case word tokens of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.TOKEN_PATTERN), F.lit(1))


def percent_text(value: Column) -> Column:
    return F.when(
        value.isNull() | F.isnan(value), C.NOT_AVAILABLE
    ).otherwise(F.format_string("%.2f%%", value))
