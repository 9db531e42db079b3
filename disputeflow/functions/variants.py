"""Column expressions on VARIANT values, by the kind of the JSON value they hold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The forms of numeric text that count as numbers.
DIGITS = r"[0-9]+(_[0-9]+)*"
WHOLE_TEXT = rf"^[+-]?{DIGITS}(\.0+)?$"
FLOAT_TEXT = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"
SPECIAL_TEXT = r"^(?i)[+-]?(inf|infinity|nan)$"


def kind_of(value: Column) -> Column:
    """The kind of a VARIANT: BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(value)


def part(value: Column, name: str) -> Column:
    """A field of a VARIANT object as a VARIANT; NULL where the object lacks it."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def is_number(value: Column) -> Column:
    kind = kind_of(value)
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; its kind would tell the kinds of all that is in it."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def plain_text(value: Column) -> Column:
    """The text of a VARIANT that is text, else NULL."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def float_of(value: Column) -> Column:
    said = F.trim(plain_text(value))
    digits = F.replace(said, F.lit("_"), F.lit(""))
    # "nan" and "inf" are spelled in several ways, which a cast does not all know
    special = (
        F.when(F.lower(said).contains("nan"), F.lit(float("nan")))
        .when(said.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return (
        F.when(is_number(value) | (kind_of(value) == "BOOLEAN"), F.try_variant_get(value, "$", "double"))
        .when(said.rlike(FLOAT_TEXT), digits.try_cast("double"))
        .when(said.rlike(SPECIAL_TEXT), special)
    )


def whole_of(value: Column, kind: str = "int") -> Column:
    """A whole number; NULL also where it does not fit ``kind``."""
    number = F.try_variant_get(value, "$", "double")
    said = F.trim(plain_text(value))
    digits = F.regexp_replace(F.replace(said, F.lit("_"), F.lit("")), r"\.0+$", "")
    return (
        F.when(kind_of(value).isin("BIGINT", "BOOLEAN"), F.try_variant_get(value, "$", kind))
        .when(is_number(value) & (number == F.floor(number)), number.try_cast(kind))
        .when(said.rlike(WHOLE_TEXT), digits.try_cast(kind))
    )


def shown(value: Column) -> Column:
    """Any VARIANT as text: text as it is, True, False and None by name, lists and objects as JSON."""
    kind, text = kind_of(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "VOID", F.lit("None"))
        .otherwise(text)
    )


def items(value: Column) -> Column:
    """The items of a VARIANT list; NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def nothing(value: Column) -> Column:
    """Whether a value counts as not given: null, empty text, zero, false, an empty list or object."""
    text = F.try_variant_get(value, "$", "string")
    zero = (is_number(value) | (kind_of(value) == "BOOLEAN")) & (F.try_variant_get(value, "$", "double") == 0)
    return text.isNull() | text.isin("", "[]", "{}") & ~is_number(value) | zero
