"""Typed fields out of JSON requests, each coerced by itself.

A request is parsed once to a VARIANT. Every declared field is then taken from it and coerced
by the kind of its own JSON value, so that one wrong field costs no other. A field is *missing*
when the request does not have it and it has no default, and *malformed* when it has a value
that its type does not accept; an explicit null is such a value.

Accepted are, beside values of the type itself: numbers, booleans and numeric text for ``float``;
whole numbers, booleans and whole numeric text for ``int`` and ``long``; text alone for ``text``;
text with a time for ``time``; objects alone for ``object``; numbers and booleans, but no text, for
``number``, and whole ones for ``count``; any value for ``shown``, as text; anything, null included,
for ``any``. Unknown fields are left alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow.functions.variants import float_of, is_object, kind_of, part, plain_text, shown, whole_of

REQUIRED = object()

class Field(NamedTuple):
    """A declared field; a default of None makes it optional."""

    name: str
    type: str
    default: object = REQUIRED


def _unless_text(value: Column, read: Column) -> Column:
    return F.when(kind_of(value) != "STRING", read)


_COERCED = {
    "float": float_of,
    "int": lambda value: whole_of(value),
    "long": lambda value: whole_of(value, "bigint"),
    "text": plain_text,
    "time": lambda value: plain_text(value).try_cast("timestamp"),
    "object": lambda value: F.when(is_object(value), value),
    "number": lambda value: _unless_text(value, float_of(value)),
    "count": lambda value: _unless_text(value, whole_of(value)),
    "shown": shown,
    "any": lambda value: value,
}


def coerced(rows: DataFrame, column: str, fields: list[Field]) -> DataFrame:
    """``rows`` with ``fields`` in place of ``column``, which is JSON text or a VARIANT, and three verdicts.

    ``unreadable`` is true for what is no JSON object; ``missing_fields`` and
    ``malformed_fields`` list names. Columns of ``rows`` named like a field are replaced.
    ``inline`` keeps later filters from being pushed below the parsing, where they would parse
    the text again for every field they test. The fields of a type are coerced as one list, so that
    each value is coerced once and the code does not grow with the number of fields.
    """
    names = [f.name for f in fields]
    verdicts = ["unreadable", "missing_fields", "malformed_fields"]
    kept = [c for c in rows.columns if c not in (column, *names, *verdicts)]
    is_text = rows.schema[column].dataType.typeName() == "string"
    parsed = F.try_parse_json(column) if is_text else F.col(column)
    found = rows.select(*kept, _once(parsed.alias("request  ")))
    request = F.when(is_object(F.col("request  ")), F.col("request  "))
    found = found.select(*kept, _once(request.alias("request  ")))
    sent = F.array(*[part(F.col("request  "), name) for name in names])
    given = found.select(*kept, _once(F.col("request  ").isNull().alias("unreadable"), sent.alias("sent  ")))
    kinds = {kind: [i for i, f in enumerate(fields) if f.type == kind] for kind in dict.fromkeys(f.type for f in fields)}
    read = [
        F.transform(F.array(*[F.get("sent  ", F.lit(i)) for i in places]), _COERCED[kind]).alias(f"{kind}  ")
        for kind, places in kinds.items()
    ]
    done = given.select(*kept, _once("unreadable", "sent  ", *read))
    values = [F.get(f"{f.type}  ", F.lit(kinds[f.type].index(i))) for i, f in enumerate(fields)]
    sent = [F.get("sent  ", F.lit(i)) for i in range(len(fields))]
    missing = F.array_compact(F.array(*[
        F.when(sent[i].isNull(), F.lit(f.name)) for i, f in enumerate(fields) if f.default is REQUIRED
    ]).cast("array<string>"))
    # of a value that is there, only a coercion that gives nothing is malformed
    wrong = F.array_compact(F.array(*[
        F.when(sent[i].isNotNull() & values[i].isNull(), F.lit(f.name)) for i, f in enumerate(fields) if f.type != "any"
    ]).cast("array<string>"))
    none = F.array().cast("array<string>")
    filled = [
        (values[i] if f.default in (REQUIRED, None) else F.when(sent[i].isNull(), F.lit(f.default)).otherwise(values[i]))
        .alias(f.name)
        for i, f in enumerate(fields)
    ]
    return done.select(*kept, _once(
        *filled,
        "unreadable",
        F.when(F.col("unreadable"), none).otherwise(missing).alias("missing_fields"),
        F.when(F.col("unreadable"), none).otherwise(wrong).alias("malformed_fields"),
    ))


def _once(*columns: Column | str) -> Column:
    """Columns that are computed once, however often later steps use them."""
    return F.inline(F.array(F.struct(*columns)))


def problem() -> Column:
    """Why a coerced request is turned away; NULL for a good one."""
    def named(what: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{what}: "), F.array_join(column, ", ")))

    reasons = F.concat_ws("; ", named("missing", "missing_fields"), named("malformed", "malformed_fields"))
    return F.when(F.col("unreadable"), F.lit("malformed request")).when(reasons != "", reasons)
