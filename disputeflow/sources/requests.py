"""Typed parsing of JSON requests: scoring, investigation and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.operators.audit import variant_policies, variant_reasoning
from disputeflow.sources import schemas
from disputeflow.sources.coercion import Field, coerced, problem

VERDICTS = ["unreadable", "missing_fields", "malformed_fields"]
TYPES = {"string": "text", "double": "float", "int": "int"}

SCORE_FIELDS = [
    Field(name, TYPES[kind], *([C.DEFAULT_TRANSACTION_ID] if name == "transaction_id" else []))
    for name, kind in map(str.split, schemas.SCORE_REQUEST.split(","))
]
INVESTIGATION_FIELDS = [Field("risk_probability", "float"), Field("query", "text"), Field("transaction", "object")]
#: What the signals look at within an investigation's transaction; all of it may be absent.
SIGNAL_FIELDS = [
    Field("transaction_id", "shown", None), Field("amount", "number", None), Field("average_order_value", "number", None),
    *(Field(name, "count", None) for name in (
        "previous_chargebacks", "previous_refunds", "account_age_days", "successful_transactions", "known_devices",
    )),
    Field("is_new_customer", "any", None), Field("authentication_status", "shown", None),
    Field("delivery_status", "shown", None),
]
REVIEW_FIELDS = [
    Field("review_id", "long", None), Field("reviewed_at", "time", None), Field("transaction", "object"),
    Field("decision", "text"), Field("reviewer_note", "text", ""), Field("risk_probability", "float", 0.0),
    Field("risk_percentage", "float", 0.0), Field("risk_level", "text", C.UNKNOWN_LEVEL),
    Field("ai_recommendation", "text", ""), Field("ai_reasoning", "any", None), Field("policy_evidence", "any", None),
]


def score_requests(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejects with ``error`` and the missing and the malformed fields)."""
    tagged = coerced(rows, column, SCORE_FIELDS).withColumn("error", problem())
    good = tagged.where("error is null").drop("error", *VERDICTS)
    return good, tagged.where("error is not null").drop("unreadable")


def investigation_requests(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests with the fields that the signals look at, rejects with ``request`` and ``error``).

    ``transaction`` stays as it was sent, a VARIANT, beside the columns taken from it, so that a
    report can give all of it back. A number in it that is text, and a count that is not whole,
    is malformed. ``query_id`` is a digest of the query's text.
    """
    raw = rows.withColumn("request", F.col(column))
    outer = coerced(raw, column, INVESTIGATION_FIELDS).withColumn("error", problem()).drop(*VERDICTS)
    # an unreadable transaction is told by the outer error alone
    inner = coerced(outer.withColumn("transaction  ", F.coalesce("transaction", F.parse_json(F.lit("{}")))),
                    "transaction  ", SIGNAL_FIELDS)
    wrong = F.transform("malformed_fields", lambda name: F.concat(F.lit("transaction."), name))
    inside = F.when(F.size("malformed_fields") > 0, F.concat(F.lit("malformed: "), F.array_join(wrong, ", ")))
    tagged = inner.withColumns({
        "error": F.coalesce("error", inside),
        "is_new_customer": (F.try_variant_get("is_new_customer", "$", "double") == 1).cast("int"),
        "query_id": F.sha2("query", 256),
    })
    fields = [f.name for f in [*INVESTIGATION_FIELDS, *SIGNAL_FIELDS]]
    kept = [c for c in rows.columns if c not in (column, "request", *fields)]
    good = tagged.where("error is null").drop("error", "request", *VERDICTS)
    return good, tagged.where("error is not null").select(*kept, "request", "error")


def review_requests(
    rows: DataFrame,
    column: str = "value",
    identity: str = "request_id",
    received: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(review requests with the published defaults, rejects with an error).

    ``identity`` names a column that tells requests apart for good (the caller's id, or
    source file and offset): two equal decisions on one transaction are two requests, and a
    replayed one is the same. A request has no time of its own, so it gets ``received``, the
    current second unless given; store the result, so that a replay keeps it.
    Reasoning and evidence may be text, a list or any other value; ``transaction`` stays a VARIANT.
    Requests without an identity, and those that cannot be coerced, are rejects.
    """
    known = F.col(identity).cast("string")
    parsed = coerced(rows.withColumn("_raw", F.col(column)), column, REVIEW_FIELDS)
    error = F.when(known.isNull(), F.lit("request has no identity")).otherwise(problem())
    tagged = parsed.withColumn("error", error)
    clock = F.current_timestamp() if received is None else received
    good = tagged.where("error is null").withColumns(
        {
            "request_id": known,
            "reviewed_at": F.coalesce("reviewed_at", F.date_trunc("second", clock)),
            "ai_reasoning": variant_reasoning(F.col("ai_reasoning")),
            "policy_evidence": variant_policies(F.col("policy_evidence")),
        }
    )
    rejected = tagged.where("error is not null").select(
        known.alias("request_id"), F.col("_raw").alias("request"), "error"
    )
    return good.drop("error", "_raw", *VERDICTS), rejected
