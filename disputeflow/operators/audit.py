"""Human review decisions: validation, resolved values, audit rows and listing.

A review request row holds: review_id, reviewed_at, decision, reviewer_note,
risk_probability, risk_percentage, risk_level, ai_recommendation, ai_reasoning
(text, or array of text), policy_evidence (text, or array of {policy, score}) and a
``transaction``, a struct or a VARIANT, that may repeat the risk and investigation values,
there too as text or lists. A ``request_id``, if there, is its identity; otherwise
``review_id`` is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import first_number, normalise_probability, risk_level
from disputeflow.functions.texts import decimal_text, first_text, percent_text
from disputeflow.functions.variants import float_of, items, nothing, part, shown

AUDIT_COLUMNS = [
    "audit_key",
    "id",
    "transaction_id",
    "amount",
    "risk_probability",
    "risk_percentage",
    "risk_level",
    "ai_recommendation",
    "ai_reasoning",
    "policy_evidence",
    "human_decision",
    "reviewer_note",
    "timestamp",
]


def split_by_decision(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by membership in the allowed decisions."""
    valid = F.coalesce(F.col("decision").isin(C.DECISIONS), F.lit(False))
    rejected = requests.where(~valid).withColumn(
        "error", F.lit("Invalid review decision. Use " + ", ".join(C.DECISIONS[:2])
                       + f", or {C.DECISIONS[2]}.")
    )
    return requests.where(valid), rejected


def reviewer_note(decision: Column, transaction_id: Column) -> Column:
    return (
        F.when(decision == "APPROVED", F.format_string(C.NOTE_APPROVED, transaction_id))
        .when(decision == "REJECTED", F.format_string(C.NOTE_REJECTED, transaction_id))
        .otherwise(F.format_string(C.NOTE_ESCALATED, transaction_id))
    )


def _inside(requests: DataFrame, field: str, kind: str, read=None) -> Column:
    """A field of the transaction as ``kind``; NULL if the transaction lacks it.

    ``read`` gives the text of a VARIANT value; text and numbers are read by default.
    """
    transaction = requests.schema["transaction"].dataType
    if transaction.typeName() == "variant":
        value = part(F.col("transaction"), field)
        return float_of(value) if kind == "double" else (read or shown)(value)
    if field not in transaction.names:
        return F.lit(None).cast(kind)
    return F.col(f"transaction.{field}").cast(kind)


def resolve_risk(requests: DataFrame) -> DataFrame:
    """Effective probability, percentage and band.

    Request values win unless zero or empty, then those inside the transaction;
    one of probability and percentage fills the other; the band follows from the
    probability only if nobody named one.
    """
    p = first_number(F.col("risk_probability"), _inside(requests, "risk_probability", "double"))
    q = first_number(F.col("risk_percentage"), _inside(requests, "risk_percentage", "double"))
    named = F.coalesce(
        F.nullif(F.nullif(F.col("risk_level"), F.lit("")), F.lit(C.UNKNOWN_LEVEL)),
        _inside(requests, "risk_level", "string"),
        F.lit(C.UNKNOWN_LEVEL),
    )
    return (
        requests.withColumns({"_p": p, "_q": q, "_level": named})
        .withColumns(
            {
                "risk_probability": F.when((F.col("_p") == 0) & (F.col("_q") > 0),
                                           F.col("_q") / 100).otherwise(F.col("_p")),
                "risk_percentage": F.when((F.col("_q") == 0) & (F.col("_p") > 0),
                                          F.col("_p") * 100).otherwise(F.col("_q")),
            }
        )
        .withColumn(
            "risk_level",
            F.when(
                F.col("_level").isin(C.UNKNOWN_LEVEL, "") & (F.col("risk_probability") > 0),
                risk_level(F.col("risk_probability")),
            ).otherwise(F.col("_level")),
        )
        .drop("_p", "_q", "_level")
    )


def reasoning_text(reasons: Column) -> Column:
    return F.array_join(reasons, "\n")


def policy_text(hits: Column) -> Column:
    """Paragraphs ``policy (Relevance: score)``, or the policy alone without a score."""
    one = lambda h: F.when(
        h["score"].isNotNull(),
        F.format_string(C.RELEVANCE, h["policy"], decimal_text(h["score"], 4)),
    ).otherwise(h["policy"])
    return F.array_join(F.transform(hits, one), "\n\n")


def variant_reasoning(value: Column) -> Column:
    """Text as it is, the items of a list on lines, any other value as text; nothing given is empty."""
    lines = F.array_join(F.transform(items(value), shown), "\n")
    return F.when(nothing(value), F.lit("")).otherwise(F.coalesce(lines, shown(value)))


def variant_policies(value: Column) -> Column:
    """Text as it is, or the items of a list, with their relevance, as paragraphs."""

    def one(item: Column) -> Column:
        policy = F.coalesce(shown(part(item, "policy")), shown(item))
        score = part(item, "score")
        relevance = F.format_string(C.RELEVANCE, policy, shown(score))
        return F.when(F.is_variant_null(score) | score.isNull(), policy).otherwise(relevance)

    paragraphs = F.array_join(F.transform(items(value), one), "\n\n")
    return F.when(nothing(value), F.lit("")).otherwise(F.coalesce(paragraphs, shown(value)))


def _text_of(rows: DataFrame, column: str, from_list) -> Column:
    """A text column as it is, a list through ``from_list``."""
    kind = rows.schema[column].dataType
    return F.col(column) if kind.typeName() == "string" else from_list(F.col(column))


def audit_records(accepted: DataFrame) -> DataFrame:
    """Audit rows; the key is a digest of transaction, decision, identity and time, so a
    replayed request gives the same key. A missing part is marked, never skipped.

    ``id`` is the request's own sequence number: a counter would need one task.
    """
    rows = resolve_risk(accepted)
    text = lambda field: _inside(rows, field, "string", variant_reasoning)
    policies = lambda field: _inside(rows, field, "string", variant_policies)
    transaction_id = F.coalesce(_inside(rows, "transaction_id", "string"), F.lit(C.DEFAULT_TRANSACTION_ID))
    identity = F.col("request_id" if "request_id" in rows.columns else "review_id")
    part = lambda c: F.coalesce(c.cast("string"), F.lit("\u0000"))
    moment = F.date_trunc("second", F.col("reviewed_at").cast("timestamp"))
    return rows.select(
        F.sha2(
            F.concat_ws(
                "|", transaction_id, part(F.col("decision")), part(identity),
                part(F.date_format(moment, "yyyy-MM-dd HH:mm:ss")),
            ),
            256,
        ).alias("audit_key"),
        F.col("review_id").alias("id"),
        transaction_id.alias("transaction_id"),
        F.coalesce(_inside(rows, "amount", "double"), F.lit(0.0)).alias("amount"),
        "risk_probability",
        "risk_percentage",
        "risk_level",
        F.coalesce(
            first_text(
                F.col("ai_recommendation"), text("ai_recommendation"), text("recommendation")
            ),
            F.lit(C.DEFAULT_RECOMMENDATION),
        ).alias("ai_recommendation"),
        F.coalesce(
            first_text(
                _text_of(rows, "ai_reasoning", reasoning_text),
                text("ai_reasoning"),
                text("reasoning"),
                text("investigation_reasoning"),
            ),
            F.lit(C.DEFAULT_REASONING),
        ).alias("ai_reasoning"),
        F.coalesce(
            first_text(
                _text_of(rows, "policy_evidence", policy_text),
                policies("policy_evidence"),
                policies("supporting_policy_evidence"),
            ),
            F.lit(""),
        ).alias("policy_evidence"),
        F.col("decision").alias("human_decision"),
        F.coalesce("reviewer_note", F.lit("")).alias("reviewer_note"),
        moment.alias("timestamp"),
    )


def acknowledgements(audit: DataFrame) -> DataFrame:
    """What the reviewer gets back for each recorded decision."""
    return audit.select(
        F.lit(True).alias("success"),
        "transaction_id",
        "risk_probability",
        "risk_percentage",
        "risk_level",
        "ai_recommendation",
        F.col("human_decision").alias("decision"),
        "reviewer_note",
        F.struct("id", "transaction_id", "human_decision", "reviewer_note", "timestamp").alias(
            "audit_record"
        ),
        F.format_string(C.REVIEW_MESSAGE, F.col("human_decision")).alias("message"),
    )


def history(audit: DataFrame) -> DataFrame:
    """Newest first; replayed rows appear once."""
    return audit.dropDuplicates(["audit_key"]).orderBy(
        F.desc("id"), F.desc("timestamp"), F.desc("audit_key")
    )


def record_count(audit: DataFrame) -> DataFrame:
    """How many decisions are on record, replayed rows counting once."""
    return audit.select("audit_key").distinct().agg(F.count(F.lit(1)).alias("record_count"))


def display(audit: DataFrame) -> DataFrame:
    """Columns of the audit view with fallbacks for missing values."""
    p = normalise_probability(F.col("risk_probability"))
    share = F.coalesce(F.col("risk_percentage"), p * 100, F.lit(0.0))
    named = F.nullif(F.nullif(F.col("risk_level"), F.lit("")), F.lit(C.UNKNOWN_LEVEL))
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(C.NOT_AVAILABLE))
    return audit.select(
        "id",
        shown("transaction_id").alias("transaction_id"),
        percent_text(share).alias("risk_score"),
        F.coalesce(named, risk_level(p)).alias("risk_level"),
        shown("ai_recommendation").alias("ai_recommendation"),
        shown("human_decision").alias("decision"),
        shown("reviewer_note").alias("reviewer_note"),
        F.coalesce(
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(C.NOT_AVAILABLE)
        ).alias("timestamp"),
    )
