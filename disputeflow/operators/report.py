"""Score records and investigation reports as table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import normalise_probability, percentage, risk_level
from disputeflow.functions.texts import decimal_text
from disputeflow.operators.review import financial_impact, review_action, signals_conflict
from disputeflow.operators.signals import signal_texts, with_signals
from disputeflow.operators.skew import join_dimension

DISCLAIMER = (
    "Mandatory human review. This engine gives merchant defence decision support only; "
    "the final financial decision rests with the human analyst."
)


def score_records(scored: DataFrame, model: str = C.RANDOM_FOREST) -> DataFrame:
    """transaction_id, rounded probability and percentage, band, model name."""
    p = F.col("score")
    return scored.select(
        "transaction_id",
        F.round(p, 4).alias("risk_probability"),
        F.round(p * 100, 2).alias("risk_percentage"),
        risk_level(p).alias("risk_level"),
        F.lit(model).alias("model"),
    )


def reject_incomplete(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rejected rows with ``missing_fields``)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = rows.withColumn("missing_fields", missing)
    complete = marked.where(F.size("missing_fields") == 0).drop("missing_fields")
    return complete, marked.where(F.size("missing_fields") > 0)


def attach_policies(
    requests: DataFrame, packed: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Policy hits of each request's query; most requests share a few queries."""
    joined = join_dimension(requests, packed, "query_id", keys=keys)
    kind = packed.schema["policy_evidence"].dataType.simpleString()
    return joined.withColumn(
        "policy_evidence", F.coalesce("policy_evidence", F.array().cast(kind))
    )


def recommended_action(level: Column) -> Column:
    return (
        F.when(level == "HIGH", C.ACTION_HIGH)
        .when(level == "MEDIUM", C.ACTION_MEDIUM)
        .otherwise(C.ACTION_LOW)
    )


def _listed(signals: Column) -> Column:
    first_two = F.array_join(F.slice(signals, 1, 2), ", ")
    return F.when(F.size(signals) > 0, first_two).otherwise(C.NO_SIGNALS)


def investigate(requests: DataFrame, model: str = C.RANDOM_FOREST) -> DataFrame:
    """Adds the report columns to requests.

    ``requests`` hold transaction_id, risk_probability (probability or percentage),
    policy_evidence and whatever transaction columns the signals look at.  Rows
    without a usable probability must be rejected before.
    """
    rows = with_signals(
        requests.withColumn("_p", normalise_probability(F.col("risk_probability")))
    )
    risk = signal_texts(F.col("risk_signals"))
    mitigating = signal_texts(F.col("mitigating_signals"))
    evidence = F.col("policy_evidence")
    rows = rows.withColumns(
        {
            "key_risk_signals": risk,
            "key_mitigating_signals": mitigating,
            "risk_level": risk_level(F.col("_p")),
            "risk_percentage": percentage(F.col("_p")),
            "human_review": review_action(
                F.col("_p"),
                F.size(evidence) > 0,
                signals_conflict(F.col("risk_signals"), F.col("mitigating_signals")),
                financial_impact(F.col("amount")),
            ),
        }
    )
    ml_signal = F.format_string(
        C.ML_SIGNAL, F.lit(model), F.col("risk_level"), decimal_text(F.col("risk_percentage"), 2)
    )
    rows = rows.withColumn("ml_signal", ml_signal)
    reasoning = F.array(
        F.format_string(C.REASONING_MODEL, F.col("ml_signal")),
        F.format_string(
            C.REASONING_SIGNALS,
            F.size("key_risk_signals").cast("string"),
            _listed(F.col("key_risk_signals")),
            F.size("key_mitigating_signals").cast("string"),
            _listed(F.col("key_mitigating_signals")),
        ),
        F.when(
            F.size(evidence) > 0,
            F.format_string(C.REASONING_POLICIES, F.size(evidence).cast("string")),
        ).otherwise(C.REASONING_NO_POLICIES),
        F.format_string(C.REASONING_ADVICE, F.col("human_review.reason")),
    )
    return rows.withColumns(
        {
            "risk_probability": F.round("_p", 4),
            "recommended_action": recommended_action(F.col("risk_level")),
            "reasoning": reasoning,
        }
    ).drop("_p")


def report_documents(investigated: DataFrame, summary: list[str] | None = None) -> DataFrame:
    """One JSON report per transaction; published alias keys appear only here.

    The report repeats the whole ``transaction`` as it was sent, with keys that no schema
    names, or the columns in ``summary`` for rows that come from tables.
    """
    review = F.col("human_review")
    whole = F.col("transaction") if summary is None else F.struct(*summary)
    report = F.struct(
        F.struct("risk_probability", "risk_percentage", "risk_level", "ml_signal").alias(
            "risk_assessment"
        ),
        "key_risk_signals",
        "key_mitigating_signals",
        "recommended_action",
        F.col("recommended_action").alias("recommendation"),
        "reasoning",
        F.col("reasoning").alias("investigation_reasoning"),
        F.col("policy_evidence").alias("supporting_policy_evidence"),
        "policy_evidence",
        F.struct(
            review["human_required"].alias("human_required"),
            review["action"].alias("action"),
            F.lit(True).alias("defense_only"),
            F.lit(DISCLAIMER).alias("disclaimer"),
        ).alias("human_review_requirement"),
        "human_review",
        whole.alias("transaction_summary"),
        F.lit(C.EVIDENCE_WARNING).alias("evidence_warning"),
    )
    return investigated.select("transaction_id", F.to_json(report).alias("report"))
