"""Routing of a scored transaction to a human or to monitoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import risk_level


def financial_impact(amount: Column) -> Column:
    return F.when(amount > C.HIGH_IMPACT_AMOUNT, "HIGH").otherwise("NORMAL")


def signals_conflict(risk: Column, mitigating: Column) -> Column:
    return (F.size(risk) > 0) & (F.size(mitigating) > 0)


def review_action(
    probability: Column,
    evidence_available: Column,
    conflicting: Column | None = None,
    impact: Column | None = None,
) -> Column:
    """Struct (action, priority, reason, risk_level, risk_probability, human_required).

    The first matching rule decides: missing evidence, conflict, high risk, medium
    risk with or without high impact, low risk.
    """
    conflicting = F.lit(False) if conflicting is None else F.coalesce(conflicting, F.lit(False))
    impact = F.lit("NORMAL") if impact is None else F.coalesce(impact, F.lit("NORMAL"))
    level = risk_level(probability)

    def outcome(action: str, priority: str, reason: str) -> Column:
        return F.struct(
            F.lit(action).alias("action"),
            F.lit(priority).alias("priority"),
            F.lit(reason).alias("reason"),
        )

    rule = (
        F.when(~F.coalesce(evidence_available, F.lit(False)),
               outcome("ESCALATE", "HIGH", C.REASON_NO_EVIDENCE))
        .when(conflicting, outcome("ESCALATE", "HIGH", C.REASON_CONFLICT))
        .when(level == "HIGH", outcome("ESCALATE", "HIGH", C.REASON_HIGH))
        .when((level == "MEDIUM") & (F.upper(impact) == "HIGH"),
              outcome("ESCALATE", "HIGH", C.REASON_MEDIUM_IMPACT))
        .when(level == "MEDIUM", outcome("REVIEW", "MEDIUM", C.REASON_MEDIUM))
        .when(level == "LOW", outcome("MONITOR", "LOW", C.REASON_LOW))
    )
    return F.struct(
        rule["action"].alias("action"),
        rule["priority"].alias("priority"),
        rule["reason"].alias("reason"),
        level.alias("risk_level"),
        F.round(probability, 4).alias("risk_probability"),
        (rule["action"] != "MONITOR").alias("human_required"),
    )
