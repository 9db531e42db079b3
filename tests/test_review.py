from __future__ import annotations

import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cases import FIELDS, demo
from disputeflow import constants as C
from disputeflow.operators import report, review, signals


@pytest.mark.parametrize(
    "p, evidence, conflict, impact, expected",
    [
        (0.82, True, False, "NORMAL", ("HIGH", "ESCALATE", "HIGH", True)),
        (0.58, True, False, "NORMAL", ("MEDIUM", "REVIEW", "MEDIUM", True)),
        (0.20, True, False, "NORMAL", ("LOW", "MONITOR", "LOW", False)),
        (0.45, False, False, "NORMAL", ("MEDIUM", "ESCALATE", "HIGH", True)),
        (0.50, True, True, "NORMAL", ("MEDIUM", "ESCALATE", "HIGH", True)),
        (0.70, True, False, "NORMAL", ("HIGH", "ESCALATE", "HIGH", True)),
        (0.40, True, False, "NORMAL", ("MEDIUM", "REVIEW", "MEDIUM", True)),
        (0.3999, True, False, "NORMAL", ("LOW", "MONITOR", "LOW", False)),
        (0.50, True, False, "high", ("MEDIUM", "ESCALATE", "HIGH", True)),
        (0.20, True, False, "HIGH", ("LOW", "MONITOR", "LOW", False)),
    ],
)
def test_routing(spark, p, evidence, conflict, impact, expected):
    action = review.review_action(F.lit(p), F.lit(evidence), F.lit(conflict), F.lit(impact))
    r = one(spark.range(1).select(action.alias("r")))["r"]
    assert (r["risk_level"], r["action"], r["priority"], r["human_required"]) == expected
    assert r["risk_probability"] == p


def test_signals_of_the_demo_cases(spark):
    got = {r["transaction_id"]: r for r in rows(signals.with_signals(demo(spark)))}
    codes = {t: [s["code"] for s in r["risk_signals"]] for t, r in got.items()}
    assert codes["low"] == []
    assert codes["medium"] == ["previous_chargebacks", "previous_refunds", "amount_over_average"]
    assert len(codes["high"]) == 5
    assert [len(got[t]["mitigating_signals"]) for t in ("low", "medium", "high")] == [5, 5, 0]
    texts = {s["code"]: s["text"] for s in got["high"]["risk_signals"]}
    assert texts["amount_over_average"] == (
        "Transaction amount (₹45,000.0) exceeds customer average order value (₹300.0) by 14900.0%."
    )
    assert got["medium"]["risk_signals"][2]["value"] == "46.9"


def test_absent_columns_take_defaults(spark):
    frame = spark.createDataFrame([("t", None)], "transaction_id string, authentication_status string")
    r = one(signals.with_signals(frame))
    assert r["risk_signals"] == [] and r["mitigating_signals"] == []


def investigated(spark, with_evidence=True):
    kind = "array<struct<policy:string,score:double>>"
    hits = F.array(F.struct(F.lit("rule").alias("policy"), F.lit(0.5).alias("score"))).cast(kind)
    frame = demo(spark).withColumns(
        {
            "risk_probability": F.when(F.col("transaction_id") == "medium", 49.44).otherwise(0.2),
            "policy_evidence": hits if with_evidence else F.array().cast(kind),
        }
    )
    return report.investigate(frame)


def test_investigation(spark):
    got = {r["transaction_id"]: r for r in rows(investigated(spark))}
    medium = got["medium"]
    assert (medium["risk_probability"], medium["risk_percentage"]) == (0.4944, 49.44)
    assert medium["human_review"]["action"] == "ESCALATE"  # signals conflict
    assert medium["recommended_action"] == C.ACTION_MEDIUM  # follows the band only
    assert "(49.44% probability)" in medium["ml_signal"]
    assert medium["reasoning"][1].startswith(
        "[TRANSACTION EVIDENCE] Identified 3 risk signal(s) (Previous chargeback history exists: "
        "1 past chargeback(s) recorded., Refund history exists: 2 past refund(s)"
    )
    assert medium["reasoning"][2].startswith("[POLICY EVIDENCE] Retrieved 1 ")
    assert got["low"]["human_review"]["action"] == "MONITOR"
    assert "(None)" in got["low"]["reasoning"][1]
    missing = {r["transaction_id"]: r for r in rows(investigated(spark, with_evidence=False))}
    assert missing["low"]["human_review"]["reason"] == C.REASON_NO_EVIDENCE
    assert missing["low"]["reasoning"][2] == C.REASONING_NO_POLICIES


def test_report_document(spark):
    documents = report.report_documents(investigated(spark), FIELDS)
    found = {r["transaction_id"]: json.loads(r["report"]) for r in rows(documents)}
    r = found["high"]
    assert r["recommendation"] == r["recommended_action"]
    assert r["reasoning"] == r["investigation_reasoning"]
    assert r["policy_evidence"] == r["supporting_policy_evidence"] == [
        {"policy": "rule", "score": 0.5}
    ]
    assert r["human_review_requirement"]["defense_only"] is True
    assert r["transaction_summary"]["amount"] == 45000.0


def test_score_record_and_rejects(spark):
    frame = spark.createDataFrame(
        [("a", 0.494449, 1.0), ("b", 0.7, None)], "transaction_id string, score double, amount double"
    )
    first = rows(report.score_records(frame).orderBy("transaction_id"))[0]
    assert first == {
        "transaction_id": "a", "risk_probability": 0.4944, "risk_percentage": 49.44,
        "risk_level": "MEDIUM", "model": "Random Forest",
    }
    complete, rejected = report.reject_incomplete(frame, ["score", "amount"])
    assert [r["transaction_id"] for r in rows(complete)] == ["a"]
    assert one(rejected)["missing_fields"] == ["amount"]
