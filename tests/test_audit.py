from __future__ import annotations

from datetime import datetime

import pytest
from conftest import one, rows
from pyspark.sql import Row, functions as F

from disputeflow import constants as C
from disputeflow.operators import audit, evidence
from disputeflow.sources import schemas
from disputeflow.sources.audit_store import AuditStore

BASE = {
    "review_id": 1,
    "reviewed_at": datetime(2026, 3, 1, 10, 0, 0, 900),
    "transaction": {"transaction_id": "T1", "amount": 20.0},
    "decision": "APPROVED",
    "reviewer_note": "fine",
    "risk_probability": 0.0,
    "risk_percentage": 0.0,
    "risk_level": "UNKNOWN",
    "ai_recommendation": "",
    "ai_reasoning": [],
    "policy_evidence": [],
}


def requests(spark, *changes):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("""
        review_id bigint, reviewed_at timestamp, transaction struct<transaction_id:string,amount:double,
        risk_probability:double,risk_percentage:double,risk_level:string,ai_recommendation:string,
        recommendation:string,ai_reasoning:string,reasoning:string,policy_evidence:string>,
        decision string, reviewer_note string, risk_probability double, risk_percentage double,
        risk_level string, ai_recommendation string, ai_reasoning array<string>,
        policy_evidence array<struct<policy:string,score:double>>
    """)
    inner = schema["transaction"].dataType.names
    data = []
    for i, change in enumerate(changes):
        row = {**BASE, "review_id": i, **change}
        row["transaction"] = tuple(row["transaction"].get(n) for n in inner)
        row["policy_evidence"] = [(p, s) for p, s in row["policy_evidence"]]
        data.append(tuple(row[n] for n in schema.names))
    return spark.createDataFrame(data, schema)


def record(spark, **change):
    return one(audit.audit_records(requests(spark, change)))


def test_only_allowed_decisions(spark):
    frame = requests(spark, {}, {"decision": "APPROVE"}, {"decision": None}, {"decision": "REJECTED"})
    accepted, rejected = audit.split_by_decision(frame)
    assert sorted(r["review_id"] for r in rows(accepted)) == [0, 3]
    assert sorted(r["review_id"] for r in rows(rejected)) == [1, 2]


def test_resolved_risk(spark):
    r = record(spark, risk_percentage=58.0)
    assert (r["risk_probability"], r["risk_level"]) == (0.58, "MEDIUM")
    r = record(spark, transaction={"transaction_id": "T", "risk_probability": 0.9})
    assert (r["risk_probability"], r["risk_percentage"], r["risk_level"]) == (0.9, 90.0, "HIGH")
    r = record(spark)
    assert (r["risk_probability"], r["risk_percentage"], r["risk_level"]) == (0.0, 0.0, "UNKNOWN")
    r = record(spark, risk_level="LOW", risk_probability=0.9)
    assert r["risk_level"] == "LOW"
    r = record(spark, transaction={"risk_level": "HIGH"}, risk_probability=0.1)
    assert (r["risk_level"], r["transaction_id"]) == ("HIGH", C.DEFAULT_TRANSACTION_ID)


def test_texts(spark):
    r = record(spark)
    assert r["ai_recommendation"] == C.DEFAULT_RECOMMENDATION
    assert r["ai_reasoning"] == C.DEFAULT_REASONING
    assert r["policy_evidence"] == ""
    r = record(
        spark,
        ai_reasoning=["one", "two"],
        policy_evidence=[("P1", 0.66), ("P2", None), ("P3", 0.0005)],
        transaction={"recommendation": "wait"},
    )
    assert r["ai_reasoning"] == "one\ntwo"
    assert r["policy_evidence"] == "P1 (Relevance: 0.66)\n\nP2\n\nP3 (Relevance: 0.0005)"
    assert (r["ai_recommendation"], r["amount"]) == ("wait", 0.0)
    assert r["timestamp"] == datetime(2026, 3, 1, 10, 0, 0)


def test_history_and_display(spark, tmp_path):
    frame = requests(spark, {}, {"risk_probability": 0.45}, {"transaction": {"transaction_id": ""}})
    records = audit.audit_records(frame)
    store = AuditStore(spark, str(tmp_path / "audit")).declare()
    assert store.append(records, 0) == 3
    assert store.append(records.where("id = 1"), 1) == 1  # a request sent again
    stored = store.read()
    assert stored.count() == 4
    assert [r["id"] for r in rows(audit.history(stored))] == [2, 1, 0]
    shown = {r["id"]: r for r in rows(audit.display(audit.history(stored)))}
    assert (shown[1]["risk_score"], shown[1]["risk_level"]) == ("45.00%", "MEDIUM")
    assert (shown[0]["risk_score"], shown[0]["risk_level"]) == ("0.00%", "LOW")
    assert shown[2]["transaction_id"] == "N/A"
    done = [r for r in rows(audit.acknowledgements(records)) if r["audit_record"]["id"] == 1]
    assert done[0]["message"] == "Human review successfully recorded as APPROVED."


def test_audit_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    records = audit.audit_records(requests(spark, {}, {}, {})).persist()
    store = AuditStore(spark, folder).declare()
    assert store.read().columns == audit.AUDIT_COLUMNS and store.read().count() == 0
    assert store.append(records, "a-1") == 3 and store.append(records, "a-1") == 0  # replayed
    store._write(records.withColumn("review_date", F.to_date("timestamp")), "b")  # failed before its commit
    assert AuditStore(spark, folder).declare().read().count() == 3
    assert store.append(records.limit(2), "b") == 2
    assert {r["batch"]: r["n_rows"] for r in store.batches().collect()} == {"a-1": 3, "b": 2}
    assert store.read().count() == 5


def test_audit_store_refuses_nulls(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path / "store")).declare()
    records = audit.audit_records(requests(spark, {}, {}))
    broken = records.withColumn("timestamp", F.when(F.col("id") == 0, F.col("timestamp")))
    with pytest.raises(Exception, match="NULL in the audit column timestamp"):
        store.append(broken, 1)
    assert store.read().count() == 0 and store.batches().count() == 0
    assert store.append(records.withColumn("amount", F.lit(None).cast("double")), 1) == 2
    for name in ("declared", "", "a/b"):
        with pytest.raises(ValueError):
            store.append(records, name)


def test_audit_store_keeps_its_declaration(spark, tmp_path, monkeypatch):
    AuditStore(spark, str(tmp_path / "store")).declare()
    monkeypatch.setattr(schemas, "AUDIT", "audit_key string NOT NULL")
    with pytest.raises(ValueError, match="was declared as"):
        AuditStore(spark, str(tmp_path / "store")).declare()


def test_evidence(spark):
    transactions = spark.createDataFrame(
        [Row(transaction_id="TXN_000002", authentication_status="failed"),
         Row(transaction_id="TXN_000003", authentication_status="success")]
    )
    orders = spark.createDataFrame(
        [("TXN_000002", "pending", datetime(2026, 1, 5), "none")],
        "transaction_id string, delivery_status string, delivery_date timestamp, "
        "refund_status string",
    )
    got = [(r["evidence_id"], r["content"]) for r in rows(
        evidence.evidence_records(transactions, orders).orderBy("evidence_id"))]
    assert got == [
        ("EV_000004", "Payment authentication status was failed."),
        ("EV_000005", "Order delivery status: pending. Delivery date: 2026-01-05."),
        ("EV_000006", "Refund status: none."),
    ]
    named = transactions.select(evidence.order_id(transactions.transaction_id).alias("o"))
    assert {r["o"] for r in rows(named)} == {"ORD_000002", "ORD_000003"}
