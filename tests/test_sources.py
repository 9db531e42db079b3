from __future__ import annotations

import json

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from disputeflow import constants as C
from disputeflow.functions.texts import money_text
from disputeflow.operators import audit, metrics, report, signals
from disputeflow.sources import coercion, requests, scans, sinks
from disputeflow.sources.coercion import Field

# The published fields of a scoring request.
REQUEST = {
    "transaction_id": "T1", "amount": 250, "payment_method": "card", "ip_country": "IN",
    "authentication_status": "success", "previous_transactions": 50,
    "previous_chargebacks": 0, "previous_refunds": 0, "account_age_days": 730,
    "successful_transactions": 50, "known_devices": 3, "average_order_value": 300,
    "product_category": "home", "delivery_status": "delivered",
    "refund_status": "none", "device_id": "d1", "transaction_day_of_week": 2,
    "product_value": 250, "transaction_hour": 11, "is_weekend": 0,
}


def texts(spark, *documents):
    data = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return spark.createDataFrame(data, "value string")


def test_score_requests(spark):
    nameless = {k: v for k, v in REQUEST.items() if k != "transaction_id"}
    partial = {k: v for k, v in REQUEST.items() if k not in ("amount", "is_weekend")}
    wrong = {**REQUEST, "known_devices": "many"}
    valid, rejected = requests.score_requests(
        texts(spark, REQUEST, nameless, partial, wrong, "{broken")
    )
    assert sorted(r["transaction_id"] for r in rows(valid)) == ["T1", C.DEFAULT_TRANSACTION_ID]
    found = sorted((r["error"], r["missing_fields"], r["malformed_fields"]) for r in rows(rejected))
    assert found == [
        ("malformed request", [], []),
        ("malformed: known_devices", [], ["known_devices"]),
        ("missing: amount, is_weekend", ["amount", "is_weekend"], []),
    ]


BAD = "bad"
FLOATS = [
    (12, 12.0), (5.5, 5.5), (1e300, 1e300), (True, 1.0), ("12.5", 12.5), (" -1_000.25 ", -1000.25), ("1e3", 1000.0),
    (".5", 0.5), ("5.", 5.0), ("Infinity", float("inf")), ("-inf", float("-inf")), ("12.5d", BAD), ("1__0", BAD), ("", BAD),
    ("many", BAD), (None, BAD), ([1], BAD), ({}, BAD),
]
INTS = [
    (12, 12), (5.0, 5), (5.5, BAD), (True, 1), (False, 0), ("7", 7), (" +7 ", 7), ("7.0", 7), ("1_000", 1000), ("7.5", BAD),
    ("7e0", BAD), ("", BAD), (None, BAD), (2**40, BAD), ("99999999999", BAD), ([], BAD),
]
TEXTS = [("a", "a"), ("", ""), (5, BAD), (True, BAD), (None, BAD), (["a"], BAD)]


@pytest.mark.parametrize("kind, cases", [("float", FLOATS), ("int", INTS), ("text", TEXTS)])
def test_coercion_of_one_field(spark, kind, cases):
    documents = [json.dumps({"n": i, "x": value}) for i, (value, _) in enumerate(cases)]
    frame = spark.createDataFrame([(d, "old") for d in [*documents, '{"n": -1}']], "value string, x string")
    got = {r["n"]: r for r in rows(coercion.coerced(frame, "value", [Field("n", "int"), Field("x", kind)]))}
    for i, (value, want) in enumerate(cases):
        assert got[i]["x"] == (None if want is BAD else want), value
        assert got[i]["malformed_fields"] == (["x"] if want is BAD else []), value
        assert got[i]["missing_fields"] == []
    assert got[-1]["missing_fields"] == ["x"] and got[-1]["malformed_fields"] == []


def test_one_wrong_field_costs_no_other(spark):
    fields = [Field("a", "float"), Field("b", "text", "default"), Field("c", "any", None), Field("d", "object", None)]
    frame = texts(spark, {"a": "x", "c": [1, "y"], "d": 5, "e": 0}, "[1]", "", "null", {"a": 1, "b": None}).unionByName(
        spark.createDataFrame([(None,)], "value string")
    )
    got = [
        (r["a"], r["b"], r["unreadable"], r["malformed_fields"])
        for r in coercion.coerced(frame, "value", fields).orderBy("unreadable", "b").collect()
    ]
    assert got == [
        (1.0, None, False, ["b"]), (None, "default", False, ["a", "d"]), *[(None, "default", True, [])] * 4
    ]


def test_coercions_are_planned_once_a_type(spark, capsys):
    def kinds(n):
        fields = [Field(f"n{i}", "int") for i in range(n)]
        coercion.coerced(texts(spark, {"n0": "1"}), "value", fields).explain("simple")
        return capsys.readouterr().out.lower().count("schemaofvariant.schemaofvariant")

    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        few, many = kinds(2), kinds(12)
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert 0 < few == many


def test_investigation_requests(spark):
    transaction = {"transaction_id": 7, "amount": 1249, "previous_chargebacks": 2.0, "authentication_status": None, "extra": {"k": [1]}}
    asked = {"risk_probability": "0.5", "query": "q", "transaction": transaction}
    frame = texts(
        spark, asked, asked | {"transaction": []}, asked | {"transaction": {"amount": "5"}}, {"query": "q"}, "{", asked | {"transaction": {}}
    ).withColumn("request_id", F.monotonically_increasing_id())
    good, rejected = requests.investigation_requests(frame)
    first, empty = sorted(rows(good), key=lambda r: r["amount"] is None)
    assert (first["transaction_id"], first["amount"], first["previous_chargebacks"]) == ("7", 1249.0, 2)
    assert first["authentication_status"] == "None" and first["risk_probability"] == 0.5
    assert json.loads(str(first["transaction"].toJson())) == transaction | {"previous_chargebacks": 2}
    assert empty["account_age_days"] is None
    assert sorted(r["error"] for r in rows(rejected)) == [
        "malformed request", "malformed: transaction", "malformed: transaction.amount", "missing: risk_probability, transaction"
    ]
    none = F.array().cast("array<struct<policy:string,score:double>>")
    reported = report.report_documents(report.investigate(good.withColumn("policy_evidence", none)))
    written = {r["transaction_id"]: json.loads(r["report"]) for r in rows(reported)}
    assert written["7"]["transaction_summary"]["extra"] == {"k": [1]}


def test_amounts_keep_the_form_they_were_sent_in(spark):
    sent = [{"amount": 91249, "average_order_value": 1000.5}, {"amount": 2345.25, "average_order_value": 7}]
    asked = [{"risk_probability": 0.5, "query": "q", "transaction": t} for t in sent]
    good, _ = requests.investigation_requests(texts(spark, *asked))
    shown = sorted(r["t"] for r in rows(good.select(F.explode(signals.signal_texts(signals.risk_signals(good))).alias("t"))))
    assert "91,249)" in shown[1] and "1,000.5)" in shown[1] and "2,345.25)" in shown[0] and "7)" in shown[0]
    table = spark.sql("SELECT 5000D AS a, 1234567.891D AS b, 0.1D AS c")
    assert list(one(table.select(*(money_text(F.col(c)).alias(c) for c in "abc"))).values()) == ["5,000.0", "1,234,567.891", "0.1"]


def test_review_requests_take_defaults(spark):
    text = texts(spark, {"transaction": {"transaction_id": "T1", "risk_probability": 0.9},
                         "decision": "ESCALATED"}).withColumn("request_id", F.lit("r1"))
    good, rejected = requests.review_requests(text)
    r = one(good)
    assert (r["risk_level"], r["risk_probability"], r["reviewer_note"]) == ("UNKNOWN", 0.0, "")
    assert json.loads(r["transaction"].toJson())["risk_probability"] == 0.9
    assert r["reviewed_at"] is not None and r["ai_reasoning"] == ""
    assert rows(rejected) == []


def test_equal_review_decisions_stay_apart(spark):
    said = {"transaction": {"transaction_id": "T"}, "decision": "APPROVED"}
    text = texts(spark, said | {"ai_reasoning": "plain"}, said | {"ai_reasoning": ["a", "b"]}).withColumn(
        "request_id", F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))
    )
    good, _ = requests.review_requests(text)
    kept = rows(audit.history(audit.audit_records(good)))
    assert sorted(r["ai_reasoning"] for r in kept) == ["a\nb", "plain"]
    assert all(r["timestamp"] is not None for r in kept)


def test_review_rejects(spark):
    text = spark.createDataFrame(
        [("{x", "1"), ('{"decision": "APPROVED", "transaction": {}}', None), ('{"transaction": {}}', "2")],
        "value string, request_id string",
    )
    good, rejected = requests.review_requests(text)
    assert rows(good) == []
    assert sorted(r["error"] for r in rows(rejected)) == [
        "malformed request", "missing: decision", "request has no identity"
    ]


def test_csv_tables(spark, tmp_path):
    path = str(tmp_path / "customers")
    frame = spark.createDataFrame(
        [("CUST_00001", 30, 5, 4, 0, 1, 2, 10.5)],
        "customer_id string, account_age_days int, previous_transactions int, "
        "successful_transactions int, previous_chargebacks int, previous_refunds int, "
        "known_devices int, average_order_value double",
    )
    sinks.write_table(frame, path, "csv")
    assert rows(scans.read_table(spark, path, "customers")) == rows(frame)


def test_model_table_needs_its_target(spark, tmp_path):
    path = str(tmp_path / "model")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(ValueError, match="chargeback_label.*available.*id"):
        scans.read_model_table(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.read_model_table(spark, str(tmp_path / "absent"))


def test_csv_model_table_is_not_inferred(spark, tmp_path):
    path = str(tmp_path / "model")
    frame = spark.createDataFrame(
        [("T1", 5.0, "007", 1, "12")], "transaction_id string, amount double, payment_method string, chargeback_label int, extra string"
    ).select("chargeback_label", "extra", "payment_method", "amount", "transaction_id")
    sinks.write_table(frame, path, "csv")
    back = scans.read_model_table(spark, path, "csv")
    assert back.dtypes == frame.dtypes and rows(back) == rows(frame)


def test_results_tables(spark, tmp_path):
    results = spark.createDataFrame(
        [("Random Forest", 0.5960, 0.0996, 0.3140, 0.1513, 0),
         ("Logistic Regression", 0.7600, 0.1083, 0.1512, 0.1262, 1)],
        "model string, accuracy double, precision double, recall double, f1 double, position int",
    )
    path = str(tmp_path / "results")
    sinks.write_results(metrics.rank_models(results).drop("position"), path)
    back = scans.read_results(spark, path)
    assert [r["model"] for r in rows(back)] == ["Random Forest", "Logistic Regression"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scans.read_results(spark, str(tmp_path / "absent")).collect()


def test_text_and_document(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("One\n\nTwo é\n", encoding="utf-8")
    r = one(scans.read_text_document(spark, str(tmp_path / "rules.txt")))
    assert r["text"] == "One\n\nTwo é\n" and r["path"].endswith("rules.txt")
    path = str(tmp_path / "document")
    sinks.write_document(spark.sql("SELECT named_struct('a', array(1, 2)) AS metadata"), path)
    assert one(spark.read.json(path)) == {"metadata": {"a": [1, 2]}}
