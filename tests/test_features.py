from __future__ import annotations

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cases import demo
from disputeflow import constants as C
from disputeflow.functions.numbers import (
    clean_number,
    first_number,
    normalise_probability,
    percent_over,
    risk_level,
    safe_ratio,
)
from disputeflow.functions.texts import (
    decimal_text,
    first_text,
    money_text,
    numbered,
    slug,
    tokens,
    trim_space,
)
from disputeflow.operators import features

INF, NAN = float("inf"), float("nan")


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "top, bottom, guard, expected",
    [
        (1.0, 4.0, "zero", 0.25),
        (1.0, 0.0, "zero", 0.0),
        (1.0, None, "zero", 0.0),
        (None, 2.0, "zero", 0.0),
        (INF, 2.0, "zero", 0.0),
        (NAN, 2.0, "zero", 0.0),
        (1.0, -4.0, "zero", -0.25),
        (1.0, -4.0, "nonpositive", 0.0),
    ],
)
def test_safe_ratio(spark, top, bottom, guard, expected):
    column = safe_ratio(F.lit(top).cast("double"), F.lit(bottom).cast("double"), guard)
    assert evaluate(spark, column) == expected


def test_ratio_rejects_unknown_guard():
    with pytest.raises(ValueError):
        safe_ratio(F.lit(1), F.lit(1), "other")


@pytest.mark.parametrize(
    "p, level",
    [(0.70, "HIGH"), (0.6999, "MEDIUM"), (0.40, "MEDIUM"), (0.3999, "LOW"), (None, "UNKNOWN"),
     (NAN, "UNKNOWN")],
)
def test_risk_level(spark, p, level):
    assert evaluate(spark, risk_level(F.lit(p).cast("double"))) == level


@pytest.mark.parametrize(
    "value, expected",
    [(49.44, 0.4944), (250.0, 1.0), (-3.0, 0.0), (0.3, 0.3), (1.0, 1.0), (NAN, None), (None, None)],
)
def test_normalise_probability(spark, value, expected):
    got = evaluate(spark, normalise_probability(F.lit(value).cast("double")))
    assert got == (pytest.approx(expected) if expected is not None else None)


def test_small_functions(spark):
    assert evaluate(spark, clean_number(F.lit(NAN))) is None
    assert evaluate(spark, clean_number(F.lit(-INF))) is None
    assert evaluate(spark, money_text(F.lit(1249.5))) == "1,249.5"
    assert evaluate(spark, money_text(F.lit(45000))) == "45,000"
    assert evaluate(spark, decimal_text(F.lit(0.0005), 4)) == "0.0005"
    assert evaluate(spark, decimal_text(F.lit(12.0), 2)) == "12.0"
    assert evaluate(spark, first_number(F.lit(0.0), F.lit(None), F.lit(3.0))) == 3.0
    assert evaluate(spark, first_number(F.lit(0.0))) == 0.0
    assert evaluate(spark, first_text(F.lit(""), F.lit(None), F.lit("x"))) == "x"
    assert evaluate(spark, numbered("TXN_", F.lit(12), 6)) == "TXN_000012"
    assert evaluate(spark, numbered("TXN_", F.lit(12345678), 6)) == "TXN_12345678"
    assert evaluate(spark, trim_space(F.lit("\n\t a b \n"))) == "a b"
    assert slug("Random Forest") == "random_forest"
    got = evaluate(spark, tokens(F.lit("A Émile_2 isn't x-ray 7 42")))
    assert got == ["émile_2", "isn", "ray", "42"]
    assert evaluate(spark, percent_over(F.lit(1249.0), F.lit(850.0))) == 46.9
    assert evaluate(spark, percent_over(F.lit(250.0), F.lit(300.0))) is None


def test_demo_cases(spark):
    got = {r["transaction_id"]: r for r in rows(demo(spark))}
    expected = {
        "low": (0.833333, 1.0, 0.0, 0.0, 0, 0),
        "medium": (1.469412, 0.941176, 0.058824, 0.117647, 1, 0),
        "high": (150.0, 0.0, 1.0, 0.666667, 1, 1),
    }
    for name, values in expected.items():
        r = got[name]
        assert (
            round(r["amount_to_avg_order_ratio"], 6),
            round(r["customer_success_rate"], 6),
            round(r["customer_chargeback_rate"], 6),
            round(r["customer_refund_rate"], 6),
            r["has_previous_chargeback"],
            r["is_new_customer"],
        ) == values


def small_tables(spark):
    transactions = spark.createDataFrame(
        [
            ("T1", "A", 100.0, "card", "D1", "IN", "2026-03-07 13:00:00", "success", 9),
            ("T2", "A", 50.0, "upi", "D2", "US", "2026-03-09 00:30:00", "failed", 9),
            ("T3", "B", 70.0, None, "D1", "IN", "broken", "success", 9),
        ],
        "transaction_id string, customer_id string, amount double, payment_method string, "
        "device_id string, ip_country string, transaction_time string, "
        "authentication_status string, previous_transactions int",
    )
    customers = spark.createDataFrame(
        [("A", 10, 4, 3, 1, 0, 2, 25.0)],
        "customer_id string, account_age_days int, previous_transactions int, "
        "successful_transactions int, previous_chargebacks int, previous_refunds int, "
        "known_devices int, average_order_value double",
    )
    orders = spark.createDataFrame(
        [("T1", "home", 100.0, "delivered"), ("T3", "travel", 70.0, "pending")],
        "transaction_id string, product_category string, product_value double, "
        "delivery_status string",
    )
    chargebacks = spark.createDataFrame([("T2",), ("T2",)], "transaction_id string")
    return transactions, customers, orders, chargebacks


def test_feature_table(spark):
    table = features.feature_table(*small_tables(spark), "delivery_status")
    assert table.columns == ["transaction_id", "delivery_status", *C.FEATURE_COLUMNS, C.TARGET]
    got = {r["transaction_id"]: r for r in rows(table)}
    assert [got[t][C.TARGET] for t in ("T1", "T2", "T3")] == [0, 1, 0]
    assert got["T1"]["previous_transactions"] == 4  # the customer's value wins
    assert (got["T1"]["transaction_day_of_week"], got["T1"]["is_weekend"]) == (5, 1)
    assert (got["T2"]["transaction_day_of_week"], got["T2"]["is_weekend"]) == (0, 0)
    assert (got["T3"]["transaction_hour"], got["T3"]["is_weekend"]) == (None, 0)
    assert got["T3"]["amount_to_avg_order_ratio"] == 0.0
    assert got["T3"]["has_previous_chargeback"] == 0
    assert got["T2"]["product_category"] is None


def test_repeated_customers_fan_out(spark):
    transactions, customers, _, _ = small_tables(spark)
    assert features.with_customers(transactions, customers.union(customers)).count() == 5


def test_fill_missing(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, None, 0), ("b", INF, "x", 1)], "transaction_id string, v double, t string, chargeback_label int"
    )
    got = rows(features.fill_missing(frame, {"v": 9.0}).orderBy("transaction_id"))
    assert [(r["v"], r["t"]) for r in got] == [(1.0, "unknown"), (9.0, "x")]
    assert one(frame.where("chargeback_label = 1"))["v"] == INF


def test_dropped_columns(spark):
    frame = spark.createDataFrame(
        [], "order_id string, device_id string, delivery_date string, lifetime_value double, "
        "amount double, chargeback_label int, is_new boolean"
    )
    dropped = ["order_id", "device_id", "delivery_date", "lifetime_value"]
    assert features.columns_to_drop(frame) == dropped
    assert features.model_columns(frame) == ["amount", "is_new"]
    assert "device_id" in features.model_columns(frame, drop_device=False)
    assert features.numeric_columns(frame) == ["lifetime_value", "amount", "chargeback_label"]
    assert features.text_columns(frame)[-1] == "is_new"
