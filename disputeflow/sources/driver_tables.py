"""Canonical tables derived from the given star-schema parquet tables.

Only a fixture mapping: with real data the canonical tables are read as they are
(``scans.read_table``).  Every definition here has its twin in ``plans/oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from disputeflow import constants as C
from disputeflow.functions.texts import numbered
from disputeflow.operators.audit import reviewer_note
from disputeflow.operators.evidence import customer_reason, days_later, order_id

DISPUTED_QUANTITY = 46


# Declared, so that no job has to read footers before a plan can be built.
SCHEMAS = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pick(values: list[str], number: Column) -> Column:
    """One of a few fixed words by the remainder of a number."""
    words = F.array(*[F.lit(v) for v in values])
    return F.element_at(words, (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def transaction_id(number: Column) -> Column:
    return numbered("TXN_", number, 6)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_orders(read(spark, sf_dir, "orders"))


def from_orders(orders: DataFrame) -> DataFrame:
    """Transactions out of order rows, a table or a stream."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        transaction_id(key).alias("transaction_id"),
        numbered("CUST_", customer, 5).alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("payment_method"),
        numbered("DEV_", customer * 4 + F.pmod(key, F.lit(4)), 5).alias("device_id"),
        numbered("COUNTRY_", F.pmod(customer, F.lit(25)), 2).alias("ip_country"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_time"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias(
            "authentication_status"
        ),
        F.pmod(key, F.lit(50)).cast("int").alias("previous_transactions"),
    )


def _disputed_line() -> Column:
    return (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= DISPUTED_QUANTITY)


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chargeback per order with a disputed line; the filter reaches the scan."""
    key = F.col("key")
    claims = (
        read(spark, sf_dir, "lineitem")
        .where(_disputed_line())
        .groupBy(transaction_id(F.col("l_orderkey")).alias("transaction_id"))
        .agg(
            F.min("l_orderkey").alias("key"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("claimed"),
            F.max("l_shipdate").cast("timestamp").alias("shipped"),
        )
    )
    return claims.select(
        numbered("CB_", key, 6).alias("chargeback_id"),
        "transaction_id",
        pick(list(C.CUSTOMER_REASONS), key).alias("reason_code"),
        F.col("claimed").alias("claimed_amount"),
        days_later(F.col("shipped"), (F.pmod(key, F.lit(41)) + 5).cast("int")).alias("claim_date"),
        customer_reason(pick(list(C.CUSTOMER_REASONS), key)).alias("customer_reason"),
        numbered("STATUS_", F.pmod(key, F.lit(4)), 1).alias("status"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per transaction that has lines.

    Grouped by the id that later joins use, so those joins need no second shuffle.
    """
    key = F.col("key")
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy(transaction_id(F.col("l_orderkey")).alias("transaction_id"))
        .agg(
            F.min("l_orderkey").alias("key"),
            F.min("l_partkey").alias("part"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"),
            F.bool_and(F.col("l_linestatus") == "F").alias("delivered"),
            F.bool_or(F.col("l_returnflag") == "R").alias("refunded"),
            F.max("l_shipdate").cast("timestamp").alias("shipped"),
        )
    )
    return lines.select(
        order_id(F.col("transaction_id")).alias("order_id"),
        "transaction_id",
        numbered("CATEGORY_", F.pmod("part", F.lit(40)), 2).alias("product_category"),
        F.col("value").alias("product_value"),
        F.concat(F.lit("Address_"), key.cast("string")).alias("shipping_address"),
        F.when(F.col("delivered"), "delivered").otherwise("pending").alias("delivery_status"),
        days_later(F.col("shipped"), (F.pmod(key, F.lit(7)) + 1).cast("int")).alias(
            "delivery_date"
        ),
        F.when(F.col("refunded"), "processed").otherwise("none").alias("refund_status"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of all orders of a customer, aged to the newest order of the table.

    Plain aggregates, combined map-side: a customer owning a third of all orders
    never has its rows gathered in one task.
    """
    outcome = (
        read(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.max(_disputed_line().cast("int")).alias("disputed"))
    )
    placed = read(spark, sf_dir, "orders")
    newest = placed.agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    past = placed.join(outcome, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    device = F.pmod(F.col("o_orderkey"), F.lit(4))
    cents = F.sum((F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint"))
    profile = past.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") != "F").alias("successful"),
        F.count_if(F.col("disputed") == 1).alias("chargebacks"),
        F.count_if(F.col("disputed").isNotNull()).alias("refunds"),
        sum((F.max((device == i).cast("int")) for i in range(4)), F.lit(0)).alias("devices"),
        cents.alias("cents"),
    )
    return profile.select(
        numbered("CUST_", F.col("o_custkey"), 5).alias("customer_id"),
        F.date_diff(newest, F.col("first").cast("date")).alias(
            "account_age_days"
        ),
        F.col("n").cast("int").alias("previous_transactions"),
        F.col("successful").cast("int").alias("successful_transactions"),
        F.col("chargebacks").cast("int").alias("previous_chargebacks"),
        F.col("refunds").cast("int").alias("previous_refunds"),
        F.col("devices").cast("int").alias("known_devices"),
        # mean in whole cents, halves upwards: the same number in every engine
        (F.expr("(2 * cents + n) div (2 * n)") / 100.0).cast("double").alias(
            "average_order_value"
        ),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "transactions": transactions(spark, sf_dir),
        "customers": customers(spark, sf_dir),
        "orders": orders(spark, sf_dir),
        "chargebacks": chargebacks(spark, sf_dir),
    }


def fixture_score() -> Column:
    """A deterministic stand-in for a model score, four digits.

    The small addend keeps exact halves from being rounded either way.
    """
    capped = F.least(F.col("amount_to_avg_order_ratio") / 4, F.lit(1.0))
    score = (
        F.col("has_previous_chargeback") * 0.35
        + capped * 0.25
        + (1 - F.col("customer_success_rate")) * 0.2
        + F.col("customer_refund_rate") * 0.2
    )
    return F.round(score + 1e-9, 4)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def review_events(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """Review requests out of event rows; some carry no or little risk information.

    Event n reviews transaction n.  Which of the places a probability can come
    from is filled depends on n.
    """
    number = F.col("event_id")
    case = case_of("event_id")
    p = F.round(F.col("value") / 500 + 1e-9, 4)
    decision = (
        F.when(F.col("event_type") == "purchase", "APPROVED")
        .when(F.col("event_type") == "error", "REJECTED")
        .when(F.col("event_type") == "signup", "ESCALATED")
        .otherwise(F.col("event_type"))
    )
    asked = events.select(
        number.alias("review_id"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
        transaction_id(number).alias("transaction_id"),
        decision.alias("decision"),
        F.when(case == 0, p).otherwise(0.0).alias("risk_probability"),
        F.when(case == 1, F.round(p * 100, 2)).otherwise(0.0).alias("risk_percentage"),
        F.lit(C.UNKNOWN_LEVEL).alias("risk_level"),
        F.when(case == 0, F.lit(C.ACTION_MEDIUM)).otherwise("").alias("ai_recommendation"),
        F.when(case == 2, p).alias("inner_probability"),
        F.when(case == 0, F.array(F.lit("first reason"), F.lit("second reason")))
        .otherwise(F.array().cast("array<string>"))
        .alias("ai_reasoning"),
        F.when(
            case == 0,
            F.array(
                F.struct(F.col("event_type").alias("policy"), p.alias("score")),
                F.struct(F.lit("no score").alias("policy"), F.lit(None).cast("double").alias("score")),
            ),
        )
        .otherwise(F.array().cast("array<struct<policy:string,score:double>>"))
        .alias("policy_evidence"),
    )
    joined = asked.join(transactions.select("transaction_id", "amount"), "transaction_id", "left")
    return joined.select(
        "review_id",
        "reviewed_at",
        F.struct(
            "transaction_id",
            "amount",
            F.col("inner_probability").alias("risk_probability"),
            F.when(case_of("review_id") == 3, F.lit(C.ACTION_LOW)).alias("recommendation"),
        ).alias("transaction"),
        "decision",
        reviewer_note(F.col("decision"), F.col("transaction_id")).alias("reviewer_note"),
        "risk_probability",
        "risk_percentage",
        "risk_level",
        "ai_recommendation",
        "ai_reasoning",
        "policy_evidence",
    )


def case_of(column: str) -> Column:
    return F.pmod(F.col(column), F.lit(4))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return review_events(events, transactions(spark, sf_dir))


def score_request_fields(rows: DataFrame) -> DataFrame:
    """Feature rows reduced to the fields a scoring request carries."""
    fields = [
        "transaction_id", "amount", "payment_method", "ip_country", "authentication_status",
        "previous_transactions", "previous_chargebacks", "previous_refunds",
        "account_age_days", "successful_transactions", "known_devices",
        "average_order_value", "product_category", "delivery_status", "refund_status",
        "device_id", "transaction_day_of_week", "product_value", "transaction_hour",
        "is_weekend",
    ]
    return rows.select(*fields)



def number_of(transaction: str = "transaction_id") -> Column:
    return F.regexp_extract(transaction, r"(\d+)$", 1).cast("bigint")


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object of raw JSON values; a NULL one is left out."""
    pairs = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ", "), F.lit("}"))


def _json(rows: DataFrame, name: str) -> Column:
    value = F.col(name).cast("string")
    return F.concat(F.lit('"'), value, F.lit('"')) if rows.schema[name].dataType.typeName() == "string" else value


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def sent_score_requests(rows: DataFrame) -> DataFrame:
    """``(request_id, value)``: feature rows as the JSON of scoring requests in many forms.

    By the remainder of the id: 1 sends the amount as text, 2 a count as 5.0, 3 a flag as a
    boolean and no id, 4 a count as text; 5 to 7 are wrong in one field or more. Some are no JSON objects.
    """
    asked = score_request_fields(rows).withColumn("request_id", number_of())
    n = F.col("request_id")
    case = F.pmod(n, F.lit(8))
    raw = {c: _json(asked, c) for c in asked.columns if c != "request_id"}
    none = F.lit(None).cast("string")
    raw["transaction_id"] = F.when(case == 7, "null").when(case != 3, raw["transaction_id"])
    raw["amount"] = F.when(case == 1, F.concat(F.lit('" '), raw["amount"], F.lit(' "'))).when(case != 6, raw["amount"])
    raw["payment_method"] = F.when(case == 7, "5").otherwise(raw["payment_method"])
    raw["previous_transactions"] = F.concat(raw["previous_transactions"], F.when(case == 2, ".0").otherwise(""))
    raw["account_age_days"] = F.concat(raw["account_age_days"], F.when(case == 6, ".5").otherwise(""))
    raw["known_devices"] = (
        F.when(case == 5, '"many"').when(case == 4, _quoted(raw["known_devices"])).otherwise(raw["known_devices"])
    )
    raw["is_weekend"] = F.when(case == 3, (F.col("is_weekend") == 1).cast("string")).otherwise(raw["is_weekend"])
    raw["coupon"] = F.when(case == 0, '["unknown", "field"]').otherwise(none)
    value = F.when(n % 11 == 5, "{broken").when(n % 13 == 7, "[1, 2]").otherwise(_object(raw))
    return asked.select("request_id", value.alias("value"))


def sent_investigations(scored: DataFrame) -> DataFrame:
    """``(request_id, value)``: scored rows as the JSON of investigation requests.

    By the remainder of the id: 0 sends a whole amount, 1 the probability as text, 2 as a
    percentage; 4 to 7 are wrong: an amount as text, a transaction that is none, no query, a null
    probability. Each transaction has a key that no schema names.
    """
    rows = scored.withColumn("request_id", number_of())
    n = F.col("request_id")
    case = F.pmod(n, F.lit(8))
    names = [
        "transaction_id", "amount", "average_order_value", "previous_chargebacks", "previous_refunds", "account_age_days",
        "successful_transactions", "known_devices", "authentication_status", "delivery_status",
    ]
    raw = {c: _json(rows, c) for c in names}
    whole = F.floor("amount").cast("string")
    raw["amount"] = F.when(case == 0, whole).when(case == 4, _quoted(raw["amount"])).otherwise(raw["amount"])
    raw["is_new_customer"] = (F.col("is_new_customer") == 1).cast("string")
    raw["channel"] = F.concat(F.lit('{"code": '), (n % 5).cast("string"), F.lit(', "tags": ["a", "b"]}'))
    score = F.col("score").cast("string")
    percent = (F.col("score") * 100).cast("string")
    value = _object({
        "risk_probability": F.when(case == 1, _quoted(score)).when(case == 2, percent).when(case == 7, "null").otherwise(score),
        "query": F.when(case != 6, F.concat(F.lit('"rules for '), F.col("payment_method"), F.lit('"'))),
        "transaction": F.when(case == 5, '"none"').otherwise(_object(raw)),
    })
    return rows.select("request_id", value.alias("value"))
