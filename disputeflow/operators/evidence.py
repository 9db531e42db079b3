"""Evidence records and claims derived from transactions and orders."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.functions.texts import numbered


def order_id(transaction_id: Column) -> Column:
    return F.concat(F.lit("ORD_"), F.replace(transaction_id, F.lit("TXN_"), F.lit("")))


def customer_reason(reason_code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain(*C.CUSTOMER_REASONS.items())])
    return F.try_element_at(pairs, reason_code)


def days_later(time: Column, days: Column) -> Column:
    return time + F.make_interval(days=days)


def evidence_records(transactions: DataFrame, orders: DataFrame) -> DataFrame:
    """Three records per transaction that has an order.

    The running number of the record follows from the number in the transaction
    id, so no global counter is needed.
    """
    joined = transactions.select("transaction_id", "authentication_status").join(
        orders.select("transaction_id", "delivery_status", "delivery_date", "refund_status"),
        "transaction_id",
    )
    delivered_on = F.date_format("delivery_date", "yyyy-MM-dd")

    def record(position: int, kind: str, content: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(kind).alias("evidence_type"),
            content.alias("content"),
        )

    records = F.array(
        record(1, "payment_authentication",
               F.format_string(C.EVIDENCE_AUTH, F.col("authentication_status"))),
        record(2, "delivery_confirmation",
               F.format_string(C.EVIDENCE_DELIVERY, F.col("delivery_status"), delivered_on)),
        record(3, "refund_record", F.format_string(C.EVIDENCE_REFUND, F.col("refund_status"))),
    )
    number = F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("bigint")
    return joined.select("transaction_id", F.inline(records)).select(
        numbered("EV_", (number - 1) * 3 + F.col("position"), 6).alias("evidence_id"),
        "transaction_id",
        "evidence_type",
        "content",
    )
