"""Risk and mitigating signals of a transaction as ordered arrays.

Each signal is a struct (code, value, text); absent columns take the published
defaults, which differ between the two lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import percent_over
from disputeflow.functions.texts import money_text
from disputeflow.functions.variants import kind_of, part

NO_AGE = 999


def _column(rows: DataFrame, name: str, default) -> Column:
    if name not in rows.columns:
        return F.lit(default)
    return F.coalesce(F.col(name), F.lit(default))


def _money(rows: DataFrame, name: str, amount: Column) -> Column:
    """An amount as text; one that a request sent as a whole number has no fraction."""
    if "transaction" in rows.columns and rows.schema["transaction"].dataType.typeName() == "variant":
        sent = part(F.col("transaction"), name)
        return money_text(amount, F.coalesce(kind_of(sent) == "BIGINT", F.lit(False)))
    return money_text(amount)


def _signal(condition: Column, code: str, value: Column, text: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"), text.alias("text")),
    )


def _counted(condition: Column, code: str, value: Column, sentence: str) -> Column:
    return _signal(condition, code, value, F.format_string(sentence, value.cast("string")))


def risk_signals(rows: DataFrame) -> Column:
    chargebacks = _column(rows, "previous_chargebacks", 0)
    refunds = _column(rows, "previous_refunds", 0)
    amount = _column(rows, "amount", 0.0)
    average = _column(rows, "average_order_value", 0.0)
    age = _column(rows, "account_age_days", NO_AGE)
    new = _column(rows, "is_new_customer", 0)
    auth = F.lower(_column(rows, "authentication_status", ""))
    over = percent_over(amount, average)
    over_text = F.format_string("%.1f", over)
    return F.array_compact(
        F.array(
            _counted(chargebacks > 0, "previous_chargebacks", chargebacks, C.SIGNAL_CHARGEBACKS),
            _counted(refunds > 0, "previous_refunds", refunds, C.SIGNAL_REFUNDS),
            _signal(
                over.isNotNull(),
                "amount_over_average",
                over_text,
                F.format_string(
                    C.SIGNAL_AMOUNT, _money(rows, "amount", amount),
                    _money(rows, "average_order_value", average), over_text,
                ),
            ),
            _counted(
                (age < C.NEW_CUSTOMER_DAYS) | (new == 1), "new_account", age, C.SIGNAL_NEW_ACCOUNT
            ),
            _signal(
                (auth != "") & (auth != "success"),
                "authentication_not_successful",
                auth,
                F.lit(C.SIGNAL_AUTH_FAILED),
            ),
        )
    )


def mitigating_signals(rows: DataFrame) -> Column:
    auth = F.lower(_column(rows, "authentication_status", ""))
    delivery = F.lower(_column(rows, "delivery_status", ""))
    age = _column(rows, "account_age_days", 0)
    successful = _column(rows, "successful_transactions", 0)
    devices = _column(rows, "known_devices", 0)
    return F.array_compact(
        F.array(
            _signal(auth == "success", "authentication_successful", auth, F.lit(C.SIGNAL_AUTH_OK)),
            _signal(delivery == "delivered", "delivered", delivery, F.lit(C.SIGNAL_DELIVERED)),
            _counted(age >= C.ESTABLISHED_DAYS, "established_account", age, C.SIGNAL_ESTABLISHED),
            _counted(
                successful > 0, "successful_transactions", successful, C.SIGNAL_SUCCESSFUL
            ),
            _counted(devices > 1, "known_devices", devices, C.SIGNAL_DEVICES),
        )
    )


def signal_texts(signals: Column) -> Column:
    return F.transform(signals, lambda s: s["text"])


def signal_codes(signals: Column) -> Column:
    return F.transform(signals, lambda s: s["code"])


def with_signals(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"risk_signals": risk_signals(rows), "mitigating_signals": mitigating_signals(rows)}
    )
