"""Published demonstration inputs: a low, a medium and a high risk transaction."""

FIELDS = [
    "transaction_id", "amount", "average_order_value", "previous_transactions",
    "successful_transactions", "previous_chargebacks", "previous_refunds",
    "account_age_days", "known_devices", "authentication_status", "delivery_status",
]
CASES = [
    ("low", 250.0, 300.0, 50, 50, 0, 0, 730, 3, "success", "delivered"),
    ("medium", 1249.0, 850.0, 17, 16, 1, 2, 420, 2, "success", "delivered"),
    ("high", 45000.0, 300.0, 3, 0, 3, 2, 2, 1, "failed", "pending"),
]


def demo(spark):
    from disputeflow.operators.features import derive_features

    kinds = ["string", "double", "double"] + ["int"] * 6 + ["string", "string"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(FIELDS, kinds))
    return derive_features(spark.createDataFrame(CASES, schema), "nonpositive")
