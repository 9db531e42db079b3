"""Declared schemas of the canonical tables, requests and the audit table."""

from __future__ import annotations

CUSTOMERS = """
    customer_id string, account_age_days int, previous_transactions int,
    successful_transactions int, previous_chargebacks int, previous_refunds int,
    known_devices int, average_order_value double
"""
TRANSACTIONS = """
    transaction_id string, customer_id string, amount double, payment_method string,
    device_id string, ip_country string, transaction_time string,
    authentication_status string, previous_transactions int
"""
ORDERS = """
    order_id string, transaction_id string, product_category string,
    product_value double, shipping_address string, delivery_status string,
    delivery_date timestamp, refund_status string
"""
CHARGEBACKS = """
    chargeback_id string, transaction_id string, reason_code string,
    claimed_amount double, claim_date timestamp, customer_reason string, status string
"""
EVIDENCE = "evidence_id string, transaction_id string, evidence_type string, content string"
TABLES = {
    "customers": CUSTOMERS,
    "transactions": TRANSACTIONS,
    "orders": ORDERS,
    "chargebacks": CHARGEBACKS,
    "evidence": EVIDENCE,
}

MODEL_TABLE = """
    transaction_id string, amount double, payment_method string, device_id string, ip_country string,
    authentication_status string, account_age_days int, previous_transactions int,
    successful_transactions int, previous_chargebacks int, previous_refunds int, known_devices int,
    average_order_value double, product_category string, product_value double, transaction_hour int,
    transaction_day_of_week int, is_weekend int, amount_to_avg_order_ratio double,
    customer_success_rate double, customer_chargeback_rate double, customer_refund_rate double,
    has_previous_chargeback int, is_new_customer int, chargeback_label int
"""
MODEL_RESULTS = "model string, accuracy double, precision double, recall double, f1 double"
THRESHOLD_RESULTS = """
    threshold double, accuracy double, precision double, recall double, f1 double,
    true_negative bigint, false_positive bigint, false_negative bigint,
    true_positive bigint, estimated_cost double
"""

# transaction_id has a default; every other field is required.
SCORE_REQUEST = """
    transaction_id string, amount double, payment_method string, ip_country string,
    authentication_status string, previous_transactions int, previous_chargebacks int,
    previous_refunds int, account_age_days int, successful_transactions int,
    known_devices int, average_order_value double, product_category string,
    delivery_status string, refund_status string, device_id string,
    transaction_day_of_week int, product_value double, transaction_hour int,
    is_weekend int
"""
AUDIT = """
    audit_key string NOT NULL, id bigint, transaction_id string NOT NULL, amount double,
    risk_probability double, risk_percentage double, risk_level string,
    ai_recommendation string, ai_reasoning string, policy_evidence string,
    human_decision string, reviewer_note string, timestamp timestamp NOT NULL
"""
