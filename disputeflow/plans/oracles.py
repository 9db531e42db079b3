"""DuckDB twins of the registered queries, on the same given tables.

``CTES`` names the shared definitions, in the order they build on each other.
"""

from __future__ import annotations

import re

from disputeflow import constants as C


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(values: list[str], number: str) -> str:
    listed = ", ".join(_text(v) for v in values)
    return f"([{listed}])[CAST(({number}) % {len(values)} + 1 AS BIGINT)]"


def _sentence(template: str, *values: str) -> str:
    """A sentence format as an SQL concatenation; NULL if any value is."""
    parts = template.replace("%%", "\x00").split("%s")
    out = []
    for i, part in enumerate(parts):
        if part:
            out.append(_text(part.replace("\x00", "%")))
        if i < len(values):
            out.append(f"CAST({values[i]} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"


def _ratio(top: str, bottom: str, test: str = "<> 0") -> str:
    quotient = f"CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE)"
    return f"CASE WHEN {bottom} {test} THEN coalesce({quotient}, 0.0) ELSE 0.0 END"


def _money(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS DOUBLE))"


def _digits(x: str, digits: int) -> str:
    return f"regexp_replace(printf('%.{digits}f', {x}), '(\\.\\d+?)0+$', '\\1')"


def _band(p: str) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN 'UNKNOWN' WHEN {p} >= {C.HIGH_RISK} THEN 'HIGH' "
        f"WHEN {p} >= {C.MEDIUM_RISK} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def _share(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 0.0)"


NUMERIC = [
    c for c in C.FEATURE_COLUMNS
    if c not in ("payment_method", "device_id", "ip_country", "authentication_status",
                 "product_category")
]
TEXTS = [c for c in C.FEATURE_COLUMNS if c not in NUMERIC]
DISPUTED = "l_returnflag = 'R' AND l_quantity >= 46"
OVER = (
    "CASE WHEN amount > 0 AND average_order_value > 0 AND amount > average_order_value "
    "THEN round((amount - average_order_value) / average_order_value * 100, 1) END"
)
OVER_TEXT = f"printf('%.1f', {OVER})"

RISK_SIGNALS = [
    ("previous_chargebacks", "coalesce(previous_chargebacks, 0) > 0",
     _sentence(C.SIGNAL_CHARGEBACKS, "previous_chargebacks")),
    ("previous_refunds", "coalesce(previous_refunds, 0) > 0",
     _sentence(C.SIGNAL_REFUNDS, "previous_refunds")),
    ("amount_over_average", f"({OVER}) IS NOT NULL",
     _sentence(C.SIGNAL_AMOUNT, _money("amount"), _money("average_order_value"), OVER_TEXT)),
    ("new_account", "coalesce(account_age_days, 999) < 30 OR is_new_customer = 1",
     _sentence(C.SIGNAL_NEW_ACCOUNT, "coalesce(account_age_days, 999)")),
    ("authentication_not_successful",
     "coalesce(authentication_status, '') NOT IN ('', 'success')", _text(C.SIGNAL_AUTH_FAILED)),
]
MITIGATING_SIGNALS = [
    ("authentication_successful", "authentication_status = 'success'", _text(C.SIGNAL_AUTH_OK)),
    ("delivered", "delivery_status = 'delivered'", _text(C.SIGNAL_DELIVERED)),
    ("established_account", "coalesce(account_age_days, 0) >= 90",
     _sentence(C.SIGNAL_ESTABLISHED, "account_age_days")),
    ("successful_transactions", "coalesce(successful_transactions, 0) > 0",
     _sentence(C.SIGNAL_SUCCESSFUL, "successful_transactions")),
    ("known_devices", "coalesce(known_devices, 0) > 1",
     _sentence(C.SIGNAL_DEVICES, "known_devices")),
]


def _signal_list(found: list[tuple[str, str, str]], part: int) -> str:
    cases = ", ".join(
        f"CASE WHEN {rule} THEN {_text(code) if part == 0 else sentence} END"
        for code, rule, sentence in found
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _first_two(signals: str) -> str:
    return (
        f"CASE WHEN len({signals}) > 0 THEN array_to_string(list_slice({signals}, 1, 2), ', ') "
        f"ELSE '{C.NO_SIGNALS}' END"
    )


def _routing(evidence: str, conflict: str, impact: str, part: str) -> str:
    """One column of the routing decision."""
    values = {
        "action": ["ESCALATE", "ESCALATE", "ESCALATE", "ESCALATE", "REVIEW", "MONITOR"],
        "priority": ["HIGH", "HIGH", "HIGH", "HIGH", "MEDIUM", "LOW"],
        "reason": [C.REASON_NO_EVIDENCE, C.REASON_CONFLICT, C.REASON_HIGH,
                   C.REASON_MEDIUM_IMPACT, C.REASON_MEDIUM, C.REASON_LOW],
        "human_required": ["true", "true", "true", "true", "true", "false"],
    }[part]
    quoted = values if part == "human_required" else [_text(v) for v in values]
    tests = [
        f"NOT ({evidence})", conflict, f"score >= {C.HIGH_RISK}",
        f"score >= {C.MEDIUM_RISK} AND {impact}", f"score >= {C.MEDIUM_RISK}",
    ]
    whens = " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, quoted))
    return f"CASE {whens} ELSE {quoted[-1]} END"


CTES: dict[str, str] = {
    "transactions": f"""
        SELECT printf('TXN_%06d', o_orderkey) AS transaction_id,
               printf('CUST_%05d', o_custkey) AS customer_id,
               o_orderkey AS number,
               o_totalprice AS amount,
               o_orderpriority AS payment_method,
               printf('DEV_%05d', o_custkey * 4 + o_orderkey % 4) AS device_id,
               printf('COUNTRY_%02d', o_custkey % 25) AS ip_country,
               o_orderdate AS transaction_time,
               CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END
                   AS authentication_status
        FROM orders""",
    "line_facts": f"""
        SELECT l_orderkey, min(l_partkey) AS part,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS product_value,
               CAST(sum(CASE WHEN {DISPUTED} THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END)
                   AS DOUBLE) AS claimed_amount,
               bool_and(l_linestatus = 'F') AS delivered,
               bool_or(l_returnflag = 'R') AS refunded,
               bool_or({DISPUTED}) AS disputed,
               max(l_shipdate) AS shipped,
               max(CASE WHEN {DISPUTED} THEN l_shipdate END) AS disputed_shipped
        FROM lineitem GROUP BY l_orderkey""",
    "canonical_orders": f"""
        SELECT printf('ORD_%06d', l_orderkey) AS order_id,
               printf('TXN_%06d', l_orderkey) AS transaction_id,
               printf('CATEGORY_%02d', part % 40) AS product_category,
               product_value,
               'Address_' || CAST(l_orderkey AS VARCHAR) AS shipping_address,
               CASE WHEN delivered THEN 'delivered' ELSE 'pending' END AS delivery_status,
               strftime(shipped + to_days(CAST(l_orderkey % 7 + 1 AS INTEGER)), '%Y-%m-%d')
                   AS delivery_date,
               CASE WHEN refunded THEN 'processed' ELSE 'none' END AS refund_status
        FROM line_facts""",
    "chargebacks": f"""
        SELECT printf('CB_%06d', l_orderkey) AS chargeback_id,
               printf('TXN_%06d', l_orderkey) AS transaction_id,
               {_pick(list(C.CUSTOMER_REASONS), 'l_orderkey')} AS reason_code,
               claimed_amount,
               strftime(disputed_shipped + to_days(CAST(l_orderkey % 41 + 5 AS INTEGER)),
                        '%Y-%m-%d') AS claim_date,
               {_pick(list(C.CUSTOMER_REASONS.values()), 'l_orderkey')} AS customer_reason,
               printf('STATUS_%d', l_orderkey % 4) AS status
        FROM line_facts WHERE disputed""",
    "customers": """
        SELECT printf('CUST_%05d', o_custkey) AS customer_id,
               CAST(date_diff('day', CAST(min(o_orderdate) AS DATE),
                              CAST((SELECT max(o_orderdate) FROM orders) AS DATE))
                   AS INTEGER) AS account_age_days,
               CAST(count(*) AS INTEGER) AS previous_transactions,
               CAST(count(*) FILTER (o_orderstatus <> 'F') AS INTEGER)
                   AS successful_transactions,
               CAST(count(*) FILTER (disputed) AS INTEGER) AS previous_chargebacks,
               CAST(count(*) FILTER (refunded) AS INTEGER) AS previous_refunds,
               CAST(count(DISTINCT o_orderkey % 4) AS INTEGER) AS known_devices,
               CAST((2 * CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2)) * 100) AS BIGINT)
                     + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS average_order_value
        FROM orders LEFT JOIN line_facts ON o_orderkey = l_orderkey
        GROUP BY o_custkey""",
    "joined": """
        SELECT t.*, c.account_age_days, c.previous_transactions, c.successful_transactions,
               c.previous_chargebacks, c.previous_refunds, c.known_devices,
               c.average_order_value, o.product_category, o.product_value,
               o.delivery_status, o.refund_status,
               CAST(b.transaction_id IS NOT NULL AS INTEGER) AS chargeback_label
        FROM transactions t
        LEFT JOIN customers c USING (customer_id)
        LEFT JOIN canonical_orders o USING (transaction_id)
        LEFT JOIN chargebacks b USING (transaction_id)""",
    "features": f"""
        SELECT *, CAST(extract(hour FROM transaction_time) AS INTEGER) AS transaction_hour,
               CAST(isodow(transaction_time) - 1 AS INTEGER) AS transaction_day_of_week,
               CAST(isodow(transaction_time) >= 6 AS INTEGER) AS is_weekend,
               {_ratio('amount', 'average_order_value')} AS amount_to_avg_order_ratio,
               {_ratio('successful_transactions', 'previous_transactions')}
                   AS customer_success_rate,
               {_ratio('previous_chargebacks', 'previous_transactions')}
                   AS customer_chargeback_rate,
               {_ratio('previous_refunds', 'previous_transactions')} AS customer_refund_rate,
               CAST(coalesce(previous_chargebacks > 0, false) AS INTEGER)
                   AS has_previous_chargeback,
               CAST(coalesce(account_age_days < 30, false) AS INTEGER) AS is_new_customer
        FROM joined""",
    "scored": """
        SELECT *, round(has_previous_chargeback * CAST(0.35 AS DOUBLE)
                        + least(amount_to_avg_order_ratio / 4, 1.0) * CAST(0.25 AS DOUBLE)
                        + (1 - customer_success_rate) * CAST(0.2 AS DOUBLE)
                        + customer_refund_rate * CAST(0.2 AS DOUBLE) + 1e-9, 4) AS score
        FROM features""",
    "models": f"""
        SELECT transaction_id, amount, chargeback_label, '{C.LOGISTIC_REGRESSION}' AS model,
               0 AS position, score AS model_score FROM scored
        UNION ALL
        SELECT transaction_id, amount, chargeback_label, '{C.RANDOM_FOREST}', 1,
               round(least(score * 2, 1.0) + 1e-9, 4) FROM scored
        UNION ALL
        SELECT transaction_id, amount, chargeback_label, '{C.BOOSTED_TREES}', 2,
               round(customer_refund_rate * CAST(0.9 AS DOUBLE) + 1e-9, 4) FROM scored""",
    "model_counts": """
        SELECT model, position,
               count(*) FILTER (chargeback_label = 0 AND model_score < 0.5) AS true_negative,
               count(*) FILTER (chargeback_label = 0 AND model_score >= 0.5) AS false_positive,
               count(*) FILTER (chargeback_label = 1 AND model_score < 0.5) AS false_negative,
               count(*) FILTER (chargeback_label = 1 AND model_score >= 0.5) AS true_positive,
               coalesce(CAST(sum(CASE WHEN chargeback_label = 0 AND model_score >= 0.5
                   THEN CAST(amount AS DECIMAL(18, 2)) END) AS DOUBLE), 0.0) AS fp_amount
        FROM models GROUP BY model, position""",
    "model_auc": """
        SELECT model, sum(pos * (2 * earlier + neg))
                      / (2.0 * sum(pos) * sum(neg)) AS roc_auc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY model_score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
              FROM (SELECT model, model_score,
                           CAST(sum(chargeback_label) AS DOUBLE) AS pos,
                           CAST(sum(1 - chargeback_label) AS DOUBLE) AS neg
                    FROM models GROUP BY model, model_score))
        GROUP BY model""",
    "model_quality": f"""
        SELECT model, position, true_negative, false_positive, false_negative, true_positive,
               round({_share('true_positive + true_negative',
                             '(true_negative + false_positive + false_negative + true_positive)')},
                     4) AS accuracy,
               round({_share('true_positive', '(true_positive + false_positive)')}, 4)
                   AS precision,
               round({_share('true_positive', '(true_positive + false_negative)')}, 4) AS recall,
               round({_share('2 * true_positive',
                             '(2 * true_positive + false_positive + false_negative)')}, 4) AS f1,
               CAST(false_positive * 500 + false_negative * 10000 AS DOUBLE) AS estimated_cost,
               fp_amount, round(roc_auc, 4) AS roc_auc,
               CAST(false_positive * 500 AS DOUBLE) AS fp_cost,
               CAST(false_negative * 10000 AS DOUBLE) AS fn_cost
        FROM model_counts JOIN model_auc USING (model)""",
    "sweep": f"""
        SELECT threshold, true_negative, false_positive, false_negative, true_positive,
               round({_share('true_positive + true_negative',
                             '(true_negative + false_positive + false_negative + true_positive)')},
                     6) AS accuracy,
               round({_share('true_positive', '(true_positive + false_positive)')}, 6)
                   AS precision,
               round({_share('true_positive', '(true_positive + false_negative)')}, 6) AS recall,
               round({_share('2 * true_positive',
                             '(2 * true_positive + false_positive + false_negative)')}, 6) AS f1,
               false_positive * 500 + false_negative * 10000 AS estimated_cost
        FROM (SELECT threshold,
                     count(*) FILTER (chargeback_label = 0 AND score < threshold)
                         AS true_negative,
                     count(*) FILTER (chargeback_label = 0 AND score >= threshold)
                         AS false_positive,
                     count(*) FILTER (chargeback_label = 1 AND score < threshold)
                         AS false_negative,
                     count(*) FILTER (chargeback_label = 1 AND score >= threshold)
                         AS true_positive
              FROM scored, (SELECT CAST(unnest({C.THRESHOLDS}) AS DOUBLE) AS threshold)
              GROUP BY threshold)""",
    "signals": f"""
        SELECT *, {_signal_list(RISK_SIGNALS, 0)} AS risk_codes,
               {_signal_list(RISK_SIGNALS, 1)} AS risk_texts,
               {_signal_list(MITIGATING_SIGNALS, 0)} AS mitigating_codes,
               {_signal_list(MITIGATING_SIGNALS, 1)} AS mitigating_texts
        FROM scored""",
    "sent_scores": """
        SELECT *, number % 8 AS kind, number % 11 = 5 OR number % 13 = 7 AS broken FROM features""",
    "sent_investigations": f"""
        SELECT * REPLACE (CASE WHEN kind = 0 THEN floor(amount) ELSE amount END AS amount),
               CASE WHEN kind = 0 THEN format('{{:,}}', CAST(floor(amount) AS BIGINT))
                    ELSE {_money('amount')} END AS amount_text
        FROM (SELECT * REPLACE (CASE WHEN number % 8 <> 2 THEN score WHEN score * 100 > 1 THEN (score * 100) / 100
                                ELSE score * 100 END AS score),
                     number % 8 AS kind FROM scored)""",
    "investigated": f"""
        SELECT *, {_signal_list(RISK_SIGNALS, 1).replace(_money("amount"), "amount_text")} AS risk_texts,
               {_signal_list(MITIGATING_SIGNALS, 1)} AS mitigating_texts
        FROM sent_investigations WHERE kind < 4""",
    "doc_terms": """
        SELECT chunk_id, term, count(*) AS tf FROM (
            SELECT doc_id AS chunk_id,
                   unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)) AS term
            FROM documents)
        WHERE term NOT IN (STOP_WORDS) GROUP BY chunk_id, term""",
    "vocabulary": """
        SELECT term, count(*) AS df,
               ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
        FROM doc_terms GROUP BY term""",
    "doc_weights": """
        SELECT chunk_id, term, tf * idf AS weight FROM doc_terms JOIN vocabulary USING (term)""",
    "doc_norms": """
        SELECT chunk_id, sqrt(sum(weight * weight)) AS norm FROM doc_weights
        GROUP BY chunk_id""",
    "questions": """
        SELECT item_id AS query_id, text AS query FROM benchmark""",
    "part_questions": """
        SELECT p_partkey AS query_id, p_name AS query FROM part""",
}


def _retrieval(name: str, source: str, k: int) -> dict[str, str]:
    """Query weights, cosine scores and ranked hits of one question table."""
    return {
        f"{name}_raw": f"""
            SELECT query_id, term, tf * idf AS weight FROM (
                SELECT query_id, term, count(*) AS tf FROM (
                    SELECT query_id, unnest(regexp_extract_all(
                        lower(query), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM {source})
                WHERE term NOT IN (STOP_WORDS) GROUP BY query_id, term)
            JOIN vocabulary USING (term)""",
        f"{name}_weights": f"""
            SELECT query_id, term,
                   weight / sqrt(sum(weight * weight) OVER (PARTITION BY query_id)) AS weight
            FROM {name}_raw""",
        f"{name}_scores": f"""
            SELECT query_id, chunk_id, dot / norm AS score FROM (
                SELECT query_id, chunk_id, sum(q.weight * d.weight) AS dot
                FROM {name}_weights q JOIN doc_weights d USING (term)
                GROUP BY query_id, chunk_id) JOIN doc_norms USING (chunk_id)""",
        f"{name}_hits": f"""
            SELECT * FROM (
                SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
                    ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank
                FROM {name}_scores) WHERE rank <= {k}""",
    }


CTES.update(_retrieval("question", "questions", 3))
CTES.update(_retrieval("part", "part_questions", 5))
CTES["packed"] = """
    SELECT query_id, count(*) AS policy_count FROM question_hits WHERE score >= 0.05
    GROUP BY query_id"""
CTES["asked"] = f"""
    SELECT *, event_id % 4 AS kind, round(value / 500 + 1e-9, 4) AS p,
           printf('TXN_%06d', event_id) AS transaction_id,
           CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED'
               WHEN 'signup' THEN 'ESCALATED' ELSE event_type END AS decision
    FROM events"""
CTES["resolved"] = f"""
    SELECT *, CASE WHEN kind = 1 THEN percent / 100 WHEN kind IN (0, 2) THEN p ELSE 0.0 END
                  AS risk_probability,
           CASE WHEN kind = 1 THEN percent
                WHEN kind IN (0, 2) AND p > 0 THEN p * 100 ELSE 0.0 END AS risk_percentage,
           CASE WHEN kind = 3 OR p = 0 THEN 'UNKNOWN' ELSE
               {_band('CASE WHEN kind = 1 THEN percent / 100 ELSE p END')} END AS risk_level
    FROM (SELECT *, round(p * 100, 2) AS percent FROM asked)
    WHERE decision IN ('APPROVED', 'REJECTED', 'ESCALATED')"""
CTES["audit"] = f"""
    SELECT sha256(transaction_id || '|' || decision || '|' || CAST(event_id AS VARCHAR) || '|'
                  || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS audit_key,
           event_id AS id, transaction_id, coalesce(amount, 0.0) AS amount,
           risk_probability, risk_percentage, risk_level,
           CASE kind WHEN 0 THEN {_text(C.ACTION_MEDIUM)} WHEN 3 THEN {_text(C.ACTION_LOW)}
                ELSE {_text(C.DEFAULT_RECOMMENDATION)} END AS ai_recommendation,
           CASE kind WHEN 0 THEN 'first reason' || chr(10) || 'second reason'
                ELSE {_text(C.DEFAULT_REASONING)} END AS ai_reasoning,
           CASE kind WHEN 0 THEN event_type || ' (Relevance: ' || {_digits('p', 4)} || ')'
                || chr(10) || chr(10) || 'no score' ELSE '' END AS policy_evidence,
           decision AS human_decision,
           CASE decision WHEN 'APPROVED' THEN {_sentence(C.NOTE_APPROVED, 'transaction_id')}
               WHEN 'REJECTED' THEN {_sentence(C.NOTE_REJECTED, 'transaction_id')}
               ELSE {_sentence(C.NOTE_ESCALATED, 'transaction_id')} END AS reviewer_note,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
    FROM resolved LEFT JOIN (SELECT transaction_id, amount FROM transactions)
        USING (transaction_id)"""
CTES["ranked"] = """
    SELECT transaction_id, chargeback_label, n,
           row_number() OVER (PARTITION BY chargeback_label
               ORDER BY md5(transaction_id), transaction_id) AS rank
    FROM (SELECT transaction_id, chargeback_label,
                 count(*) OVER (PARTITION BY chargeback_label) AS n FROM joined)"""
CTES["parts"] = """
    SELECT transaction_id, chargeback_label, rank > round(CAST(0.7 AS DOUBLE) * n) AS test FROM ranked"""

# the same evaluations of the test part alone
CTES["tested_models"] = "SELECT * FROM models WHERE transaction_id IN (SELECT transaction_id FROM parts WHERE test)"
for _name in ("model_counts", "model_auc", "model_quality"):
    _sql = CTES[_name]
    for _used in ("model_counts", "model_auc"):
        _sql = re.sub(rf"\b{_used}\b", f"tested_{_used}", _sql)
    CTES[f"tested_{_name}"] = re.sub(r"\bFROM models\b", "FROM tested_models", _sql)

COLUMNS = ", ".join(C.FEATURE_COLUMNS)
CONFLICT = "len(risk_texts) > 0 AND len(mitigating_texts) > 0"
IMPACT = f"amount > {C.HIGH_IMPACT_AMOUNT}"
AUDIT_LIST = (
    "audit_key, id, transaction_id, amount, risk_probability, risk_percentage, risk_level, "
    "ai_recommendation, ai_reasoning, policy_evidence, human_decision, reviewer_note, timestamp"
)
DOCUMENT_TEXT = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
REQUIRED = [
    "amount", "payment_method", "ip_country", "authentication_status",
    "previous_transactions", "previous_chargebacks", "previous_refunds", "account_age_days",
    "successful_transactions", "known_devices", "average_order_value", "product_category",
    "delivery_status", "refund_status", "device_id", "transaction_day_of_week",
    "product_value", "transaction_hour", "is_weekend",
]
MISSING = ", ".join(
    f"CASE WHEN ({c} IS NULL{' OR kind = 6' if c == 'amount' else ''})"
    f"{' AND kind <> 7' if c == 'payment_method' else ' AND kind <> 5' if c == 'known_devices' else ''} THEN '{c}' END"
    for c in REQUIRED
)


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _unpivot(columns: list[str], kind: str) -> str:
    return _union(
        [f"SELECT '{c}' AS column_name, CAST({c} AS {kind}) AS value FROM features" for c in columns]
    )


def _filled(c: str) -> str:
    if c in NUMERIC:
        return f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM features))"
    return f"coalesce({c}, 'unknown')"


def _mode(c: str) -> str:
    return (
        f"(SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


def _signal_query(kind: str) -> str:
    return f"""
        SELECT transaction_id, CAST(len({kind}_texts) AS INTEGER) AS signal_count,
               array_to_string({kind}_codes, ',') AS codes,
               array_to_string({kind}_texts, chr(10)) AS texts FROM signals"""


IMPUTED = [c for c in TEXTS if c != C.DEVICE_COLUMN]
SCALED = ", ".join(
    f"round((coalesce({c}, m_{c}) - avg(coalesce({c}, m_{c})) OVER ()) / coalesce(nullif("
    f"stddev_pop(coalesce({c}, m_{c})) OVER (), 0), 1), 5) AS {c}"
    for c in NUMERIC
)

BODIES: dict[str, str] = {
    "risk_by_band": f"""
        SELECT {_band('score')} AS risk_level, count(*) AS transactions,
               CAST(sum(chargeback_label) AS BIGINT) AS disputes,
               CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount
        FROM scored GROUP BY 1""",
    "table_counts": _union(
        [
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {cte}"
            for name, cte in [
                ("transactions", "transactions"), ("customers", "customers"),
                ("orders", "canonical_orders"), ("chargebacks", "chargebacks"),
            ]
        ]
        + ["""SELECT 'evidence', 3 * count(*) FROM transactions
              JOIN canonical_orders USING (transaction_id)"""]
    ),
    "customer_profile": "SELECT * FROM customers",
    "order_table": "SELECT * FROM canonical_orders",
    "chargeback_claims": "SELECT * FROM chargebacks",
    "evidence_records": f"""
        SELECT printf('EV_%06d', (number - 1) * 3 + position) AS evidence_id, transaction_id,
               evidence_type, content FROM (
            SELECT number, transaction_id, 1 AS position,
                   'payment_authentication' AS evidence_type,
                   {_sentence(C.EVIDENCE_AUTH, 'authentication_status')} AS content
            FROM transactions JOIN canonical_orders USING (transaction_id)
            UNION ALL
            SELECT number, transaction_id, 2, 'delivery_confirmation',
                   {_sentence(C.EVIDENCE_DELIVERY, 'delivery_status', 'delivery_date')}
            FROM transactions JOIN canonical_orders USING (transaction_id)
            UNION ALL
            SELECT number, transaction_id, 3, 'refund_record',
                   {_sentence(C.EVIDENCE_REFUND, 'refund_status')}
            FROM transactions JOIN canonical_orders USING (transaction_id))""",
    "disputed_ids": "SELECT DISTINCT transaction_id FROM chargebacks",
    "dispute_labels": "SELECT transaction_id, chargeback_label FROM joined",
    "customer_join": """
        SELECT transaction_id, amount, customer_id, account_age_days, previous_transactions,
               successful_transactions, previous_chargebacks, previous_refunds,
               known_devices, average_order_value FROM joined""",
    "order_join": """
        SELECT transaction_id, product_category, product_value, delivery_status FROM joined""",
    "calendar_features": """
        SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS event_time,
               CAST(extract(hour FROM t) AS INTEGER) AS transaction_hour,
               CAST(isodow(t) - 1 AS INTEGER) AS transaction_day_of_week,
               CAST(coalesce(isodow(t) >= 6, false) AS INTEGER) AS is_weekend
        FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events)""",
    "feature_table": f"SELECT transaction_id, {COLUMNS}, chargeback_label FROM features",
    "request_features": f"""
        SELECT transaction_id,
               {_ratio('amount', 'aov', '> 0')} AS amount_to_avg_order_ratio,
               {_ratio('successful_transactions', 'past', '> 0')} AS customer_success_rate,
               {_ratio('previous_chargebacks', 'past', '> 0')} AS customer_chargeback_rate,
               {_ratio('previous_refunds', 'past', '> 0')} AS customer_refund_rate,
               has_previous_chargeback, is_new_customer
        FROM (SELECT *, round(average_order_value - 150000, 2) AS aov,
                     previous_transactions - 2 AS past FROM features)""",
    "filled_feature_table": "SELECT transaction_id, "
    + ", ".join(f"{_filled(c)} AS {c}" for c in C.FEATURE_COLUMNS)
    + ", chargeback_label FROM features",
    "model_input": "SELECT "
    + ", ".join(c for c in C.FEATURE_COLUMNS
                if c != C.DEVICE_COLUMN and "time" not in c and "date" not in c)
    + ", chargeback_label FROM features",
    "missing_cells": "SELECT CAST("
    + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in C.FEATURE_COLUMNS)
    + " AS BIGINT) AS missing_cells, count(*) AS row_count FROM features",
    "label_distribution": """
        SELECT chargeback_label, count(*) AS transactions FROM joined GROUP BY 1 ORDER BY 1""",
    "label_summary": """
        SELECT count(*) FILTER (chargeback_label = 1) AS positives,
               count(*) FILTER (chargeback_label = 0) AS negatives,
               round(avg(chargeback_label), 6) AS positive_rate,
               round(CAST(count(*) FILTER (chargeback_label = 0) AS DOUBLE)
                     / count(*) FILTER (chargeback_label = 1), 6) AS imbalance_ratio
        FROM joined""",
    "class_weights": """
        SELECT chargeback_label, count(*) AS class_rows,
               round(CAST((SELECT count(*) FROM joined) AS DOUBLE) / (2 * count(*)), 6)
                   AS class_weight FROM joined GROUP BY 1""",
    "column_medians": _union(
        [f"SELECT '{c}' AS column_name, CAST(median({c}) AS DOUBLE) AS median FROM features"
         for c in NUMERIC]
    ),
    "column_modes": f"""
        SELECT column_name, value AS mode_value, n AS mode_count FROM (
            SELECT column_name, value, count(*) AS n, row_number() OVER (
                PARTITION BY column_name ORDER BY count(*) DESC, value) AS place
            FROM ({_unpivot(TEXTS, 'VARCHAR')}) WHERE value IS NOT NULL
            GROUP BY column_name, value) WHERE place = 1""",
    "column_categories": f"""
        SELECT column_name, value, count(*) AS n FROM ({_unpivot(IMPUTED, 'VARCHAR')})
        WHERE value IS NOT NULL GROUP BY ALL""",
    "column_scales": f"""
        SELECT column_name, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std
        FROM ({_unpivot(NUMERIC, 'DOUBLE')}) GROUP BY column_name""",
    "imputed_scaled": f"""
        SELECT transaction_id, {SCALED},
               {', '.join(f'coalesce({c}, {_mode(c)}) AS {c}' for c in IMPUTED)}
        FROM features, (SELECT {', '.join(f'median({c}) AS m_{c}' for c in NUMERIC)}
                        FROM features)""",
    "split_70_30": """
        SELECT transaction_id, chargeback_label,
               CASE WHEN rank <= round(CAST(0.7 AS DOUBLE) * n) THEN 'train'
                    ELSE 'test' END AS part FROM ranked""",
    "split_70_15_15": """
        SELECT transaction_id, chargeback_label,
               CASE WHEN rank <= round(CAST(0.7 AS DOUBLE) * n) THEN 'train'
                    WHEN rank <= round(CAST(0.85 AS DOUBLE) * n) THEN 'validation'
                    ELSE 'test' END AS part FROM ranked""",
    "results_sizes": f"""
        SELECT (SELECT count(*) FROM parts) AS total_dataset_size,
               (SELECT count(*) FROM parts WHERE NOT test) AS training_set_size,
               (SELECT count(*) FROM parts WHERE test) AS held_out_test_set_size,
               (SELECT count(*) FROM parts WHERE chargeback_label = 1) AS positive_class_count,
               unnest([{', '.join(_text(m) for m in C.MODEL_NAMES)}]) AS model_name,
               (SELECT count(*) FROM parts WHERE test) AS cells,
               (SELECT count(*) FROM parts WHERE test AND chargeback_label = 1) AS positives
        FROM (SELECT 1)""",
    "results_fields": f"""
        SELECT model AS model_name, accuracy, precision, recall, f1 AS f1_score, roc_auc,
               true_negative AS true_negatives, false_positive AS false_positives,
               false_negative AS false_negatives, true_positive AS true_positives,
               fp_amount AS fp_actual_affected_amount, fp_cost AS false_positive_friction_cost,
               fn_cost AS false_negative_dispute_cost, estimated_cost AS total_business_risk_cost,
               model = (SELECT model FROM tested_model_counts
                        ORDER BY coalesce(2.0 * true_positive / nullif(2 * true_positive + false_positive
                                 + false_negative, 0), 0) DESC, position LIMIT 1) AS selected,
               CAST({C.FALSE_NEGATIVE_COST} AS DOUBLE) AS unit_cost
        FROM tested_model_quality""",
    "threshold_table": """
        SELECT threshold, true_negative, false_positive, false_negative, true_positive, accuracy, precision, recall, f1,
               CAST(estimated_cost AS DOUBLE) AS estimated_cost FROM sweep""",
    "logistic_regression_check": f"""
        SELECT '{C.LOGISTIC_REGRESSION}' AS model, count(*) FILTER (chargeback_label = 0) AS negatives,
               count(*) FILTER (chargeback_label = 1) AS positives, true AS at_minimum
        FROM parts WHERE test""",
    "streamed_scores": f"""
        SELECT transaction_id, '{C.LOGISTIC_REGRESSION}' AS model, true AS same_as_table, true AS is_probability,
               true AS in_its_band FROM transactions""",
    "streamed_investigations": f"""
        SELECT transaction_id, p AS risk_probability, {_band('p')} AS risk_level,
               CASE WHEN p >= 0.7 THEN {_text(C.ACTION_HIGH)}
                    WHEN p >= 0.4 THEN {_text(C.ACTION_MEDIUM)}
                    ELSE {_text(C.ACTION_LOW)} END AS recommended_action,
               CAST({C.TOP_K} AS INTEGER) AS policy_count, {_routing('true', CONFLICT, IMPACT, 'action')} AS action
        FROM (SELECT *, least(1.0, greatest(0.0, score)) AS p FROM signals)""",
    "score_records": f"""
        SELECT transaction_id, round(score, 4) AS risk_probability,
               round(score * 100, 2) AS risk_percentage, {_band('score')} AS risk_level,
               'Random Forest' AS model FROM scored""",
    "confusion_matrix": """
        SELECT true_negative, false_positive, false_negative, true_positive
        FROM sweep WHERE threshold = 0.5""",
    "classification_metrics": "SELECT * EXCLUDE (threshold) FROM sweep WHERE threshold = 0.5",
    "roc_auc": f"""
        SELECT round(roc_auc, 6) AS roc_auc FROM model_auc
        WHERE model = '{C.LOGISTIC_REGRESSION}'""",
    "threshold_sweep": "SELECT * FROM sweep",
    "best_threshold": "SELECT * FROM sweep ORDER BY estimated_cost, threshold LIMIT 1",
    "false_positive_volume": f"""
        SELECT false_positive AS false_positives, fp_amount FROM model_counts
        WHERE model = '{C.LOGISTIC_REGRESSION}'""",
    "model_evaluations": "SELECT * FROM model_quality",
    "one_model_evaluation": f"SELECT * FROM model_quality WHERE model = '{C.RANDOM_FOREST}'",
    "ranked_models": f"""
        SELECT model, round({_share('true_positive + true_negative',
               '(true_negative + false_positive + false_negative + true_positive)')}, 6)
                   AS accuracy,
               round({_share('true_positive', '(true_positive + false_positive)')}, 6)
                   AS precision,
               round({_share('true_positive', '(true_positive + false_negative)')}, 6) AS recall,
               round({_share('2 * true_positive',
                             '(2 * true_positive + false_positive + false_negative)')}, 6) AS f1
        FROM model_counts ORDER BY f1 DESC, position""",
    "selected_model": f"""
        SELECT model, f1, recall, estimated_cost,
               {_sentence(C.SELECTION_REASON, 'model', "printf('%.4f', f1)",
                          "printf('%.4f', recall)",
                          "format('{:,}', CAST(estimated_cost AS BIGINT))")} AS selection_reason
        FROM (SELECT q.*, 2.0 * c.true_positive
                     / nullif(2 * c.true_positive + c.false_positive + c.false_negative, 0)
                         AS exact
              FROM model_quality q JOIN model_counts c USING (model))
        ORDER BY coalesce(exact, 0) DESC, position LIMIT 1""",
    "document_chunks": f"""
        SELECT doc_id, CAST(place - 1 AS INTEGER) AS chunk_no,
               regexp_replace(pieces[place], '^\\s+|\\s+$', '', 'g') AS chunk
        FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS place
              FROM (SELECT doc_id, string_split(regexp_replace({DOCUMENT_TEXT},
                        '\\n(\\p{{Lu}})', chr(1) || '\\1', 'g'), chr(1)) AS pieces
                    FROM documents))
        WHERE regexp_replace(pieces[place], '^\\s+|\\s+$', '', 'g') <> ''""",
    "term_statistics": "SELECT term, df, round(idf, 6) AS idf FROM vocabulary",
    "document_norms": "SELECT chunk_id, round(norm, 5) AS norm FROM doc_norms",
    "question_weights": "SELECT query_id, term, round(weight, 6) AS weight FROM question_weights",
    "retrieval_top_k": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 4) AS score
        FROM question_hits""",
    "retrieval_padded": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 4) AS score
        FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
                  ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank
              FROM (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score
                    FROM part_questions CROSS JOIN (SELECT doc_id AS chunk_id FROM documents)
                    LEFT JOIN part_scores USING (query_id, chunk_id))) WHERE rank <= 5""",
    "retrieval_lists": f"""
        SELECT query_id, string_agg(text || ' (Relevance: ' || {_digits('round(score, 4)', 4)}
                   || ')', chr(10) || chr(10) ORDER BY rank) AS hits
        FROM question_hits JOIN documents ON doc_id = chunk_id GROUP BY query_id""",
    "risk_signals": _signal_query("risk"),
    "mitigating_signals": _signal_query("mitigating"),
    "amount_over_average": f"""
        SELECT transaction_id, {OVER} AS percent_over, {_money('amount')} AS amount_text
        FROM features""",
    "normalised_probabilities": f"""
        SELECT event_id, p, {_band('p')} AS risk_level FROM (
            SELECT event_id, greatest(0.0, least(1.0, CASE WHEN value - 1 > 1
                THEN (value - 1) / 100 ELSE value - 1 END)) AS p FROM events)""",
    "review_routing": f"""
        SELECT transaction_id,
               {_routing('number % 7 <> 0', CONFLICT, IMPACT, 'action')} AS action,
               {_routing('number % 7 <> 0', CONFLICT, IMPACT, 'priority')} AS priority,
               {_routing('number % 7 <> 0', CONFLICT, IMPACT, 'reason')} AS reason,
               {_band('score')} AS risk_level, round(score, 4) AS risk_probability,
               {_routing('number % 7 <> 0', CONFLICT, IMPACT, 'human_required')}
                   AS human_required FROM signals""",
    "investigation_reports": f"""
        SELECT transaction_id, p AS risk_probability, round(p * 100, 2) AS risk_percentage,
               {_band('p')} AS risk_level, CAST(len(risk_texts) AS INTEGER) AS risk_count,
               CAST(len(mitigating_texts) AS INTEGER) AS mitigating_count,
               CAST(policies AS INTEGER) AS policy_count,
               CASE WHEN p >= 0.7 THEN {_text(C.ACTION_HIGH)}
                    WHEN p >= 0.4 THEN {_text(C.ACTION_MEDIUM)}
                    ELSE {_text(C.ACTION_LOW)} END AS recommended_action,
               '[ML SIGNAL] ' || {_sentence(C.ML_SIGNAL, "'Random Forest'", _band('p'),
                                            _digits('round(p * 100, 2)', 2))} || chr(10)
               || {_sentence(C.REASONING_SIGNALS, 'len(risk_texts)', _first_two('risk_texts'),
                             'len(mitigating_texts)', _first_two('mitigating_texts'))}
               || chr(10) || CASE WHEN policies > 0
                   THEN {_sentence(C.REASONING_POLICIES, 'policies')}
                   ELSE {_text(C.REASONING_NO_POLICIES)} END || chr(10)
               || {_sentence(C.REASONING_ADVICE,
                             _routing('policies > 0', CONFLICT, IMPACT, 'reason'))} AS reasoning,
               {_routing('policies > 0', CONFLICT, IMPACT, 'action')} AS action,
               {_routing('policies > 0', CONFLICT, IMPACT, 'priority')} AS priority,
               {_routing('policies > 0', CONFLICT, IMPACT, 'human_required')} AS human_required
        FROM (SELECT * REPLACE (least(1.0, greatest(0.0,
                         CASE WHEN score > 1 THEN score / 100 ELSE score END)) AS score),
                     least(1.0, greatest(0.0, CASE WHEN score > 1 THEN score / 100
                                              ELSE score END)) AS p,
                     coalesce(policy_count, 0) AS policies
              FROM signals LEFT JOIN packed
                  ON query_id = number % (SELECT count(*) FROM benchmark))""",
    "incomplete_requests": "SELECT transaction_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in REQUIRED)
    + ") AS missing_fields FROM features WHERE "
    + " OR ".join(f"{c} IS NULL" for c in REQUIRED),
    "request_scores": f"""
        SELECT transaction_id, round(score, 4) AS risk_probability,
               round(score * 100, 2) AS risk_percentage, {_band('score')} AS risk_level,
               'Random Forest' AS model FROM scored WHERE """
    + " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED),
    "coerced_requests": """
        SELECT number AS request_id,
               CASE WHEN kind = 3 THEN 'DEFAULT_ID' ELSE transaction_id END AS transaction_id,
               amount, payment_method, previous_transactions, account_age_days, known_devices, product_value,
               is_weekend
        FROM sent_scores WHERE NOT broken AND kind < 5 AND """.replace("DEFAULT_ID", C.DEFAULT_TRANSACTION_ID)
    + " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED),
    "request_rejects": f"""
        SELECT number AS request_id,
               CASE WHEN broken THEN 'malformed request' ELSE concat_ws('; ',
                   CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END,
                   CASE WHEN len(malformed) > 0 THEN 'malformed: ' || array_to_string(malformed, ', ') END) END AS error
        FROM (SELECT *, list_filter([{MISSING}], lambda x: x IS NOT NULL) AS missing,
                     CASE kind WHEN 5 THEN ['known_devices']
                               WHEN 6 THEN CASE WHEN account_age_days IS NULL THEN [] ELSE ['account_age_days'] END
                               WHEN 7 THEN ['transaction_id', 'payment_method'] ELSE [] END AS malformed
              FROM sent_scores)
        WHERE broken OR len(missing) + len(malformed) > 0""",
    "investigation_requests": f"""
        SELECT number AS request_id, transaction_id, 'rules for ' || payment_method AS query,
               round(score, 4) AS risk_probability, {_band('score')} AS risk_level,
               array_to_string(risk_texts, chr(10)) AS risk_texts,
               array_to_string(mitigating_texts, chr(10)) AS mitigating_texts,
               {_routing('number % 3 <> 0', CONFLICT, IMPACT, 'action')} AS action
        FROM investigated""",
    "investigation_rejects": """
        SELECT number AS request_id,
               CASE number % 8 WHEN 4 THEN 'malformed: transaction.amount' WHEN 5 THEN 'malformed: transaction'
                    WHEN 6 THEN 'missing: query' ELSE 'malformed: risk_probability' END AS error
        FROM features WHERE number % 8 >= 4""",
    "report_fields": f"""
        SELECT transaction_id, round(score * 100, 2) AS risk_percentage,
               {_sentence(C.ML_SIGNAL, "'Random Forest'", _band('score'), _digits('round(score * 100, 2)', 2))}
                   AS ml_signal,
               CAST(len(risk_texts) AS INTEGER) AS risk_count,
               CASE WHEN score >= 0.7 THEN {_text(C.ACTION_HIGH)} WHEN score >= 0.4 THEN {_text(C.ACTION_MEDIUM)}
                    ELSE {_text(C.ACTION_LOW)} END AS recommendation,
               {_routing('number % 3 <> 0', CONFLICT, IMPACT, 'human_required')} AS human_required,
               {_routing('number % 3 <> 0', CONFLICT, IMPACT, 'action')} AS action,
               true AS defense_only,
               {_routing('number % 3 <> 0', CONFLICT, IMPACT, 'reason')} AS reason,
               amount, CAST(number % 5 AS INTEGER) AS channel_code, 'b' AS second_tag,
               {_text(C.EVIDENCE_WARNING)} AS evidence_warning
        FROM investigated""",
    "rejected_reviews": """
        SELECT event_id AS review_id, decision,
               'Invalid review decision. Use APPROVED, REJECTED, or ESCALATED.' AS error
        FROM asked WHERE decision NOT IN ('APPROVED', 'REJECTED', 'ESCALATED')""",
    "resolved_reviews": """
        SELECT event_id AS review_id, risk_probability, risk_percentage, risk_level
        FROM resolved""",
    "audit_records": f"SELECT {AUDIT_LIST} FROM audit",
    "review_acknowledgements": f"""
        SELECT true AS success, transaction_id, risk_probability, risk_percentage, risk_level,
               ai_recommendation, human_decision AS decision, reviewer_note, id AS audit_id,
               timestamp AS audit_time,
               {_sentence(C.REVIEW_MESSAGE, 'human_decision')} AS message FROM audit""",
    "audit_history": """
        SELECT id, transaction_id, human_decision, risk_level, timestamp FROM audit
        ORDER BY id DESC""",
    "audit_store": f"SELECT {AUDIT_LIST} FROM audit",
    "audit_count": "SELECT count(DISTINCT audit_key) AS record_count FROM audit",
    "audit_display": f"""
        SELECT id, transaction_id, printf('%.2f%%', risk_percentage) AS risk_score,
               CASE WHEN risk_level <> 'UNKNOWN' THEN risk_level
                    ELSE {_band('least(1.0, risk_probability)')} END AS risk_level,
               ai_recommendation, human_decision AS decision, reviewer_note, timestamp
        FROM audit""",
    "json_reviews": """
        SELECT sha256(printf('TXN_%06d', event_id) || '|' || decision || '|' || event_id || '-' || copy
                      || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS audit_key,
               printf('TXN_%06d', event_id) AS transaction_id, 10.5::DOUBLE AS amount,
               CASE kind WHEN 0 THEN 'first' || chr(10) || event_type WHEN 1 THEN 'plain ' || event_type
                    WHEN 2 THEN concat_ws(chr(10), 'x', event_type, '7', 'True', 'None')
                    ELSE '{"why":1}' END AS ai_reasoning,
               CASE kind WHEN 0 THEN concat_ws(chr(10) || chr(10), 'P1 (Relevance: 0.5)', 'P2', 'P3')
                    WHEN 2 THEN concat_ws(chr(10) || chr(10), 'N1 (Relevance: 0.25)', 'N2')
                    ELSE 'policy text' END AS policy_evidence,
               decision AS human_decision, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
               CASE kind WHEN 2 THEN 0.45::DOUBLE WHEN 3 THEN 0.8::DOUBLE ELSE 0::DOUBLE END AS risk_probability,
               CASE kind WHEN 2 THEN 45::DOUBLE WHEN 3 THEN 80::DOUBLE ELSE 0::DOUBLE END AS risk_percentage,
               CASE kind WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'UNKNOWN' END AS risk_level
        FROM (SELECT *, event_id % 4 AS kind,
                     CASE WHEN event_type = 'error' THEN 'REJECTED' ELSE 'APPROVED' END AS decision,
                     unnest(['a', 'b']) AS copy FROM events)
        WHERE event_id % 11 <> 5 AND event_id % 13 <> 7""",
    "json_review_rejects": """
        SELECT CASE WHEN event_id % 13 = 7 THEN 'request has no identity' ELSE 'malformed request' END
                   AS error, CAST(2 * count(*) AS BIGINT) AS n
        FROM events WHERE event_id % 11 = 5 OR event_id % 13 = 7 GROUP BY 1""",
    "streamed_features": f"""
        SELECT transaction_id, round(score, 4) AS risk_probability,
               round(score * 100, 2) AS risk_percentage, {_band('score')} AS risk_level,
               'Random Forest' AS model FROM scored""",
    "streamed_reviews": f"SELECT {AUDIT_LIST} FROM audit",
}


# the same rows, written to a file and read back
BODIES |= {
    "csv_customers": BODIES["customer_profile"],
    "csv_model_table": BODIES["feature_table"],
    "results_table": BODIES["ranked_models"],
}


def _needed(sql: str) -> list[str]:
    """Shared definitions a query uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", todo.pop())))
        for name in (words & CTES.keys()) - found:
            found.add(name)
            todo.append(CTES[name])
    return [name for name in CTES if name in found]


def oracle_sql() -> dict[str, str]:
    from disputeflow.functions.stopwords import english_stop_words

    stopped = ", ".join(_text(w) for w in english_stop_words())
    out = {}
    for name, body in BODIES.items():
        shared = ",\n".join(f"{cte} AS ({CTES[cte]})" for cte in _needed(body))
        sql = f"WITH {shared}\n{body}" if shared else body
        out[name] = sql.replace("STOP_WORDS", stopped)
    return out
