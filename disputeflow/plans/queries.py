"""Registered queries over the given tables, one per operator or small family."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from disputeflow import constants as C
from disputeflow.functions.numbers import normalise_probability, percent_over, risk_level
from disputeflow.functions.texts import money_text
from disputeflow.operators import (
    audit,
    evidence,
    features,
    metrics,
    report,
    retrieval,
    review,
    signals,
    skew,
    split,
    statistics,
)
from disputeflow.plans import evaluation, modelling
from disputeflow.plans.risk_summary import risk_summary
from disputeflow.session import shared_folder, stored
from disputeflow.sources import driver_tables as given
from disputeflow.sources import requests, scans, sinks
from disputeflow.sources.audit_store import AuditStore
from disputeflow.streaming import jobs

SENTENCE_START = r"\p{Lu}"
DAY = "yyyy-MM-dd"
SECOND = "yyyy-MM-dd HH:mm:ss"
#: What ``report_fields`` reads of a JSON report.
REPORT_FIELDS = """risk_assessment struct<risk_percentage: double, ml_signal: string>, key_risk_signals array<string>,
    recommendation string, human_review_requirement struct<human_required: boolean, action: string, defense_only: boolean>,
    human_review struct<reason: string>, evidence_warning string,
    transaction_summary struct<amount: double, channel: struct<code: int, tags: array<string>>>"""


# --- shared inputs -------------------------------------------------------------------
def _features(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    t = given.tables(spark, sf_dir)
    return features.feature_table(
        t["transactions"], t["customers"], t["orders"], t["chargebacks"], *extra
    )


def _scored(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return _features(spark, sf_dir, *extra).withColumn("score", given.fixture_score())


def _three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stand-in scores per transaction, decided at 0.5."""
    score = F.col("score")
    doubled = F.round(F.least(score * 2, F.lit(1.0)) + 1e-9, 4)
    refunds = F.round(F.col("customer_refund_rate") * 0.9 + 1e-9, 4)
    tagged = [
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("position"), value.alias("score"))
        for i, (name, value) in enumerate(zip(C.MODEL_NAMES, [score, doubled, refunds]))
    ]
    rows = _scored(spark, sf_dir).select(
        "transaction_id", "amount", C.TARGET, F.inline(F.array(*tagged))
    )
    return metrics.predict(rows)


def _investigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction asks one of the given questions about the given documents."""
    corpus = given.corpus(spark, sf_dir)
    queries = given.questions(spark, sf_dir)
    titled = corpus.select(
        "chunk_id", F.concat(F.lit("DOC_"), F.col("chunk_id").cast("string")).alias("title")
    )
    hits = retrieval.retrieve(corpus, queries, pad=False, min_score=0.05)
    packed = stored(retrieval.pack_hits(hits, titled, "title"), "policy-hits")
    number = given.number_of()
    n_queries = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    query_id = F.pmod(number, n_queries).alias("query_id")
    rows = _scored(spark, sf_dir, "delivery_status").select(
        "*", F.col("score").alias("risk_probability"), query_id
    )
    keys = given.transactions(spark, sf_dir).select(query_id)
    return report.investigate(report.attach_policies(rows, packed, keys))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = audit.split_by_decision(given.reviews(spark, sf_dir))
    return audit.audit_records(accepted)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", F.date_format("timestamp", SECOND))


# --- tables, joins and features ----------------------------------------------------------
def table_counts(spark, sf_dir):
    t = given.tables(spark, sf_dir)
    t["evidence"] = evidence.evidence_records(t["transactions"], t["orders"])
    return statistics.row_counts(t)


def customer_profile(spark, sf_dir):
    return given.customers(spark, sf_dir).select(*features.CUSTOMER_COLUMNS)


def order_table(spark, sf_dir):
    return given.orders(spark, sf_dir).withColumn(
        "delivery_date", F.date_format("delivery_date", DAY)
    )


def chargeback_claims(spark, sf_dir):
    return given.chargebacks(spark, sf_dir).withColumn(
        "claim_date", F.date_format("claim_date", DAY)
    )


def evidence_records(spark, sf_dir):
    return evidence.evidence_records(
        given.transactions(spark, sf_dir), given.orders(spark, sf_dir)
    )


def disputed_ids(spark, sf_dir):
    return given.chargebacks(spark, sf_dir).select("transaction_id").distinct()


def dispute_labels(spark, sf_dir):
    return features.label_disputes(
        given.transactions(spark, sf_dir), given.chargebacks(spark, sf_dir)
    ).select("transaction_id", C.TARGET)


def customer_join(spark, sf_dir):
    joined = features.with_customers(
        given.transactions(spark, sf_dir), given.customers(spark, sf_dir)
    )
    return joined.select("transaction_id", "amount", *features.CUSTOMER_COLUMNS)


def order_join(spark, sf_dir):
    joined = features.with_orders(
        given.transactions(spark, sf_dir), given.orders(spark, sf_dir), "delivery_status"
    )
    return joined.select(
        "transaction_id", "product_category", "product_value", "delivery_status"
    )


def calendar_features(spark, sf_dir):
    """From event times written as text, some of them broken."""
    rows = given.read(spark, sf_dir, "events").select(
        "event_id",
        F.when(
            F.pmod("event_id", F.lit(10)) == 0, "not a time"
        ).otherwise(F.date_format("ts", SECOND)).alias("event_time"),
    )
    return features.add_calendar(rows, "event_time").select(
        "event_id",
        F.date_format("event_time", SECOND).alias("event_time"),
        "transaction_hour",
        "transaction_day_of_week",
        "is_weekend",
    )


def feature_table(spark, sf_dir):
    return _features(spark, sf_dir)


def request_features(spark, sf_dir):
    """The request rule: denominators must be positive (here average minus a shift)."""
    rows = _features(spark, sf_dir).withColumns(
        {
            "average_order_value": F.round(F.col("average_order_value") - 150000, 2),
            "previous_transactions": F.col("previous_transactions") - 2,
        }
    )
    return features.derive_features(rows, "nonpositive").select(
        "transaction_id",
        "amount_to_avg_order_ratio",
        "customer_success_rate",
        "customer_chargeback_rate",
        "customer_refund_rate",
        "has_previous_chargeback",
        "is_new_customer",
    )


def filled_feature_table(spark, sf_dir):
    rows = stored(features.infinities_to_null(_features(spark, sf_dir)), "features")
    wanted = [c for c in features.numeric_columns(rows) if c != C.TARGET]
    return features.fill_missing(rows, statistics.median_map(rows, wanted))


def model_input(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return rows.select(*features.model_columns(rows), C.TARGET)


def missing_cells(spark, sf_dir):
    return statistics.missing_cells(_features(spark, sf_dir))


# --- column statistics ----------------------------------------------------------------------
def label_distribution(spark, sf_dir):
    return statistics.label_distribution(_labels(spark, sf_dir))


def label_summary(spark, sf_dir):
    return statistics.label_summary(_labels(spark, sf_dir))


def class_weights(spark, sf_dir):
    return statistics.class_weights(_labels(spark, sf_dir)).withColumn(
        "class_weight", F.round("class_weight", 6)
    )


def _labels(spark, sf_dir):
    return features.label_disputes(
        given.transactions(spark, sf_dir).select("transaction_id"),
        given.chargebacks(spark, sf_dir),
    )


def column_medians(spark, sf_dir):
    rows = stored(_features(spark, sf_dir), "features")
    return statistics.exact_medians(rows, features.numeric_columns(rows.drop(C.TARGET)))


def column_modes(spark, sf_dir):
    rows = _features(spark, sf_dir).drop("transaction_id")
    return statistics.modes(rows, features.text_columns(rows))


def column_categories(spark, sf_dir):
    rows = _features(spark, sf_dir).drop("transaction_id", C.DEVICE_COLUMN)
    return statistics.category_values(rows, features.text_columns(rows))


def column_scales(spark, sf_dir):
    rows = _features(spark, sf_dir)
    stats = statistics.scaler_stats(rows, features.numeric_columns(rows.drop(C.TARGET)))
    return metrics.rounded(stats, 5, "mean", "std")


def imputed_scaled(spark, sf_dir):
    """Fitted on all rows here; training fits on its own part only."""
    rows = stored(_features(spark, sf_dir), "features")
    columns = features.model_columns(rows)
    numeric = features.numeric_columns(rows.select(*columns))
    texts = features.text_columns(rows.select(*columns))
    fitted = modelling.Preprocessor(numeric, texts)
    fill = fitted.imputer(rows)
    scaled = fitted.scaler(fill.transform(rows)).transform(fill.transform(rows))
    return scaled.select(
        "transaction_id",
        *[F.round(f"{c}__scaled", 5).alias(c) for c in numeric],
        *[F.col(f"{c}__filled").alias(c) for c in texts],
    )


# --- split -------------------------------------------------------------------------------------
def split_70_30(spark, sf_dir):
    labels = stored(_labels(spark, sf_dir), "labels")
    parts = split.stratified_split(labels, [0.7, 0.3], ["train", "test"])
    return parts.select("transaction_id", C.TARGET, "part")


def split_70_15_15(spark, sf_dir):
    labels = stored(_labels(spark, sf_dir), "labels")
    parts = split.stratified_split(labels, [0.7, 0.15, 0.15], ["train", "validation", "test"])
    return parts.select("transaction_id", C.TARGET, "part")


# --- metrics -----------------------------------------------------------------------------------
def risk_by_band(spark, sf_dir):
    return risk_summary(given.tables(spark, sf_dir), given.fixture_score())


def score_records(spark, sf_dir):
    return report.score_records(_scored(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(metrics.predict(_scored(spark, sf_dir)))


def classification_metrics(spark, sf_dir):
    quality = metrics.with_quality(confusion_matrix(spark, sf_dir))
    return metrics.rounded(quality, 6, "accuracy", "precision", "recall", "f1")


def roc_auc(spark, sf_dir):
    counts = metrics.score_counts(_scored(spark, sf_dir))
    return metrics.rounded(metrics.roc_auc(counts), 6, "roc_auc")


def threshold_sweep(spark, sf_dir):
    sweep = metrics.threshold_sweep(_scored(spark, sf_dir))
    return metrics.rounded(sweep, 6, "accuracy", "precision", "recall", "f1")


def best_threshold(spark, sf_dir):
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


def false_positive_volume(spark, sf_dir):
    return metrics.false_positive_volume(metrics.predict(_scored(spark, sf_dir)))


def model_evaluations(spark, sf_dir):
    return evaluation.evaluate(_three_models(spark, sf_dir)).drop("f1_exact")


def one_model_evaluation(spark, sf_dir):
    return model_evaluations(spark, sf_dir).where(F.col("model") == C.RANDOM_FOREST)


def ranked_models(spark, sf_dir):
    quality = metrics.with_quality(
        metrics.confusion_matrix(_three_models(spark, sf_dir), ["model", "position"])
    )
    ranked = metrics.rank_models(quality).select("model", "accuracy", "precision", "recall", "f1")
    return metrics.rounded(ranked, 6, "accuracy", "precision", "recall", "f1")


def selected_model(spark, sf_dir):
    chosen = evaluation.selection(evaluation.evaluate(_three_models(spark, sf_dir)))
    return chosen.select("model", "f1", "recall", "estimated_cost", "selection_reason")


def _results(spark, sf_dir):
    """All rows and both parts are counted, the test part is evaluated."""
    parts = stored(split_70_30(spark, sf_dir), "parts")
    held_out = parts.where(F.col("part") == "test").select("transaction_id")
    tested = _three_models(spark, sf_dir).join(held_out, "transaction_id", "left_semi")
    return evaluation.results_document(parts, parts, evaluation.evaluate(tested))


def results_document(spark, sf_dir):
    return _results(spark, sf_dir).select(F.to_json(F.struct("*")).alias("document"))


def results_sizes(spark, sf_dir):
    """Sizes of the results document, with the cells of each model's confusion matrix."""
    document = _results(spark, sf_dir)
    each = document.select(
        "dataset_metadata.total_dataset_size",
        "dataset_metadata.training_set_size",
        "dataset_metadata.held_out_test_set_size",
        "dataset_metadata.positive_class_count",
        F.explode("model_evaluations").alias("m"),
    )
    cells = F.col("m.confusion_matrix")
    return each.select(
        "total_dataset_size", "training_set_size", "held_out_test_set_size",
        "positive_class_count", "m.model_name",
        (cells["true_negatives"] + cells["false_positives"] + cells["false_negatives"]
         + cells["true_positives"]).alias("cells"),
        (cells["false_negatives"] + cells["true_positives"]).alias("positives"),
    )


def results_fields(spark, sf_dir):
    """The results document written as JSON and read back: each model's evaluation and the choice."""
    path = shared_folder(spark, "results-document")
    sinks.write_document(_results(spark, sf_dir), path)
    document = spark.read.json(path)
    each = document.select(F.explode("model_evaluations").alias("m"), "selected_production_model", "cost_assumptions")
    cells = F.col("m.confusion_matrix")
    return each.select(
        "m.model_name", "m.accuracy", "m.precision", "m.recall", "m.f1_score", "m.roc_auc",
        cells["true_negatives"].alias("true_negatives"), cells["false_positives"].alias("false_positives"),
        cells["false_negatives"].alias("false_negatives"), cells["true_positives"].alias("true_positives"),
        "m.fp_actual_affected_amount", "m.false_positive_friction_cost", "m.false_negative_dispute_cost",
        "m.total_business_risk_cost",
        (F.col("m.model_name") == F.col("selected_production_model.model_name")).alias("selected"),
        F.col("cost_assumptions.false_negative_unit_dispute_cost").alias("unit_cost"),
    )


# --- stored tables -------------------------------------------------------------------------------
def csv_customers(spark, sf_dir):
    """A base table written as CSV and read with its declared schema."""
    path = shared_folder(spark, "customers-csv")
    sinks.write_table(given.customers(spark, sf_dir), path, "csv")
    return scans.read_table(spark, path, "customers").select(*features.CUSTOMER_COLUMNS)


def csv_model_table(spark, sf_dir):
    """The feature table written as CSV and read with declared types."""
    path = shared_folder(spark, "model-table-csv")
    sinks.write_table(_features(spark, sf_dir), path, "csv")
    return scans.read_model_table(spark, path, "csv")


def results_table(spark, sf_dir):
    """The model comparison written and read back, best first."""
    path = shared_folder(spark, "results-table")
    sinks.write_results(ranked_models(spark, sf_dir), path)
    return scans.read_results(spark, path)


def threshold_table(spark, sf_dir):
    """The threshold sweep written and read back."""
    path = shared_folder(spark, "threshold-table")
    sinks.write_thresholds(threshold_sweep(spark, sf_dir), path)
    return scans.read_thresholds(spark, path)


# --- retrieval -----------------------------------------------------------------------------------
def document_chunks(spark, sf_dir):
    return retrieval.split_chunks(
        given.read(spark, sf_dir, "documents"), "doc_id", "text", SENTENCE_START
    )


def term_statistics(spark, sf_dir):
    corpus = given.corpus(spark, sf_dir)
    counts = retrieval.term_counts(corpus, "chunk_id", "text")
    return metrics.rounded(retrieval.inverse_frequencies(counts, corpus.count()), 6, "idf")


def document_norms(spark, sf_dir):
    index = retrieval.build_index(given.corpus(spark, sf_dir))
    return metrics.rounded(index.norms.drop("shard"), 5, "norm")


def question_weights(spark, sf_dir):
    index = retrieval.build_index(given.corpus(spark, sf_dir))
    weights = retrieval.query_weights(index, given.questions(spark, sf_dir))
    return metrics.rounded(weights.drop("idf"), 6, "weight")


def retrieval_top_k(spark, sf_dir):
    return retrieval.retrieve(
        given.corpus(spark, sf_dir), given.questions(spark, sf_dir), pad=False
    )


def retrieval_padded(spark, sf_dir):
    """Questions that match little: the part names."""
    queries = given.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")
    )
    return retrieval.retrieve(given.corpus(spark, sf_dir), queries, k=5)


def retrieval_lists(spark, sf_dir):
    corpus = given.corpus(spark, sf_dir)
    hits = retrieval.retrieve(corpus, given.questions(spark, sf_dir), pad=False)
    packed = retrieval.pack_hits(hits, corpus)
    return packed.select("query_id", audit.policy_text(F.col("policy_evidence")).alias("hits"))


# --- signals, routing, reports --------------------------------------------------------------------
def risk_signals(spark, sf_dir):
    return _signal_rows(spark, sf_dir, "risk_signals")


def mitigating_signals(spark, sf_dir):
    return _signal_rows(spark, sf_dir, "mitigating_signals")


def _signal_rows(spark, sf_dir, name):
    rows = signals.with_signals(_features(spark, sf_dir, "delivery_status"))
    return rows.select(
        "transaction_id",
        F.size(name).alias("signal_count"),
        F.array_join(signals.signal_codes(F.col(name)), ",").alias("codes"),
        F.array_join(signals.signal_texts(F.col(name)), "\n").alias("texts"),
    )


def amount_over_average(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return rows.select(
        "transaction_id",
        percent_over(F.col("amount"), F.col("average_order_value")).alias("percent_over"),
        money_text(F.col("amount")).alias("amount_text"),
    )


def normalised_probabilities(spark, sf_dir):
    """Event values as probabilities or percentages."""
    rows = given.read(spark, sf_dir, "events").withColumn(
        "p", normalise_probability(F.col("value") - 1)
    )
    return rows.select("event_id", "p", risk_level(F.col("p")).alias("risk_level"))


def review_routing(spark, sf_dir):
    """Evidence counts as missing for every seventh transaction."""
    rows = signals.with_signals(_scored(spark, sf_dir, "delivery_status"))
    number = given.number_of()
    decided = rows.select(
        "transaction_id",
        review.review_action(
            F.col("score"),
            F.pmod(number, F.lit(7)) != 0,
            review.signals_conflict(F.col("risk_signals"), F.col("mitigating_signals")),
            review.financial_impact(F.col("amount")),
        ).alias("r"),
    )
    return decided.select("transaction_id", "r.*")


def investigation_reports(spark, sf_dir):
    rows = _investigated(spark, sf_dir)
    return rows.select(
        "transaction_id",
        "risk_probability",
        "risk_percentage",
        "risk_level",
        F.size("key_risk_signals").alias("risk_count"),
        F.size("key_mitigating_signals").alias("mitigating_count"),
        F.size("policy_evidence").alias("policy_count"),
        "recommended_action",
        F.array_join("reasoning", "\n").alias("reasoning"),
        F.col("human_review.action").alias("action"),
        F.col("human_review.priority").alias("priority"),
        F.col("human_review.human_required").alias("human_required"),
    )


def report_documents(spark, sf_dir):
    summary = [
        "transaction_id", "amount", "authentication_status", "delivery_status",
        "account_age_days", "previous_chargebacks", "previous_refunds",
    ]
    return report.report_documents(_investigated(spark, sf_dir), summary)


def _json_requests(spark, sf_dir):
    rows = _features(spark, sf_dir, "delivery_status", "refund_status")
    asked = given.score_request_fields(rows)
    return asked.select(F.to_json(F.struct("*")).alias("value"))


def request_scores(spark, sf_dir):
    """Scoring requests as JSON text: parsed, features derived, complete ones scored."""
    valid, _ = requests.score_requests(_json_requests(spark, sf_dir))
    enriched = features.derive_features(valid, "nonpositive")
    return report.score_records(enriched.withColumn("score", given.fixture_score()))


def incomplete_requests(spark, sf_dir):
    """The same requests, those that lack a field."""
    _, rejected = requests.score_requests(_json_requests(spark, sf_dir))
    return rejected.select(
        "transaction_id", F.array_join("missing_fields", ",").alias("missing_fields")
    )


def coerced_requests(spark, sf_dir):
    """Scoring requests with numbers as text, booleans as numbers and the like, made typed."""
    sent = given.sent_score_requests(_features(spark, sf_dir, "delivery_status", "refund_status"))
    valid, _ = requests.score_requests(sent)
    return valid.select(
        "request_id", "transaction_id", "amount", "payment_method", "previous_transactions",
        "account_age_days", "known_devices", "product_value", "is_weekend",
    )


def request_rejects(spark, sf_dir):
    """The same requests, those turned away, with what is missing and what is malformed."""
    sent = given.sent_score_requests(_features(spark, sf_dir, "delivery_status", "refund_status"))
    _, rejected = requests.score_requests(sent)
    return rejected.select("request_id", "error")


def _requested(spark, sf_dir):
    return requests.investigation_requests(
        given.sent_investigations(_scored(spark, sf_dir, "delivery_status"))
    )


def _reported(spark, sf_dir):
    valid, _ = _requested(spark, sf_dir)
    hit = F.array(F.struct(F.lit("P1").alias("policy"), F.lit(0.5).alias("score")))
    found = F.when(F.pmod("request_id", F.lit(3)) != 0, hit).otherwise(
        F.array().cast("array<struct<policy:string,score:double>>")
    )
    return report.investigate(valid.withColumn("policy_evidence", found))


def investigation_requests(spark, sf_dir):
    """Investigation requests as JSON, parsed, with their signals and routing.

    Every third one has no policy evidence.
    """
    return _reported(spark, sf_dir).select(
        "request_id", "transaction_id", "query", "risk_probability", "risk_level",
        F.array_join("key_risk_signals", "\n").alias("risk_texts"),
        F.array_join("key_mitigating_signals", "\n").alias("mitigating_texts"),
        F.col("human_review.action").alias("action"),
    )


def investigation_rejects(spark, sf_dir):
    _, rejected = _requested(spark, sf_dir)
    return rejected.select("request_id", "error")


def report_fields(spark, sf_dir):
    """Fields read back from the JSON reports, some of keys that no schema names."""
    written = report.report_documents(_reported(spark, sf_dir))
    # read once for all fields
    rows = written.select("transaction_id", F.inline(F.array(F.from_json("report", REPORT_FIELDS))))
    return rows.select(
        "transaction_id",
        "risk_assessment.risk_percentage",
        "risk_assessment.ml_signal",
        F.size("key_risk_signals").alias("risk_count"),
        "recommendation",
        "human_review_requirement.human_required",
        "human_review_requirement.action",
        "human_review_requirement.defense_only",
        "human_review.reason",
        "transaction_summary.amount",
        F.col("transaction_summary.channel.code").alias("channel_code"),
        F.get("transaction_summary.channel.tags", F.lit(1)).alias("second_tag"),
        "evidence_warning",
    )


# --- audit ---------------------------------------------------------------------------------------------
def rejected_reviews(spark, sf_dir):
    _, rejected = audit.split_by_decision(given.reviews(spark, sf_dir))
    return rejected.select("review_id", "decision", "error")


def resolved_reviews(spark, sf_dir):
    accepted, _ = audit.split_by_decision(given.reviews(spark, sf_dir))
    return audit.resolve_risk(accepted).select(
        "review_id", "risk_probability", "risk_percentage", "risk_level"
    )


def audit_records(spark, sf_dir):
    return _shown(_audit(spark, sf_dir))


def review_acknowledgements(spark, sf_dir):
    done = audit.acknowledgements(_audit(spark, sf_dir))
    return done.select(
        "success", "transaction_id", "risk_probability", "risk_percentage", "risk_level",
        "ai_recommendation", "decision", "reviewer_note",
        F.col("audit_record.id").alias("audit_id"),
        F.date_format("audit_record.timestamp", SECOND).alias("audit_time"),
        "message",
    )


def audit_history(spark, sf_dir):
    return _shown(audit.history(_audit(spark, sf_dir))).select(
        "id", "transaction_id", "human_decision", "risk_level", "timestamp"
    )


def audit_store(spark, sf_dir):
    """The audit table declared twice, appended in two batches of which one is replayed, and read."""
    folder = shared_folder(spark, "audit-store")
    rows = stored(_audit(spark, sf_dir), "audit")
    even = F.pmod("id", F.lit(2)) == 0
    for batch, part in (("first", rows.where(even)), ("second", rows.where(~even)), ("first", rows)):
        AuditStore(spark, folder).declare().append(part, batch)
    return _shown(AuditStore(spark, folder).read())


def audit_count(spark, sf_dir):
    return audit.record_count(_audit(spark, sf_dir))


def audit_display(spark, sf_dir):
    return audit.display(_audit(spark, sf_dir))


def _json_reviews(spark, sf_dir):
    """Events as JSON review requests: each is sent twice, with equal content but another
    identity; reasoning and evidence are text, lists or absent, also within the transaction, and
    some requests are broken."""
    events = given.read(spark, sf_dir, "events")
    n = F.col("event_id")
    case = F.pmod(n, F.lit(4))
    text = lambda before, after: F.concat(F.lit(before), F.col("event_type"), F.lit(after))
    reasoning = (
        F.when(case == 0, F.to_json(F.array(F.lit("first"), F.col("event_type"))))
        .when(case == 1, text('"plain ', '"'))
        .when(case == 2, "null")
        .otherwise("[]")
    )
    evidence_ = (
        F.when(case == 0, '[{"policy": "P1", "score": 0.5}, {"policy": "P2"}, "P3"]')
        .when(case == 2, '""')
        .otherwise('"policy text"')
    )
    inner = (
        F.when(case == 1, ', "reasoning": ["not used"]')
        .when(case == 2, text(', "reasoning": ["x", "', '", 7, true, null], "supporting_policy_evidence": '
                              '[{"policy": "N1", "score": 0.25}, "N2"], "risk_probability": "0.45"'))
        .when(case == 3, ', "ai_reasoning": {}, "investigation_reasoning": {"why": 1}, "risk_percentage": 80')
        .otherwise("")
    )
    decision = F.when(F.col("event_type") == "error", "REJECTED").otherwise("APPROVED")
    whole = F.concat(
        F.lit('{"transaction": {"transaction_id": "'), given.transaction_id(n),
        F.lit('", "amount": '), F.when(case == 1, '"10.5"').otherwise("10.5"), inner,
        F.lit('}, "decision": "'), decision, F.lit('", "ai_reasoning": '),
        reasoning, F.lit(', "policy_evidence": '), evidence_, F.lit("}"),
    )
    value = F.when(F.pmod(n, F.lit(11)) == 5, "{broken").otherwise(whole)
    twice = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("copy")
    sent = events.select("event_id", "ts", value.alias("value"), twice)
    identity = F.when(
        F.pmod(n, F.lit(13)) != 7, F.concat(n.cast("string"), F.lit("-"), F.col("copy"))
    )
    return requests.review_requests(
        sent.withColumn("request_id", identity), received=F.col("ts").cast("timestamp")
    )


def json_reviews(spark, sf_dir):
    """Audit rows of the JSON requests; equal decisions stay two."""
    good, _ = _json_reviews(spark, sf_dir)
    accepted, _ = audit.split_by_decision(good)
    done = audit.audit_records(accepted).dropDuplicates(["audit_key"])
    return _shown(done).select(
        "audit_key", "transaction_id", "amount", "ai_reasoning", "policy_evidence",
        "human_decision", "timestamp", "risk_probability", "risk_percentage", "risk_level",
    )


def json_review_rejects(spark, sf_dir):
    _, rejected = _json_reviews(spark, sf_dir)
    return rejected.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# --- models --------------------------------------------------------------------------------------------
def _evaluated(spark, sf_dir, names, **settings):
    rows = _features(spark, sf_dir)
    keys = stored(_labels(spark, sf_dir), "labels")
    parts = stored(
        split.stratified_split(rows, [0.7, 0.3], ["train", "test"], keys=keys), "model-table"
    )
    train, test = [parts.where(F.col("part") == p).drop("part") for p in ("train", "test")]
    models = modelling.fit_models(train, names, **settings)
    predicted = modelling.score_all(models, test)
    return evaluation.evaluate(predicted).drop("f1_exact")


def logistic_regression(spark, sf_dir):
    return _evaluated(spark, sf_dir, [C.LOGISTIC_REGRESSION])


def logistic_regression_check(spark, sf_dir):
    """Cells of the fitted model on the test part, and whether its coefficients are at the minimum.

    There the gradient of the weighted loss and the penalty is zero; the largest part left is looked at.
    """
    keys = stored(_labels(spark, sf_dir), "labels")
    rows = _features(spark, sf_dir)
    parts = stored(split.stratified_split(rows, [0.7, 0.3], ["train", "test"], keys=keys), "model-table")
    train, test = [parts.where(F.col("part") == p).drop("part") for p in ("train", "test")]
    name = C.LOGISTIC_REGRESSION
    models = modelling.fit_models(train, [name])
    cells = metrics.confusion_matrix(modelling.score_all(models, test), ["model"])
    left = modelling.gradient(models[name], train)
    return cells.select(
        "model",
        (F.col("true_negative") + F.col("false_positive")).alias("negatives"),
        (F.col("false_negative") + F.col("true_positive")).alias("positives"),
        (left.agg(F.max(F.abs("gradient"))).scalar() < 1e-3).alias("at_minimum"),
    )


def random_forest(spark, sf_dir):
    return _evaluated(spark, sf_dir, [C.RANDOM_FOREST])


def boosted_trees(spark, sf_dir):
    return _evaluated(spark, sf_dir, [C.BOOSTED_TREES])


# --- streams -------------------------------------------------------------------------------------------
def _order_stream(spark, sf_dir):
    schema = given.read(spark, sf_dir, "orders").schema
    return given.from_orders(jobs.read_stream(spark, sf_dir, schema, "orders.parquet"))


def _enriched_stream(spark, sf_dir):
    """The static sides are stored: every micro-batch reads them again."""
    return jobs.enrich(
        _order_stream(spark, sf_dir),
        stored(given.customers(spark, sf_dir), "customers"),
        stored(given.orders(spark, sf_dir), "orders"),
        hot=stored(skew.replication(given.transactions(spark, sf_dir), "customer_id"), "hot-customers"),
    )


def streamed_features(spark, sf_dir):
    """Orders as a stream, enriched and scored with the stand-in score."""
    folder = shared_folder(spark, "streamed-features")
    enriched = _enriched_stream(spark, sf_dir)
    scored = report.score_records(enriched.withColumn("score", given.fixture_score()))
    jobs.start_table(scored, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


def streamed_scores(spark, sf_dir):
    """Orders as a stream, scored with a model that was fitted on the train part, saved and loaded
    again, beside the scores of the same model over the table."""
    folder = shared_folder(spark, "streamed-scores")
    rows = _features(spark, sf_dir)
    keys = stored(_labels(spark, sf_dir), "labels")
    parts = stored(split.stratified_split(rows, [0.7, 0.3], ["train", "test"], keys=keys), "model-table")
    name = C.LOGISTIC_REGRESSION
    model = modelling.fit_models(parts.where(F.col("part") == "train").drop("part"), [name])[name]
    sinks.save_model(model, f"{folder}/models", name)
    newest = jobs.ModelFile(spark, f"{folder}/models", name)
    jobs.start_batches(
        _enriched_stream(spark, sf_dir), jobs.score_batches(newest, f"{folder}/table"), f"{folder}/checkpoint"
    ).awaitTermination()
    streamed = spark.read.parquet(f"{folder}/table").drop("batch_id")
    batch = report.score_records(modelling.score(model, parts.drop("part")), name)
    both = streamed.join(batch.select("transaction_id", *(F.col(c).alias(f"_{c}") for c in batch.columns[1:])), "transaction_id", "full")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in batch.columns[1:]])
    share = F.col("risk_probability")
    return both.select(
        "transaction_id", "model", same.alias("same_as_table"), share.between(0, 1).alias("is_probability"),
        # the share is rounded, the band is not
        F.col("risk_level").isin(risk_level(share - 5e-5), risk_level(share + 5e-5)).alias("in_its_band"),
    )


def streamed_reviews(spark, sf_dir):
    """Review events as a stream into the audit table."""
    folder = shared_folder(spark, "streamed-reviews")
    schema = given.read(spark, sf_dir, "events").schema
    events = jobs.read_stream(spark, sf_dir, schema, "events.parquet")
    asked = given.review_events(events, stored(given.transactions(spark, sf_dir), "transactions"))
    store = AuditStore(spark, f"{folder}/audit").declare()
    jobs.start_batches(
        asked, jobs.review_batches(store, folder), f"{folder}/checkpoint"
    ).awaitTermination()
    return _shown(store.read())


def streamed_investigations(spark, sf_dir):
    """Orders as a stream of investigation requests, each with one of the given questions."""
    folder = shared_folder(spark, "streamed-investigations")
    corpus = given.corpus(spark, sf_dir)
    retrieval.build_index(corpus, folder=f"{folder}/index")
    index = retrieval.load_index(spark, f"{folder}/index")
    enriched = _enriched_stream(spark, sf_dir)
    questions = stored(given.questions(spark, sf_dir), "questions")
    n_questions = questions.count()
    number = given.number_of()
    asked = enriched.withColumns(
        {
            "risk_probability": given.fixture_score(),
            "query_id": F.pmod(number, F.lit(n_questions)),
        }
    ).join(questions, "query_id", "left")
    titled = corpus.select(
        "chunk_id", F.concat(F.lit("DOC_"), F.col("chunk_id").cast("string")).alias("text")
    )
    jobs.start_batches(
        asked, jobs.investigate_batches(titled, index, folder), f"{folder}/checkpoint"
    ).awaitTermination()
    done = spark.read.parquet(f"{folder}/reports")
    return done.select(
        "transaction_id", "risk_probability", "risk_level", "recommended_action",
        F.size("policy_evidence").alias("policy_count"),
        F.col("human_review.action").alias("action"),
    )


ALL: list[Callable[[SparkSession, str], DataFrame]] = [
    risk_by_band, table_counts, customer_profile, order_table, chargeback_claims,
    evidence_records, disputed_ids, dispute_labels, customer_join, order_join,
    calendar_features, feature_table, request_features, filled_feature_table,
    model_input, missing_cells, label_distribution, label_summary, class_weights,
    column_medians, column_modes, column_categories, column_scales, imputed_scaled,
    split_70_30, split_70_15_15, score_records, confusion_matrix,
    classification_metrics, roc_auc, threshold_sweep, best_threshold,
    false_positive_volume, model_evaluations, one_model_evaluation, ranked_models, selected_model,
    results_document, results_sizes, results_fields, csv_customers, csv_model_table, results_table,
    threshold_table, document_chunks, term_statistics, document_norms,
    question_weights, retrieval_top_k, retrieval_padded,
    retrieval_lists, risk_signals, mitigating_signals, amount_over_average,
    normalised_probabilities, review_routing, investigation_reports,
    report_documents, request_scores, incomplete_requests, coerced_requests,
    request_rejects, investigation_requests, investigation_rejects, report_fields, rejected_reviews, resolved_reviews,
    audit_records, review_acknowledgements, audit_history, audit_store, audit_count,
    audit_display, json_reviews, json_review_rejects,
    logistic_regression, logistic_regression_check, random_forest, boosted_trees, streamed_features,
    streamed_scores, streamed_reviews, streamed_investigations,
]


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in ALL}
