from __future__ import annotations

import random

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from disputeflow import constants as C
from disputeflow.operators import metrics, selection
from disputeflow.plans import evaluation

# Published counts and what follows from them: tn, fp, fn, tp.
MODELS = {
    "Logistic Regression": ((772, 555, 109, 64), (0.5573, 0.1034, 0.3699, 0.1616, 1367500)),
    "Random Forest": ((1253, 74, 162, 11), (0.8427, 0.1294, 0.0636, 0.0853, 1657000)),
    "XGBoost": ((1246, 81, 161, 12), (0.8387, 0.1290, 0.0694, 0.0902, 1650500)),
}
SWEEP = {
    0.3: ((0, 664, 0, 86), (0.1147, 0.1147, 1.0, 0.2057, 332000)),
    0.4: ((0, 664, 0, 86), (0.1147, 0.1147, 1.0, 0.2057, 332000)),
    0.5: ((420, 244, 59, 27), (0.5960, 0.0996, 0.3140, 0.1513, 712000)),
    0.6: ((664, 0, 86, 0), (0.8853, 0.0, 0.0, 0.0, 860000)),
    0.7: ((664, 0, 86, 0), (0.8853, 0.0, 0.0, 0.0, 860000)),
    0.8: ((664, 0, 86, 0), (0.8853, 0.0, 0.0, 0.0, 860000)),
    0.9: ((664, 0, 86, 0), (0.8853, 0.0, 0.0, 0.0, 860000)),
}


def scored(spark, groups):
    """(label, score, how often)"""
    data = [(label, score, 10.0) for label, score, n in groups for _ in range(n)]
    return spark.createDataFrame(data, "chargeback_label int, score double, amount double")


def values(row):
    return tuple(round(row[c], 4) for c in
                 ("accuracy", "precision", "recall", "f1", "estimated_cost"))


def test_published_models(spark):
    counts = spark.createDataFrame(
        [(name, i, *cells) for i, (name, (cells, _)) in enumerate(MODELS.items())],
        "model string, position int, true_negative long, false_positive long, "
        "false_negative long, true_positive long",
    )
    quality = metrics.with_quality(counts)
    got = {r["model"]: values(r) for r in rows(quality)}
    assert got == {name: expected for name, (_, expected) in MODELS.items()}
    assert one(metrics.best_model(quality))["model"] == "Logistic Regression"
    assert [r["model"] for r in rows(metrics.rank_models(quality))] == [
        "Logistic Regression", "XGBoost", "Random Forest"
    ]


def test_published_sweep(spark):
    table = scored(spark, [(0, 0.45, 420), (0, 0.55, 244), (1, 0.42, 59), (1, 0.58, 27)])
    sweep = metrics.threshold_sweep(table)
    got = {r["threshold"]: (tuple(r[c] for c in metrics.COUNTS), values(r)) for r in rows(sweep)}
    assert got == SWEEP
    assert one(metrics.best_threshold(sweep))["threshold"] == 0.3


def test_sweep_properties(spark):
    generator = random.Random(3)
    table = scored(
        spark, [(generator.randint(0, 1), generator.random(), 1) for _ in range(400)]
    )
    sweep = sorted(rows(metrics.threshold_sweep(table)), key=lambda r: r["threshold"])
    assert all(sum(r[c] for c in metrics.COUNTS) == 400 for r in sweep)
    recalls = [r["recall"] for r in sweep]
    assert recalls == sorted(recalls, reverse=True)
    single = one(metrics.confusion_matrix(metrics.predict(table, 0.6)))
    assert single == {c: sweep[3][c] for c in metrics.COUNTS}


def test_one_class_still_gives_four_cells(spark):
    table = scored(spark, [(0, 0.1, 3)])
    assert one(metrics.confusion_matrix(metrics.predict(table))) == {
        "true_negative": 3, "false_positive": 0, "false_negative": 0, "true_positive": 0
    }


@pytest.mark.parametrize("score", ["NULL", "double('NaN')"])
def test_rows_without_a_score_are_not_lost(spark, score):
    table = spark.sql(f"SELECT 1 AS chargeback_label, 0.5D AS score UNION ALL SELECT 0, {score}")
    with pytest.raises(Exception, match="a row has no score"):
        metrics.confusion_matrix(metrics.predict(table)).collect()


def brute_auc(data):
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 6, 17])
def test_auc(spark, digits):
    generator = random.Random(11)
    data = [(generator.randint(0, 1), round(generator.random() ** 3, digits))
            for _ in range(500)]
    frame = spark.createDataFrame(data, "chargeback_label int, score double")
    got = metrics.roc_auc(metrics.score_counts(frame)).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(data), abs=1e-12)
    turned = frame.withColumn("score", -frame["score"])
    back = metrics.roc_auc(metrics.score_counts(turned)).first()["roc_auc"]
    assert back == pytest.approx(1 - got, abs=1e-12)


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_no_task_ranks_more_than_a_digit_holds(spark, n):
    """However many scores there are, a parent on any level has at most 65,536 nodes."""
    frame = spark.range(n).select(
        (F.col("id") % 3 == 0).cast("int").alias("chargeback_label"), (F.col("id") / n).alias("score")
    )
    scored_bits = selection.with_ordered_bits(frame, "score")
    for digit in range(1, 5):
        parents = scored_bits.select(F.shiftright("bits", 16 * (digit - 1)).alias("node")).distinct()
        most = parents.groupBy(F.shiftright("node", 16)).count().agg(F.max("count")).first()[0]
        assert most <= selection.BINS
    counts = metrics.score_counts(frame)
    got = metrics.roc_auc(counts).first()["roc_auc"]
    pos = [i for i in range(n) if i % 3 == 0]
    wins = sum(i - k for k, i in enumerate(pos))  # negatives below each positive
    assert got == pytest.approx(wins / (len(pos) * (n - len(pos))), abs=1e-12)
    assert "percentile" not in metrics.roc_auc(counts)._jdf.queryExecution().toString()


def test_auc_by_group_without_scores(spark):
    data = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, None), ("b", 1, 0.9), ("b", 0, -0.0), ("b", 0, 0.0), ("c", 0, None)]
    frame = spark.createDataFrame(data, "model string, chargeback_label int, score double")
    got = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(metrics.score_counts(frame, ["model"]), ["model"]).collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_auc_of_one_class(spark):
    counts = metrics.score_counts(scored(spark, [(1, 0.2, 4)]))
    assert metrics.roc_auc(counts).first()["roc_auc"] is None


def test_false_positive_volume(spark):
    table = metrics.predict(scored(spark, [(0, 0.9, 3), (0, 0.1, 2), (1, 0.9, 5)]))
    assert one(metrics.false_positive_volume(table)) == {"false_positives": 3, "fp_amount": 30.0}


def test_evaluation_document(spark):
    data = []
    for i, (name, ((tn, fp, fn, tp), _)) in enumerate(MODELS.items()):
        for label, guess, n in ((0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)):
            data += [(name, i, label, float(guess), guess, 2.5)] * n
    predicted = spark.createDataFrame(
        data, "model string, position int, chargeback_label int, score double, "
        "prediction int, amount double"
    )
    evaluations = evaluation.evaluate(predicted)
    chosen = one(evaluation.selection(evaluations))
    assert chosen["model"] == C.LOGISTIC_REGRESSION
    assert "(0.1616)" in chosen["selection_reason"] and "₹1,367,500" in chosen["selection_reason"]
    parts = spark.createDataFrame(
        [(0, "train")] * 6 + [(1, "train"), (0, "test"), (1, "test")],
        "chargeback_label int, part string",
    )
    document = one(evaluation.results_document(parts, parts, evaluations))
    assert document["dataset_metadata"]["total_dataset_size"] == 9
    assert document["dataset_metadata"]["held_out_test_set_size"] == 2
    assert [m["model_name"] for m in document["model_evaluations"]] == C.MODEL_NAMES
    assert document["model_evaluations"][1]["false_positive_friction_cost"] == 37000.0
    assert document["model_evaluations"][0]["fp_actual_affected_amount"] == 555 * 2.5
    assert document["selected_production_model"]["test_false_negatives"] == 109
