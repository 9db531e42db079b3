from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from disputeflow import constants as C
from disputeflow.plans import evaluation, modelling
from disputeflow.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    generator = np.random.default_rng(8)
    n = 400
    a = generator.normal(size=n)
    b = generator.exponential(size=n)
    kind = generator.choice(["x", "y", "z"], size=n)
    y = (a + (kind == "z") + generator.normal(size=n) > 1).astype(int)
    data = [
        (f"T{i}", None if i % 17 == 0 else float(a[i]), float(b[i]), 7.0,
         None if i % 23 == 0 else str(kind[i]), "device", float(b[i] * 10), int(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(
        data, "transaction_id string, a double, b double, constant double, kind string, "
        "device_id string, amount double, chargeback_label int"
    ).repartition(4).persist()


def test_preprocessing(spark, table):
    train = table.where("chargeback_label >= 0")
    fitted = modelling.Preprocessor(["a", "b", "constant"], ["kind"]).fit(train)
    matrix = np.array([r[0] for r in fitted.transform(train).select(
        vector_to_array("features")).collect()])
    assert matrix.shape == (400, 6)
    assert np.allclose(matrix[:, :2].mean(0), 0) and np.allclose(matrix[:, :2].std(0), 1)
    assert not matrix[:, 2].any()  # the constant column
    assert (matrix[:, 3:].sum(1) == 1).all()  # a missing kind becomes the most frequent
    new = spark.createDataFrame(
        [(None, float("nan"), 7.0, "never seen")], "a double, b double, constant double, kind string"
    )
    out = fitted.transform(new).select(vector_to_array("features")).first()[0]
    assert out[3:] == [0.0, 0.0, 0.0] and np.isfinite(out).all()


def test_device_is_an_option(spark, table):
    assert modelling.preprocessor_for(table).categorical == ["kind"]
    assert modelling.preprocessor_for(table, False).categorical == ["kind", "device_id"]


@pytest.mark.parametrize("limit", [0, 3])
def test_categories_in_a_table_give_the_same_vectors(spark, table, monkeypatch, tmp_path, limit):
    """Columns whose categories stay in a table, saved, loaded and used on unseen values."""
    train = table.withColumn("device_id", F.concat(F.lit("d"), (F.col("b") * 50).cast("int").cast("string")))
    plain = modelling.Preprocessor(["a", "b"], ["kind", "device_id"]).fit(train)
    monkeypatch.setattr(modelling, "DRIVER_CATEGORIES", limit)
    tabled = modelling.Preprocessor(["a", "b"], ["kind", "device_id"]).fit(train)
    indexers = [s for s in tabled.stages if type(s).__name__ == "StringIndexerModel"]
    assert len(indexers) == (limit > 0) and all(s.getInputCols() == ["kind__filled"] for s in indexers)
    path = str(tmp_path / "model")
    tabled.write().overwrite().save(path)
    unseen = spark.createDataFrame([("new", 0.5, 0.5, "never", "seen")], "transaction_id string, a double, b double, kind string, device_id string")
    rows_ = train.select("transaction_id", "a", "b", "kind", "device_id").unionByName(unseen)

    def vectors(model):
        return {r[0]: r[1] for r in model.transform(rows_).select("transaction_id", "features").collect()}

    want, got = vectors(plain), vectors(PipelineModel.load(path))
    assert want.keys() == got.keys() and all(want[k] == got[k] for k in want)
    assert got["new"].numNonzeros() <= 2 and got["new"].size == got["T1"].size


def test_dictionary_is_in_order(spark):
    values = [f"v{i * 7919 % 5000}" for i in range(5000)] + ["", "é", "Z"]
    found = modelling.dictionary(spark.createDataFrame([(v,) for v in values], "value string").repartition(5))
    got = {r["value"]: r["index"] for r in found.collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=str.encode))}


def newton(x, y, weight, c=1.0):
    """Minimum of c * sum(w * loss) + |b|^2 / 2 with a free intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        gradient = c * x.T @ (weight * (p - y)) + ridge @ b
        hessian = c * (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        b -= np.linalg.solve(hessian + 1e-10 * np.eye(len(b)), gradient)
    return b


def test_logistic_regression_equals_newton(spark, table):
    model = modelling.fit_models(table, [C.LOGISTIC_REGRESSION])[C.LOGISTIC_REGRESSION]
    scored = modelling.score(model, table)
    ready = model.stages[0].transform(table).select("transaction_id", C.TARGET,
                                                    vector_to_array("features").alias("v"))
    data = rows(ready.join(scored.select("transaction_id", "score"), "transaction_id"))
    x = np.array([r["v"] for r in data])
    y = np.array([r[C.TARGET] for r in data])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    b = newton(x, y, weight)
    expected = 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))
    assert np.allclose([r["score"] for r in data], expected, atol=1e-3)


def test_gradient_is_summed_in_vectors(spark, table, capsys):
    model = modelling.fit_models(table, [C.LOGISTIC_REGRESSION], max_iter=2)[C.LOGISTIC_REGRESSION]
    ready = rows(model.stages[0].transform(table).select(C.TARGET, vector_to_array("features").alias("v")))
    x, y = np.array([[*r["v"], 1.0] for r in ready]), np.array([r[C.TARGET] for r in ready])
    fitted = model.stages[-1].stages[-1]
    b = np.append(fitted.coefficients.toArray(), fitted.intercept)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-x @ b))
    expected = x.T @ (weight * (p - y)) / weight.sum() + fitted.getRegParam() * np.append(b[:-1], 0)
    left = modelling.gradient(model, table)
    capsys.readouterr()
    left.explain()
    plan = capsys.readouterr().out
    # the only row that is taken apart is that of the sums
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")
    got = [r["gradient"] for r in sorted(rows(left), key=lambda r: r["place"])]
    assert np.allclose(got, expected, atol=1e-12) and np.abs(expected).max() > 1e-4


def test_all_models_and_saving(spark, table, tmp_path):
    models = modelling.fit_models(
        table, n_trees=5, forest_depth=4, boost_rounds=3, boost_depth=2
    )
    assert list(models) == C.MODEL_NAMES
    predicted = modelling.score_all(models, table)
    assert predicted.where(~F.col("score").between(0, 1)).count() == 0
    evaluations = {r["model"]: r for r in rows(evaluation.evaluate(predicted))}
    assert all(0.5 < r["roc_auc"] <= 1 for r in evaluations.values())
    assert all(
        sum(r[c] for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
        == 400
        for r in evaluations.values()
    )
    path = sinks.save_model(models[C.RANDOM_FOREST], str(tmp_path), C.RANDOM_FOREST)
    assert path.endswith("/random_forest")
    back = sinks.load_model(str(tmp_path), C.RANDOM_FOREST)
    one = modelling.score(models[C.RANDOM_FOREST], table).select("transaction_id", "score")
    two = modelling.score(back, table).select("transaction_id", "score")
    assert one.exceptAll(two).count() == 0


def test_published_settings():
    settings = modelling.classifiers(100)
    logistic, forest, boosted = [settings[n] for n in C.MODEL_NAMES]
    assert (logistic.getRegParam(), logistic.getMaxIter()) == (0.01, 1000)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (300, 12, 3)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (300, 6, 0.05)


def test_training_needs_both_labels(spark, table):
    with pytest.raises(ValueError, match="both labels"):
        modelling.fit_models(table.where("chargeback_label = 0"), [C.LOGISTIC_REGRESSION])


def test_training_job(spark, table, tmp_path):
    from disputeflow.plans import training

    folder = str(tmp_path / "models")
    results = training.train_and_compare(
        table, table, folder, [C.LOGISTIC_REGRESSION, C.RANDOM_FOREST],
        n_trees=5, forest_depth=4,
    )
    ranked = [r["f1"] for r in rows(results)]
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 2
    sinks.write_results(
        results.select("model", "accuracy", "precision", "recall", "f1"), str(tmp_path / "results")
    )
    from disputeflow.sources.scans import read_results

    best, sweep, cheapest = training.recommend_threshold(
        read_results(spark, str(tmp_path / "results")), table, folder
    )
    assert best == rows(results)[0]["model"]
    found = rows(sweep)
    assert [r["threshold"] for r in found] == C.THRESHOLDS
    assert rows(cheapest)[0]["estimated_cost"] == min(r["estimated_cost"] for r in found)
    assert results.where(F.col("model") == best).count() == 1
