"""Training jobs: compare the models, then find the cheapest threshold of the best."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from disputeflow import constants as C
from disputeflow.operators import metrics
from disputeflow.plans import evaluation, modelling
from disputeflow.session import stored
from disputeflow.sources import sinks


def train_and_compare(
    train: DataFrame,
    test: DataFrame,
    folder: str,
    names: list[str] = C.MODEL_NAMES,
    drop_device: bool = True,
    **settings,
) -> DataFrame:
    """Fits and saves every model; returns their metrics, best F1 first."""
    models = modelling.fit_models(train, names, drop_device, **settings)
    for name, model in models.items():
        sinks.save_model(model, folder, name)
    evaluations = evaluation.evaluate(modelling.score_all(models, test))
    return metrics.rank_models(evaluations.withColumn("f1", F.col("f1_exact")))


def recommend_threshold(
    results: DataFrame,
    test: DataFrame,
    folder: str,
    thresholds: list[float] = C.THRESHOLDS,
) -> tuple[str, DataFrame, DataFrame]:
    """(best model, threshold table, cheapest row) for the saved model with the best F1,
    the first listed of equal ones.

    The scored rows are reduced to label and score and stored, as the sweep and the
    choice both need them.
    """
    listed = F.array_position(F.array(*map(F.lit, C.MODEL_NAMES)), F.col("model"))
    best = results.orderBy(F.desc("f1"), listed).select("model").first()["model"]
    scored = modelling.score(sinks.load_model(folder, best), test).select(C.TARGET, "score")
    sweep = metrics.threshold_sweep(stored(scored, "scored"), thresholds)
    return best, sweep.orderBy("threshold"), metrics.best_threshold(sweep)
