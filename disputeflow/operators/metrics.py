"""Classification metrics, money cost, threshold sweep and model choice.

Scored rows hold ``chargeback_label`` (0/1), ``score`` and, where money is asked
for, ``amount``; ``prediction`` is 0/1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from disputeflow import constants as C
from disputeflow.operators.selection import BITS, DIGIT, known, with_ordered_bits

COUNTS = ["true_negative", "false_positive", "false_negative", "true_positive"]


def predict(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``prediction`` 0 or 1. A row without a score would be in no cell of the confusion matrix,
    so that the four would not add up: it fails the job."""
    known = F.col("score").isNotNull() & ~F.isnan("score")
    decided = F.when(known, (F.col("score") >= threshold).cast("int"))
    return scored.withColumn("prediction", F.coalesce(decided, F.raise_error(F.lit("a row has no score"))))


def confusion_matrix(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four counts, always all of them, per ``by`` group."""
    label, guess = F.col(C.TARGET), F.col("prediction")
    return predicted.groupBy(*(by or [])).agg(
        F.count_if((label == 0) & (guess == 0)).alias("true_negative"),
        F.count_if((label == 0) & (guess == 1)).alias("false_positive"),
        F.count_if((label == 1) & (guess == 0)).alias("false_negative"),
        F.count_if((label == 1) & (guess == 1)).alias("true_positive"),
    )


def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_quality(
    counts: DataFrame,
    fp_cost: float = C.FALSE_POSITIVE_COST,
    fn_cost: float = C.FALSE_NEGATIVE_COST,
) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and money cost."""
    tn, fp, fn, tp = [F.col(c) for c in COUNTS]
    return counts.withColumns(
        {
            "accuracy": _share(tp + tn, tn + fp + fn + tp),
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1": _share(tp * 2, tp * 2 + fp + fn),
            "estimated_cost": fp * F.lit(fp_cost) + fn * F.lit(fn_cost),
        }
    )


def rounded(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in names})


def false_positive_volume(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Amount on wrongly flagged transactions, summed as decimals."""
    wrong = (F.col(C.TARGET) == 0) & (F.col("prediction") == 1)
    money = F.sum(F.when(wrong, F.col("amount").cast("decimal(18,2)")))
    return predicted.groupBy(*(by or [])).agg(
        F.count_if(wrong).alias("false_positives"),
        F.coalesce(money.cast("double"), F.lit(0.0)).alias("fp_amount"),
    )


def threshold_sweep(
    scored: DataFrame,
    thresholds: list[float] = C.THRESHOLDS,
    fp_cost: float = C.FALSE_POSITIVE_COST,
    fn_cost: float = C.FALSE_NEGATIVE_COST,
) -> DataFrame:
    """One metric row per threshold from a single pass.

    Rows first collapse to (label, number of thresholds passed), at most
    2 * (thresholds + 1) groups; only those few are expanded per threshold.
    """
    steps = sorted(thresholds)
    passed = sum(((F.col("score") >= t).cast("int") for t in steps), F.lit(0))
    groups = scored.groupBy(F.col(C.TARGET), passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("needs"))
          for i, t in enumerate(steps)]
    )
    each = groups.withColumn("step", F.explode(grid)).select(
        C.TARGET,
        "n",
        "step.threshold",
        (F.col("passed") >= F.col("step.needs")).cast("int").alias("prediction"),
    )

    def cell(label: int, guess: int) -> Column:
        hit = (F.col(C.TARGET) == label) & (F.col("prediction") == guess)
        return F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0)))

    counts = each.groupBy("threshold").agg(
        cell(0, 0).alias("true_negative"),
        cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"),
        cell(1, 1).alias("true_positive"),
    )
    return with_quality(counts, fp_cost, fn_cost)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Cheapest threshold; the lower one on a tie."""
    return sweep.orderBy("estimated_cost", "threshold").limit(1)


def rank_models(results: DataFrame) -> DataFrame:
    """Best F1 first; listing order (``position``) on a tie."""
    return results.orderBy(F.desc("f1"), F.asc("position"))


def best_model(results: DataFrame) -> DataFrame:
    return rank_models(results).limit(1)


def score_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score; combines map-side."""
    return scored.groupBy(*(by or []), "score").agg(
        F.count_if(F.col(C.TARGET) == 1).alias("pos"),
        F.count_if(F.col(C.TARGET) == 0).alias("neg"),
    )


def roc_auc(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve of ``score_counts``, ties counting one half.

    Scores are put in order as 64-bit integers of four digits. On each level, from the last digit
    to the first, every node adds the negatives of earlier nodes of its parent to its wins, and
    all of a parent's nodes become one. A parent has at most 65,536 nodes and the number of
    parents follows the data, so no task ranks more than that at once, and no sketch is needed.
    Labels of one class only give NULL, NULL scores do not count.
    """
    by = by or []
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    level = with_ordered_bits(counts.where(known("score", counts)), "score", "node").select(*by, "node", "pos", "neg")
    # twice the Mann-Whitney count, kept in whole numbers
    level = level.withColumn("wins", (whole("pos") * whole("neg")).cast("decimal(38,0)"))
    for digit in range(BITS // DIGIT, 0, -1):
        parent = F.shiftright("node", DIGIT) if digit > 1 else F.lit(0).cast("bigint")
        level = level.withColumn("parent", parent)
        earlier = Window.partitionBy(*by, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("earlier", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
        gained = (whole("pos") * whole("earlier") * 2).cast("decimal(38,0)")
        level = level.groupBy(*by, F.col("parent").alias("node")).agg(
            F.sum(F.col("wins") + gained).cast("decimal(38,0)").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
    pairs = F.lit(2.0) * F.col("pos").cast("double") * F.col("neg").cast("double")
    return level.select(*by, F.try_divide(F.col("wins").cast("double"), pairs).alias("roc_auc"))
