"""Evaluation tables. Predictions are counted once (actual, predicted); everything else is
arithmetic on those few counts or one aggregate over the rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.functions.columns import half_even

# The bounds of the verdicts.
OVERFIT_GAP = 0.15
GOOD_GAP = 0.05
WEAK_ACCURACY = 0.6
LOSS_GAP = 0.3
HIGH_LOSS = 0.5
TIE = 0.005
ERRORS = ("mae", "rmse")


def _counted(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def classification_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction",
                           digits: int = 3) -> DataFrame:
    """One row: accuracy, macro precision and macro recall.

    The macro means run over the labels found among the truths or the predictions; a label
    never predicted (or never true) counts as 0.
    """
    n = _counted(pred, actual, predicted)
    sides = n.select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit_n")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("true_n"),
                 F.col("n").alias("pred_n"), F.lit(0).cast("bigint").alias("hit_n")))))
    per_label = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("true_n", "pred_n", "hit_n")])

    def ratio(total: str) -> Column:
        return F.coalesce(F.try_divide(F.col("hit_n").cast("double"), F.col(total).cast("double")), F.lit(0.0))

    return per_label.agg(
        half_even(F.try_divide(F.sum("hit_n").cast("double"), F.sum("true_n").cast("double")), digits).alias("accuracy"),
        half_even(F.avg(ratio("pred_n")), digits).alias("precision"),
        half_even(F.avg(ratio("true_n")), digits).alias("recall"))


def confusion(pred: DataFrame, labels: Sequence, actual: str = "label", predicted: str = "prediction",
              normalize: bool = False) -> DataFrame:
    """(actual, predicted, n[, pct]) for every pair of ``labels``, zeros included.

    ``labels`` are the classes of the whole target. With ``normalize``, pct is
    the share of the actual class, to one digit; an empty class gives 0.
    """
    kind = pred.schema[actual].dataType.simpleString()
    spark = pred.sparkSession
    rows = spark.createDataFrame([(a,) for a in labels], f"actual {kind}")
    grid = rows.withColumn("predicted", F.explode(F.array(*[F.lit(b).cast(kind) for b in labels])))
    n = _counted(pred, actual, predicted)
    n = n.select(F.col("actual").cast(kind), F.col("predicted").cast(kind), "n")
    table = grid.join(n, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    if not normalize:
        return table
    row = F.sum("n").over(Window.partitionBy("actual"))       # one row per class in each group
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), row.cast("double")), F.lit(0.0))
    return table.withColumn("pct", half_even(share * 100, 1))


def regression_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction",
                       digits: int = 3) -> DataFrame:
    """One row: R2, MAE and RMSE. A constant target gives R2 1 if predicted perfectly, else 0."""
    both = pred.select(F.col(actual).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"))
    both = both.filter("y is not null and p is not null")
    error = F.col("y") - F.col("p")
    sums = both.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("y").alias("var"))
    r2 = F.when(F.col("var") > 0, 1 - F.try_divide(F.col("mse"), F.col("var"))).when(
        F.col("mse") == 0, F.lit(1.0)).when(F.col("mse").isNotNull(), F.lit(0.0))
    return sums.select(half_even(r2, digits).alias("r2"), half_even(F.col("mae"), digits).alias("mae"),
                       half_even(F.sqrt("mse"), digits).alias("rmse"))


def diagnose_learning_curve(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """([by], gap, val, verdict): the curve's last point decides, first match wins."""
    last = curve.groupBy(*by).agg(
        F.max_by("train_mean", "train_size").alias("train"), F.max_by("val_mean", "train_size").alias("val"),
        F.max("scoring").alias("scoring"))
    gap, val = half_even(F.col("train") - F.col("val"), 3), half_even(F.col("val"), 3)
    verdict = (F.when(gap > OVERFIT_GAP, "overfit")
               .when((F.col("scoring") == "accuracy") & (val < WEAK_ACCURACY), "underfit")
               .when(gap <= GOOD_GAP, "good").otherwise("moderate"))
    return last.select(*by, gap.alias("gap"), val.alias("val"), verdict.alias("verdict"))


def diagnose_loss(history: DataFrame, max_epochs: int, by: Sequence[str] = ()) -> DataFrame:
    """([by], epochs, gap, verdict) from the last epoch of a loss history, first match wins."""
    last = history.groupBy(*by).agg(
        F.max("epoch").alias("epochs"), F.max_by("train_loss", "epoch").alias("train"),
        F.max_by("val_loss", "epoch").alias("val"))
    gap = half_even(F.abs(F.col("train") - F.col("val")), 4)
    verdict = (F.when(F.col("epochs") < max_epochs, "early_stopped").when(gap > LOSS_GAP, "overfit")
               .when((F.col("train") > HIGH_LOSS) & (F.col("val") > HIGH_LOSS), "underfit").otherwise("ok"))
    return last.select(*by, "epochs", gap.alias("gap"), verdict.alias("verdict"))


def best_epoch(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """([by], best_epoch, best_val_loss): the first epoch with the lowest validation loss."""
    return history.groupBy(*by).agg(F.min(F.struct("val_loss", "epoch")).alias("b")).select(
        *by, F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_val_loss"))


def metrics_long(wide: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row metrics table."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.inline(F.array(*pairs)))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta, winner) over the metrics both runs have.

    ``a`` and ``b`` are (metric, value) tables. Differences under 0.005 are a tie, else the
    better value wins: the smaller of an error, the larger of anything else.
    """
    both = (a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
            .withColumn("delta", F.col("a") - F.col("b")))
    better = F.when(F.col("metric").isin(*ERRORS), -F.col("delta")).otherwise(F.col("delta"))
    winner = F.when(F.abs("delta") < TIE, "tie").when(better > 0, "a").otherwise("b")
    return both.withColumn("winner", winner)


def rollup_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """([by], mean, std): mean and population std of the fold scores."""
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Adds the running maximum over a trial log (one row per trial, so a single group is small)."""
    upto = Window.partitionBy(F.lit(1)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best", F.max("value").over(upto))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
