"""Exact classification metrics, curves, threshold sweep and cost policy.

Everything that needs an order over scores works on counted distinct scores with
the range-partitioned running sums of :mod:`keelson.functions.ranked`; everything
that depends on thresholds only works on a histogram over the threshold grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.ranked import running_totals
from keelson.functions.scalars import ratio

# fixed values: threshold grid, costs, bins, rounding
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.05, 0.95, 0.01
OFFER_COST = 50.0
LOST_COST = 500.0
CALIBRATION_BINS = 10
DIGITS = 4


def grid(start: float = SWEEP_START, stop: float = SWEEP_STOP, step: float = SWEEP_STEP) -> list[float]:
    """The threshold grid; kept unrounded for comparisons."""
    return [float(t) for t in np.arange(start, stop + step / 2, step)]


def score_of(p: str) -> Column:
    """The score as a double; a null or NaN is an error, so that no metric quietly leaves rows out."""
    value = F.col(p).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{p} holds a null or NaN score"))).otherwise(value)


def confusion(df: DataFrame, p: str, y: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    hit, true = score_of(p) >= F.lit(float(threshold)), F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(~hit & ~true).alias("true_negatives"),
        F.count_if(hit & ~true).alias("false_positives"),
        F.count_if(~hit & true).alias("false_negatives"),
        F.count_if(hit & true).alias("true_positives"),
    )


def with_rates(counts: DataFrame, digits: int = DIGITS) -> DataFrame:
    """accuracy, precision, recall, f1 (0 for empty denominators) and predicted count."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    return counts.withColumns(
        {
            "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), digits),
            "precision": F.round(ratio(tp, tp + fp), digits),
            "recall": F.round(ratio(tp, tp + fn), digits),
            "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), digits),
            "predicted": tp + fp,
        }
    )


def cost(fp: Column, fn: Column, offer: float = OFFER_COST, lost: float = LOST_COST) -> Column:
    return (fp * F.lit(float(offer)) + fn * F.lit(float(lost))).cast("long")


def score_points(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest: pos, neg and their running sums."""
    counted = (
        df.withColumn(p, score_of(p))
        .groupBy(*by, p)
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    )
    return running_totals(counted, list(by), p, ["pos", "neg"], descending=True)


def with_class_totals(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    totals = points.groupBy(*by).agg(F.max("cum_pos").alias("all_pos"), F.max("cum_neg").alias("all_neg"))
    if by:
        return points.join(totals, list(by))
    packed = totals.select(F.struct("all_pos", "all_neg").alias("t")).scalar()
    return points.withColumns({"all_pos": packed.getField("all_pos"), "all_neg": packed.getField("all_neg")})


def areas(points: DataFrame, by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum); null for one class."""
    won = F.sum(F.col("neg") * (F.col("cum_pos") - 0.5 * F.col("pos")))
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    both = (F.max("cum_pos") > 0) & (F.max("cum_neg") > 0)
    return points.groupBy(*by).agg(
        F.when(both, F.round(F.try_divide(won, F.max("cum_pos") * F.max("cum_neg").cast("double")), digits)).alias("roc_auc"),
        F.when(both, F.round(F.try_divide(step, F.max("cum_pos")), digits)).alias("pr_auc"),
    )


def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def report(df: DataFrame, p: str, y: str, threshold: float, by: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """All metrics at one threshold, one row per group."""
    counts = with_rates(confusion(df, p, y, threshold, by), digits)
    error = df.groupBy(*by).agg(F.round(brier(p, y), digits).alias("brier_score"))
    area = areas(score_points(df, p, y, by), by, digits)
    if by:
        joined = counts.join(error, list(by)).join(area, list(by))
    else:
        packed = area.select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
        joined = counts.withColumns(
            {
                "brier_score": error.scalar(),
                "roc_auc": packed.getField("roc_auc"),
                "pr_auc": packed.getField("pr_auc"),
            }
        )
    return joined.withColumn("threshold", F.lit(float(threshold)))


def report_counts(counted: DataFrame, by: Sequence[str], threshold: float = 0.5, digits: int = DIGITS) -> DataFrame:
    """The rates and areas of :func:`report` from distinct scores ``p`` with their counts ``pos`` and ``neg``."""
    hit, none = F.col("p") >= F.lit(float(threshold)), F.lit(0).cast("long")
    counts = counted.groupBy(*by).agg(
        F.sum(F.when(hit, none).otherwise(F.col("neg"))).alias("true_negatives"),
        F.sum(F.when(hit, F.col("neg")).otherwise(none)).alias("false_positives"),
        F.sum(F.when(hit, none).otherwise(F.col("pos"))).alias("false_negatives"),
        F.sum(F.when(hit, F.col("pos")).otherwise(none)).alias("true_positives"),
    )
    points = running_totals(counted.withColumn("p", score_of("p")), list(by), "p", ["pos", "neg"], descending=True)
    return with_rates(counts, digits).join(areas(points, by, digits), list(by))


def evaluate(df: DataFrame, p: str, y: str, threshold: float, by: Sequence[str] = (), digits: int = DIGITS, offer: float = OFFER_COST, lost: float = LOST_COST) -> DataFrame:
    """:func:`report` plus the simulated cost."""
    out = report(df, p, y, threshold, by, digits)
    return out.withColumn("total_cost", cost(F.col("false_positives"), F.col("false_negatives"), offer, lost))


def threshold_counts(df: DataFrame, p: str, y: str, thresholds: Sequence[float]) -> DataFrame:
    """(i, threshold, predicted, hits, rows, positives) for every threshold from one pass.

    A row passes the first k thresholds, so counting rows by k (at most one more
    value than there are thresholds) carries all the information of the sweep.
    """
    index = Bucketizer(
        splits=[float("-inf"), *thresholds, float("inf")], inputCol=p, outputCol="_k", handleInvalid="error"
    )
    by_k = (
        index.transform(df.withColumn(p, score_of(p)))
        .groupBy(F.col("_k").cast("int").alias("k"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    )
    values = F.array(*[F.lit(t) for t in thresholds])
    spine = df.sparkSession.range(-1, len(thresholds)).select(
        F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos")
    )
    # every row counts for entry -1, so that entry holds the totals
    passed = by_k.select(F.explode(F.sequence(F.lit(-1), F.col("k") - 1)).alias("i"), "n", "pos")
    everything = Window.partitionBy()  # one row per threshold
    return (
        passed.unionByName(spine)
        .groupBy("i")
        .agg(F.sum("n").alias("predicted"), F.sum("pos").alias("hits"))
        .withColumns(
            {
                "threshold": F.get(values, F.col("i")),
                "rows": F.max("predicted").over(everything),
                "positives": F.max("hits").over(everything),
            }
        )
        .where("i >= 0")
    )


def sweep(df: DataFrame, p: str, y: str, thresholds: Sequence[float] | None = None, digits: int = DIGITS, offer: float = OFFER_COST, lost: float = LOST_COST) -> DataFrame:
    """Precision, recall, F1, error counts and cost for every threshold of the grid."""
    counts = threshold_counts(df, p, y, thresholds if thresholds is not None else grid())
    tp, fp = F.col("hits"), F.col("predicted") - F.col("hits")
    fn = F.col("positives") - F.col("hits")
    return counts.select(
        F.round("threshold", 2).alias("threshold"),
        F.round(ratio(tp, F.col("predicted")), digits).alias("precision"),
        F.round(ratio(tp, F.col("positives")), digits).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        F.col("predicted"),
        cost(fp, fn, offer, lost).alias("total_cost"),
    )


def cheapest(swept: DataFrame) -> DataFrame:
    """The row of least cost, the lowest threshold on ties."""
    best = F.min_by(F.struct(*swept.columns), F.struct("total_cost", "threshold"))
    return swept.agg(best.alias("r")).where("r IS NOT NULL").select("r.*")


def compare_thresholds(swept: DataFrame, named: dict[str, float]) -> DataFrame:
    """The optimum beside the rows nearest to other thresholds of interest."""
    out = cheapest(swept).withColumn("choice", F.lit("optimum"))
    for name, value in named.items():
        gap = F.abs(F.col("threshold") - F.lit(float(value)))
        near = swept.agg(F.min_by(F.struct(*swept.columns), F.struct(gap, F.col("threshold"))).alias("r")).select("r.*")
        out = out.unionByName(near.withColumn("choice", F.lit(name)))
    return out


def roc_points(points: DataFrame, by: Sequence[str], p: str, digits: int = 6) -> DataFrame:
    return with_class_totals(points, by).select(
        *by,
        p,
        F.round(F.try_divide(F.col("cum_neg").cast("double"), F.col("all_neg")), digits).alias("fpr"),
        F.round(F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos")), digits).alias("tpr"),
    )


def pr_points(points: DataFrame, by: Sequence[str], p: str, digits: int = 6) -> DataFrame:
    return with_class_totals(points, by).select(
        *by,
        p,
        F.round(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), digits).alias("precision"),
        F.round(F.try_divide(F.col("cum_pos").cast("double"), F.col("all_pos")), digits).alias("recall"),
    )


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = CALIBRATION_BINS, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Uniform bins; the index is the number of inner edges strictly below p."""
    inner = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]]
    index = sum(((F.col(p) > F.lit(e)).cast("int") for e in inner), F.lit(0))
    return (
        df.withColumn("bin", index)
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col(y).cast("double")), digits).alias("frac_pos"),
            F.round(F.avg(p), digits).alias("mean_pred"),
        )
    )


def calibration_error(df: DataFrame, p: str, y: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Unweighted mean gap over the bins, with spread of p, Brier score and areas."""
    gap = (
        calibration_bins(df, p, y, by=by, digits=12)
        .groupBy(*by)
        .agg(F.round(F.avg(F.abs(F.col("frac_pos") - F.col("mean_pred"))), digits).alias("mean_calibration_error"))
    )
    spread = df.groupBy(*by).agg(
        F.round(brier(p, y), digits).alias("brier_score"),
        F.round(F.avg(p), digits).alias("p_mean"),
        F.min(p).alias("p_min"),
        F.max(p).alias("p_max"),
    )
    return gap.join(spread, list(by)).join(areas(score_points(df, p, y, by), by, digits), list(by))


GAP_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score")


def dataset_gap(df: DataFrame, p: str, y: str, threshold: float, by: str = "partition", first: str = "validation", second: str = "test", digits: int = 6) -> DataFrame:
    """metric x dataset table with the difference second - first."""
    both = df.where(F.col(by).isin(first, second))
    evaluated = evaluate(both, p, y, threshold, [by], digits)
    counts = ("predicted", "false_positives", "false_negatives", "total_cost")
    wide = evaluated.select(by, *[F.col(c).cast("double").alias(c) for c in (*GAP_METRICS, *counts)])
    return (
        wide.unpivot([by], [*GAP_METRICS, *counts], "metric", "value")
        .groupBy("metric")
        .pivot(by, [first, second])
        .agg(F.first("value"))
        .withColumn("gap", F.round(F.col(second) - F.col(first), digits))
    )


def model_table(df: DataFrame, p: str, y: str, threshold: float, model: str = "model", digits: int = DIGITS) -> DataFrame:
    """Metrics per model, ranked by average precision (a handful of rows)."""
    table = report(df, p, y, threshold, [model], digits)
    order = Window.orderBy(F.desc("pr_auc"), model)
    return table.withColumn("rank", F.row_number().over(order))


def best_per_metric(table: DataFrame, model: str, metrics: Sequence[str]) -> DataFrame:
    long = table.select(model, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [model], list(metrics), "metric", "value"
    )
    return long.groupBy("metric").agg(
        F.min_by(model, F.struct(-F.col("value"), F.col(model))).alias("best_model"), F.max("value").alias("best_value")
    )
