"""Service counters and score monitoring over the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.ranked import exact_quantiles
from keelson.functions.scalars import ratio
from keelson.operators import metrics

RECENT_BATCHES = 100  # fixed value
BATCH_MAX_ROWS = 10_000  # fixed value
SIGMA = 2.0  # fixed value


def service_counters(log: DataFrame) -> DataFrame:
    """Totals over the log and the mean size of the last 100 batches.

    Entries that scored nothing do not count; the recent batches are a top-k sort.
    """
    scored = (F.col("kind") != "error") & (F.col("count") > 0)
    batch = scored & (F.col("kind") == "batch")
    recent = (
        log.where(batch)
        .orderBy(F.desc("ts"), F.desc("event_id"))
        .limit(RECENT_BATCHES)
        .agg(F.round(F.avg("count"), 2).alias("m"))
    )
    return log.agg(
        F.coalesce(F.sum(F.when(scored, F.col("count"))), F.lit(0)).cast("long").alias("predictions_total"),
        F.count_if(batch).alias("batch_requests_total"),
        F.count_if(F.col("kind") == "error").alias("errors_total"),
        F.max(F.when(scored, F.col("ts"))).alias("last_prediction_at"),
    ).withColumn("avg_recent_batch_size", recent.scalar())


def monitoring_summary(counters: DataFrame, status: DataFrame | None, batch_max_rows: int = BATCH_MAX_ROWS) -> DataFrame:
    """Counters beside the last drift status; 'no_data' when there is none."""
    if status is None:
        drift = {"drift_status": F.lit("no_data"), "drift_alerts": F.lit("")}
    else:
        packed = status.select(F.struct("status", "alert_texts").alias("s")).scalar()
        drift = {
            "drift_status": F.coalesce(packed.getField("status"), F.lit("no_data")),
            "drift_alerts": F.coalesce(packed.getField("alert_texts"), F.lit("")),
        }
    return counters.withColumns({**drift, "batch_max_rows": F.lit(batch_max_rows)})


def _start(width: str, slide: str | None = None) -> Column:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return window.getField("start")


def daily_counters(log: DataFrame) -> DataFrame:
    """Batch twin of the streaming counters: requests and rows per day and kind."""
    return (
        log.groupBy(_start("1 day").alias("day"), "kind")
        .agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows"))
        .withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    )


def weekly_scores(log: DataFrame, threshold: float) -> DataFrame:
    """Mean, median, spread and flagged share of the score per 7-day window, unrounded."""
    weekly = log.withColumn("week", F.date_format(_start("7 days"), "yyyy-MM-dd")).select("week", "p")
    medians = exact_quantiles(weekly, ["week"], "p", {"median_p": 0.5}).drop("n")
    stats = weekly.groupBy("week").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("p").alias("mean_p"),
        F.stddev_samp("p").alias("std_p"),
        F.avg((F.col("p") >= threshold).cast("double")).alias("flagged_share"),
    )
    return stats.join(medians, "week")


def score_drift(log: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """Week-over-week change of the mean score in standard errors; alert beyond 2, taken before rounding."""
    order = Window.orderBy("week")  # one row per week
    weekly = weekly_scores(log, threshold)
    shift = F.abs(F.col("mean_p") - F.lag("mean_p").over(order))
    error = F.lag("std_p").over(order) / F.sqrt(F.col("n"))
    moved = weekly.withColumn("sigmas", F.try_divide(shift, error))
    return moved.select(
        "week", "n", *[F.round(c, digits).alias(c) for c in ("mean_p", "std_p", "flagged_share", "median_p")],
        F.round("sigmas", 4).alias("sigmas"), F.coalesce(F.col("sigmas") > SIGMA, F.lit(False)).alias("alert"),
    )


def label_rate_drift(log: DataFrame, prior: float, digits: int = 6) -> DataFrame:
    """Realised positive rate per 7-day window against the training prior."""
    weekly = log.groupBy(_start("7 days").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), digits).alias("rate")
    )
    return weekly.withColumn("week", F.date_format("week", "yyyy-MM-dd")).withColumn(
        "gap", F.round(F.col("rate") - F.lit(float(prior)), digits)
    )


def rolling_performance(log: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """Brier score, average precision, precision and recall over sliding 28-day windows."""
    spread = log.select(
        F.date_format(_start("28 days", "7 days"), "yyyy-MM-dd").alias("start"), "p", "y"
    )
    points = metrics.score_points(spread, "p", "y", ["start"])
    area = metrics.areas(points, ["start"], digits).select("start", "pr_auc")
    hit = F.col("p") >= threshold
    sums = points.withColumns(
        {"n": F.col("pos") + F.col("neg"), "p2": F.col("p") * F.col("p"), "q2": (F.col("p") - 1) * (F.col("p") - 1)}
    ).groupBy("start").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("pos") * F.col("q2") + F.col("neg") * F.col("p2")) / F.sum("n"), digits).alias("brier_score"),
        F.round(ratio(F.sum(F.when(hit, F.col("pos"))), F.sum(F.when(hit, F.col("n")))), digits).alias("precision"),
        F.round(ratio(F.sum(F.when(hit, F.col("pos"))), F.sum("pos")), digits).alias("recall"),
    )
    return sums.join(area, "start")
