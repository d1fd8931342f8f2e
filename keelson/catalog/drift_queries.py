"""Drift and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.metrics_queries import areas
from keelson.catalog.profiling_queries import CAT_LONG, NUM_LONG, cleaned
from keelson.catalog.registry import query
from keelson.catalog.views_sql import CATEGORICAL, NUMERIC, long_form
from keelson.operators import cleaning, drift, monitor
from keelson.plans import views
from keelson.roles import CUSTOMER
from keelson.session import scratch_path


def stored_baseline(spark, sf) -> drift.Baseline:
    """The baseline as an artefact in the shared folder, written from the early snapshot and read back."""
    return drift.Baseline.of(early(spark, sf), CUSTOMER, views.BASELINE_AS_OF).save(scratch_path(spark, "baseline"))


def early(spark, sf):
    return cleaning.clean_charges(views.snapshot(spark, sf, views.BASELINE_AS_OF), CUSTOMER)


EARLY_NUM = long_form("baseline_clean", NUMERIC, "DOUBLE")
EARLY_CAT = long_form("baseline_clean", CATEGORICAL)
QS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
SHARES = "SELECT feature, value AS level, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY feature) AS DOUBLE) AS share FROM ({0}) WHERE value IS NOT NULL GROUP BY feature, value"


@query(
    "baseline_stats",
    f"""WITH q AS (SELECT feature, avg(value) AS mean, quantile_cont(value, {QS}) AS e FROM ({EARLY_NUM}) GROUP BY 1)
SELECT 'numeric' AS kind, feature, 'mean' AS name, round(mean, 4) AS value FROM q
UNION ALL SELECT 'numeric', feature, 'median', round(e[6], 4) FROM q
UNION ALL SELECT 'numeric', feature, 'e' || lpad(CAST(i AS VARCHAR), 2, '0'), round(e[i + 1], 4) FROM q, (SELECT unnest(range(11)) AS i)
UNION ALL SELECT 'category', feature, level, round(share, 4) FROM ({SHARES.format(EARLY_CAT)})""",
)
def baseline_stats(spark, sf):
    return drift.baseline_stats(early(spark, sf), CUSTOMER)


PSI = f"""SELECT feature, round(CASE WHEN max(ne) < 3 THEN 0 ELSE greatest(sum(CASE WHEN bin >= 0 AND (b > 0 OR a > 0) THEN (ash - bsh) * ln(ash / bsh) ELSE 0 END), 0) END, 6) AS psi,
 CASE WHEN max(ne) < 3 THEN 0 ELSE greatest(sum(CASE WHEN bin >= 0 AND (b > 0 OR a > 0) THEN (ash - bsh) * ln(ash / bsh) ELSE 0 END), 0) END >= 0.2 AS drifted,
 round(CAST(sum(a) FILTER (bin < 0) AS DOUBLE) / sum(a), 6) AS oor FROM (
 SELECT *, greatest(b / greatest(CAST(sum(b) FILTER (bin >= 0) OVER (PARTITION BY feature) AS DOUBLE), 1), 1e-6) AS bsh,
  greatest(a / greatest(CAST(sum(a) FILTER (bin >= 0) OVER (PARTITION BY feature) AS DOUBLE), 1), 1e-6) AS ash FROM (
  SELECT v.feature, first(len(edges)) AS ne, CASE WHEN value < edges[1] OR value > edges[-1] THEN -1 WHEN value = edges[-1] THEN len(edges) - 2
    ELSE len(list_filter(edges, lambda e: e <= value)) - 1 END AS bin, sum(b) AS b, sum(a) AS a
  FROM (SELECT feature, value, 1 AS b, 0 AS a FROM ({EARLY_NUM}) UNION ALL SELECT feature, value, 0, 1 FROM ({NUM_LONG})) v
  JOIN (SELECT feature, list_sort(list_distinct(quantile_cont(value, {QS}))) AS edges FROM ({EARLY_NUM}) GROUP BY 1) q ON v.feature = q.feature
  GROUP BY v.feature, bin)) GROUP BY feature"""


@query("psi", f"SELECT feature, psi, coalesce(oor, 0) AS out_of_range_share FROM ({PSI})")
def psi(spark, sf):
    return drift.psi(early(spark, sf), cleaned(spark, sf), CUSTOMER.numeric, digits=6)


NUMD = f"""SELECT p.feature, psi, coalesce(oor, 0) AS out_of_range_share, round(b.m, 6) AS baseline_mean, round(a.m, 6) AS batch_mean, drifted AS alert
FROM ({PSI}) p JOIN (SELECT feature, avg(value) AS m FROM ({EARLY_NUM}) GROUP BY 1) b ON p.feature = b.feature
JOIN (SELECT feature, avg(value) AS m FROM ({NUM_LONG}) GROUP BY 1) a ON p.feature = a.feature"""


@query("numeric_drift", NUMD)
def numeric_drift(spark, sf):
    return drift.numeric_drift(early(spark, sf), cleaned(spark, sf), CUSTOMER.numeric, digits=6)


CATD = f"""SELECT feature, round(max(shift), 6) AS max_share_shift, CASE WHEN max(shift) > 0 THEN arg_min(level, (-shift, -n, level)) FILTER (shift IS NOT NULL) END AS worst_category,
 round(sum(CASE WHEN bshare IS NULL THEN ashare ELSE 0 END), 6) AS unseen_share, max(shift) >= 0.15 AS alert FROM (
SELECT coalesce(b.feature, a.feature) AS feature, coalesce(b.level, a.level) AS level, b.n, round(b.share, 4) AS bshare, a.share AS ashare,
 abs(coalesce(a.share, 0) - round(b.share, 4)) AS shift
FROM ({SHARES.format(EARLY_CAT)}) b FULL JOIN ({SHARES.format(CAT_LONG)}) a ON b.feature = a.feature AND b.level = a.level) GROUP BY feature"""


@query("categorical_drift", CATD)
def categorical_drift(spark, sf):
    return drift.categorical_drift(early(spark, sf), cleaned(spark, sf), CUSTOMER.categorical, digits=6)


REPORT = f"""SELECT *, CASE WHEN alert THEN (CASE kind WHEN 'numeric' THEN 'Numeric drift on ' ELSE 'Categorical shift on ' END) || feature END AS alert_text, 'batch_b' AS source
FROM (SELECT 'numeric' AS kind, feature, psi AS value, alert FROM ({NUMD}) UNION ALL SELECT 'category', feature, max_share_shift, alert FROM ({CATD}))"""


@query("drift_report", REPORT)
def drift_report(spark, sf):
    return drift.drift_report(stored_baseline(spark, sf), cleaned(spark, sf), CUSTOMER, "batch_b", digits=6)


COUNTERS = """SELECT CAST(coalesce(sum("count") FILTER (kind <> 'error' AND "count" > 0), 0) AS BIGINT) AS predictions_total,
 count(*) FILTER (kind = 'batch' AND "count" > 0) AS batch_requests_total, count(*) FILTER (kind = 'error') AS errors_total,
 max(ts) FILTER (kind <> 'error' AND "count" > 0) AS last_prediction_at,
 (SELECT round(avg("count"), 2) FROM (SELECT "count" FROM plog WHERE kind = 'batch' AND "count" > 0 ORDER BY ts DESC, event_id DESC LIMIT 100)) AS avg_recent_batch_size
FROM plog"""


@query("service_counters", COUNTERS)
def service_counters(spark, sf):
    return monitor.service_counters(views.prediction_log(spark, sf))


@query(
    "monitoring_summary",
    f"""SELECT c.*, CASE WHEN s.a THEN 'alert' ELSE 'ok' END AS drift_status, coalesce(s.t, '') AS drift_alerts, 10000 AS batch_max_rows
FROM ({COUNTERS}) c, (SELECT bool_or(alert) AS a, string_agg(alert_text, '; ' ORDER BY alert_text) AS t FROM ({REPORT})) s""",
)
def monitoring_summary(spark, sf):
    report = drift.drift_report(stored_baseline(spark, sf), cleaned(spark, sf), CUSTOMER, "batch_b", digits=6)
    counters = monitor.service_counters(views.prediction_log(spark, sf))
    return monitor.monitoring_summary(counters, drift.drift_status(report))


@query(
    "stream_counters",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS requests, CAST(coalesce(sum("count"), 0) AS BIGINT) AS rows FROM plog GROUP BY ALL""",
)
def stream_counters(spark, sf):
    from keelson.streaming.log import stream_daily_counters

    return stream_daily_counters(spark, sf)


@query("stream_recent_counters", COUNTERS)
def stream_recent_counters(spark, sf):
    from keelson.streaming.log import stream_recent_counters

    return stream_recent_counters(spark, sf)


@query(
    "counters_daily",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS requests, CAST(coalesce(sum("count"), 0) AS BIGINT) AS rows FROM plog GROUP BY ALL""",
)
def counters_daily(spark, sf):
    return monitor.daily_counters(views.prediction_log(spark, sf))


WEEK = "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')"
WEEKLY = f"""SELECT strftime({WEEK}, '%Y-%m-%d') AS week, count(*) AS n, avg(p) AS mean_p, stddev_samp(p) AS std_p,
 avg(CAST(p >= 0.3::DOUBLE AS DOUBLE)) AS flagged_share, quantile_cont(p, 0.5) AS median_p FROM plog GROUP BY 1"""


@query(
    "score_drift_weekly",
    f"""SELECT week, n, round(mean_p, 6) AS mean_p, round(std_p, 6) AS std_p, round(flagged_share, 6) AS flagged_share,
 round(median_p, 6) AS median_p, round(sigmas, 4) AS sigmas, coalesce(sigmas > 2, false) AS alert FROM (SELECT *,
 abs(mean_p - lag(mean_p) OVER (ORDER BY week)) / nullif(lag(std_p) OVER (ORDER BY week) / sqrt(n), 0) AS sigmas FROM ({WEEKLY}))""",
)
def score_drift_weekly(spark, sf):
    return monitor.score_drift(views.prediction_log(spark, sf), 0.30)


@query(
    "churn_rate_drift",
    f"""SELECT strftime({WEEK}, '%Y-%m-%d') AS week, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate,
 round(round(avg(CAST(y AS DOUBLE)), 6) - 0.265::DOUBLE, 6) AS gap FROM plog GROUP BY {WEEK}""",
)
def churn_rate_drift(spark, sf):
    return monitor.label_rate_drift(views.prediction_log(spark, sf), 0.265)


_SLIDE = f"(SELECT strftime({WEEK} - i * INTERVAL '7 days', '%Y-%m-%d') AS start, p, y FROM plog, (SELECT unnest(range(4)) AS i))"


@query(
    "rolling_performance",
    f"""SELECT s.*, a.pr_auc FROM (SELECT start, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier_score,
 round(coalesce(count(*) FILTER (p >= 0.3::DOUBLE AND y = 1) / nullif(CAST(count(*) FILTER (p >= 0.3::DOUBLE) AS DOUBLE), 0), 0), 6) AS "precision",
 round(coalesce(count(*) FILTER (p >= 0.3::DOUBLE AND y = 1) / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE), 0), 0), 6) AS recall FROM {_SLIDE} GROUP BY 1) s
 JOIN ({areas(_SLIDE, "start")}) a ON s.start = a.start""",
)
def rolling_performance(spark, sf):
    return monitor.rolling_performance(views.prediction_log(spark, sf), 0.30)


@query(
    "ks_drift",
    f"""WITH u AS (SELECT feature, value, 1 AS b, 0 AS a FROM ({EARLY_NUM}) UNION ALL SELECT feature, value, 0, 1 FROM ({NUM_LONG})),
g AS (SELECT feature, value, sum(b) AS b, sum(a) AS a FROM u GROUP BY ALL)
SELECT feature, round(max(gap), 6) AS ks FROM (SELECT feature, abs(
 sum(b) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE)
 - sum(a) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE)) AS gap FROM g) GROUP BY 1""",
)
def ks_drift(spark, sf):
    return drift.ks(early(spark, sf), cleaned(spark, sf), CUSTOMER.numeric)


@query(
    "stream_score_log",
    f"""SELECT customerID, p AS probability, 0.3::DOUBLE AS threshold, CASE WHEN p >= 0.3::DOUBLE THEN 'Churn' ELSE 'No Churn' END AS decision,
 'scored|threshold=0.3' AS model_version FROM scored""",
)
def stream_score_log(spark, sf):
    from keelson.streaming.log import stream_scores

    return stream_scores(spark, sf, 0.30).select("customerID", "probability", "threshold", "decision", "model_version")


@query(
    "psi_binary_shares",
    """SELECT feature, CAST(round(max(abs(a - b)), 6) AS DOUBLE) AS max_share_shift FROM (
 SELECT 'SeniorCitizen' AS feature, avg(CAST(SeniorCitizen AS DOUBLE)) AS b, (SELECT avg(CAST(SeniorCitizen AS DOUBLE)) FROM cleaned) AS a FROM baseline_clean) GROUP BY 1""",
)
def psi_binary_shares(spark, sf):
    """0/1 numbers, whose quantile bins collapse, are watched as category shares."""
    old = drift.category_shares(early(spark, sf), ["SeniorCitizen"]).select("feature", "level", "share")
    new = drift.category_shares(cleaned(spark, sf), ["SeniorCitizen"]).select("feature", "level", F.col("share").alias("s2"))
    gap = F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("s2", F.lit(0.0)))
    return old.join(new, ["feature", "level"], "full").groupBy("feature").agg(F.round(F.max(gap), 6).alias("max_share_shift"))
