"""Metrics, curves, thresholds and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.operators import metrics, split
from keelson.plans import views
from keelson.roles import CUSTOMER

THRESHOLD = 0.30
T = "0.3::DOUBLE"


def labelled(spark, sf):
    df = views.scored(spark, sf).select("customerID", "Churn", "p")
    return df.withColumn("y", F.when(F.col("Churn") == "Yes", 1).otherwise(0))


def conf(source, t=T, by=""):
    return f"""SELECT {by} count(*) FILTER (p < {t} AND y = 0) AS true_negatives, count(*) FILTER (p >= {t} AND y = 0) AS false_positives,
 count(*) FILTER (p < {t} AND y = 1) AS false_negatives, count(*) FILTER (p >= {t} AND y = 1) AS true_positives FROM {source}"""


RATES = """round((true_positives + true_negatives) / CAST(true_positives + true_negatives + false_positives + false_negatives AS DOUBLE), 6) AS accuracy,
 round(coalesce(true_positives / nullif(CAST(true_positives + false_positives AS DOUBLE), 0), 0), 6) AS "precision",
 round(coalesce(true_positives / nullif(CAST(true_positives + false_negatives AS DOUBLE), 0), 0), 6) AS recall,
 round(coalesce(2 * true_positives / nullif(CAST(2 * true_positives + false_positives + false_negatives AS DOUBLE), 0), 0), 6) AS f1,
 true_positives + false_positives AS predicted"""


def points(source, by=""):
    part = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    return f"""SELECT {group} p, pos, neg, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER ({part}) AS tp, sum(neg) OVER ({part}) AS tn
FROM (SELECT {group} p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL)
WINDOW w AS ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""


def areas(source, by=""):
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {group} round(sum(neg * (cum_pos - 0.5::DOUBLE * pos)) / (max(tp) * CAST(max(tn) AS DOUBLE)), 6) AS roc_auc,
 round(sum(pos * cum_pos / CAST(cum_pos + cum_neg AS DOUBLE)) / CAST(max(tp) AS DOUBLE), 6) AS pr_auc FROM ({points(source, by)}) {tail}"""


BRIER = "round(avg((p - y) * (p - y)), 6)"


@query("confusion", conf("scored"))
def confusion(spark, sf):
    return metrics.confusion(labelled(spark, sf), "p", "y", THRESHOLD)


@query("accuracy", f"SELECT round(avg(CAST((p >= {T}) = (y = 1) AS INTEGER)), 6) AS accuracy FROM scored")
def accuracy(spark, sf):
    counts = metrics.confusion(labelled(spark, sf), "p", "y", THRESHOLD)
    return metrics.with_rates(counts, 6).select("accuracy")


@query("precision_recall_f1", f"SELECT *, {RATES} FROM ({conf('scored')})")
def precision_recall_f1(spark, sf):
    return metrics.with_rates(metrics.confusion(labelled(spark, sf), "p", "y", THRESHOLD), 6)


@query("roc_auc", f"SELECT roc_auc FROM ({areas('scored')})")
def roc_auc(spark, sf):
    return metrics.areas(metrics.score_points(labelled(spark, sf), "p", "y"), digits=6).select("roc_auc")


@query("average_precision", f"SELECT model, pr_auc FROM ({areas('models', 'model')})")
def average_precision(spark, sf):
    pts = metrics.score_points(views.scored_models(spark, sf), "p", "y", ["model"])
    return metrics.areas(pts, ["model"], 6).select("model", "pr_auc")


@query("brier", f"SELECT model, {BRIER} AS brier_score FROM models GROUP BY 1")
def brier(spark, sf):
    return views.scored_models(spark, sf).groupBy("model").agg(F.round(metrics.brier("p", "y"), 6).alias("brier_score"))


def report_sql(source, t=T):
    return f"""SELECT *, {RATES}, {t} AS threshold FROM ({conf(source, t)}), (SELECT {BRIER} AS brier_score FROM {source}), ({areas(source)})"""


def report_by(source, by, t=T):
    return f"""SELECT a.*, {RATES}, b.brier_score, c.roc_auc, c.pr_auc, {t} AS threshold FROM ({conf(source, t, by + ',')} GROUP BY {by}) a
 JOIN (SELECT {by}, {BRIER} AS brier_score FROM {source} GROUP BY 1) b USING ({by}) JOIN ({areas(source, by)}) c USING ({by})"""


@query("classification_report", report_sql("scored"))
def classification_report(spark, sf):
    return metrics.report(labelled(spark, sf), "p", "y", THRESHOLD, digits=6)


COST = "CAST(false_positives * 50.0::DOUBLE + false_negatives * 500.0::DOUBLE AS BIGINT)"


@query("business_cost", f"SELECT false_positives, false_negatives, {COST} AS total_cost FROM ({conf('scored')})")
def business_cost(spark, sf):
    counts = metrics.confusion(labelled(spark, sf), "p", "y", THRESHOLD)
    total = metrics.cost(F.col("false_positives"), F.col("false_negatives"))
    return counts.select("false_positives", "false_negatives", total.alias("total_cost"))


@query("evaluate_at_threshold", f"SELECT *, {COST} AS total_cost FROM ({report_by('models', 'model')})")
def evaluate_at_threshold(spark, sf):
    return metrics.evaluate(views.scored_models(spark, sf), "p", "y", THRESHOLD, ["model"], 6)


GRID = ", ".join(f"{t!r}::DOUBLE" for t in metrics.grid())
SWEEP = f"""SELECT round(t, 2) AS threshold, round(coalesce(tp / nullif(CAST(n AS DOUBLE), 0), 0), 6) AS "precision",
 round(coalesce(tp / nullif(CAST(pos AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(n + pos AS DOUBLE), 0), 0), 6) AS f1,
 n - tp AS false_positives, pos - tp AS false_negatives, n AS predicted, CAST((n - tp) * 50.0::DOUBLE + (pos - tp) * 500.0::DOUBLE AS BIGINT) AS total_cost
FROM (SELECT t, count(*) FILTER (p >= t) AS n, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (y = 1) AS pos
 FROM scored, (SELECT unnest([{GRID}]) AS t) GROUP BY t)"""


@query("threshold_sweep", SWEEP)
def threshold_sweep(spark, sf):
    return metrics.sweep(labelled(spark, sf), "p", "y", digits=6)


@query(
    "theta_threshold",
    f"""SELECT t AS threshold, count(*) FILTER (p >= t) AS predicted, count(*) FILTER (p >= t AND y = 1) AS hits
FROM scored, (SELECT unnest([{GRID}]) AS t) GROUP BY t""",
)
def theta_threshold(spark, sf):
    counts = metrics.threshold_counts(labelled(spark, sf), "p", "y", metrics.grid())
    return counts.select("threshold", "predicted", "hits")


@query("min_cost_threshold", f"SELECT * FROM ({SWEEP}) ORDER BY total_cost, threshold LIMIT 1")
def min_cost_threshold(spark, sf):
    return metrics.cheapest(metrics.sweep(labelled(spark, sf), "p", "y", digits=6))


@query(
    "threshold_compare",
    f"""WITH s AS ({SWEEP}) (SELECT *, 'optimum' AS choice FROM s ORDER BY total_cost, threshold LIMIT 1)
UNION ALL (SELECT *, 'default' FROM s ORDER BY abs(threshold - 0.5::DOUBLE), threshold LIMIT 1)
UNION ALL (SELECT *, 'old' FROM s ORDER BY abs(threshold - 0.26::DOUBLE), threshold LIMIT 1)""",
)
def threshold_compare(spark, sf):
    return metrics.compare_thresholds(metrics.sweep(labelled(spark, sf), "p", "y", digits=6), {"default": 0.5, "old": 0.26})


@query(
    "roc_curve",
    f"SELECT model, p, round(cum_neg / CAST(tn AS DOUBLE), 6) AS fpr, round(cum_pos / CAST(tp AS DOUBLE), 6) AS tpr FROM ({points('models', 'model')})",
)
def roc_curve(spark, sf):
    return metrics.roc_points(metrics.score_points(views.scored_models(spark, sf), "p", "y", ["model"]), ["model"], "p")


@query(
    "pr_curve",
    f"""SELECT model, p, round(cum_pos / CAST(cum_pos + cum_neg AS DOUBLE), 6) AS "precision", round(cum_pos / CAST(tp AS DOUBLE), 6) AS recall
FROM ({points('models', 'model')})""",
)
def pr_curve(spark, sf):
    return metrics.pr_points(metrics.score_points(views.scored_models(spark, sf), "p", "y", ["model"]), ["model"], "p")


_BIN = " + ".join(f"CAST(p > {e!r}::DOUBLE AS INTEGER)" for e in [float(x) for x in __import__("numpy").linspace(0, 1, 11)[1:-1]])
CURVE = f"SELECT model, {_BIN} AS bin, count(*) AS n, avg(CAST(y AS DOUBLE)) AS fp_, avg(p) AS mp_ FROM models GROUP BY ALL"


@query(
    "calibration_curve",
    f"SELECT model, CAST(bin AS INTEGER) AS bin, n, round(fp_, 6) AS frac_pos, round(mp_, 6) AS mean_pred FROM ({CURVE})",
)
def calibration_curve(spark, sf):
    return metrics.calibration_bins(views.scored_models(spark, sf), "p", "y", by=["model"])


@query(
    "calibration_error",
    f"""SELECT g.model, round(g.e, 6) AS mean_calibration_error, s.brier_score, s.p_mean, s.p_min, s.p_max, a.roc_auc, a.pr_auc
FROM (SELECT model, avg(abs(round(fp_, 12) - round(mp_, 12))) AS e FROM ({CURVE}) GROUP BY 1) g
JOIN (SELECT model, {BRIER} AS brier_score, round(avg(p), 6) AS p_mean, min(p) AS p_min, max(p) AS p_max FROM models GROUP BY 1) s ON g.model = s.model
JOIN ({areas('models', 'model')}) a ON g.model = a.model""",
)
def calibration_error(spark, sf):
    return metrics.calibration_error(views.scored_models(spark, sf), "p", "y", ["model"])


_PART = """(SELECT s.p, s.y, sp."partition" AS ds FROM scored s JOIN split sp ON s.customerID = sp.customerID WHERE sp."partition" <> 'train')"""
_LONG = " UNION ALL ".join(
    f"SELECT ds, '{m}' AS metric, CAST({'\"precision\"' if m == 'precision' else m} AS DOUBLE) AS v FROM e"
    for m in (*metrics.GAP_METRICS, "predicted", "false_positives", "false_negatives", "total_cost")
)


@query(
    "val_test_gap",
    f"""WITH d AS {_PART}, e AS (SELECT *, {COST} AS total_cost FROM ({report_by('d', 'ds')}))
SELECT metric, max(v) FILTER (ds = 'validation') AS validation, max(v) FILTER (ds = 'test') AS test,
 round(max(v) FILTER (ds = 'test') - max(v) FILTER (ds = 'validation'), 6) AS gap FROM ({_LONG}) GROUP BY 1""",
)
def val_test_gap(spark, sf):
    return metrics.dataset_gap(split.stratified_split(labelled(spark, sf), CUSTOMER), "p", "y", THRESHOLD)


RANKED = f"SELECT *, CAST(row_number() OVER (ORDER BY pr_auc DESC, model) AS INTEGER) AS rank FROM ({report_by('models', 'model')})"


@query("model_rank", RANKED)
def model_rank(spark, sf):
    return metrics.model_table(views.scored_models(spark, sf), "p", "y", THRESHOLD, digits=6)


@query(
    "confusion_compare",
    f"""SELECT * FROM ({conf('models', T, 'model,')} GROUP BY model) WHERE model IN (SELECT model FROM ({areas('models', 'model')}) ORDER BY pr_auc DESC, model LIMIT 3)""",
)
def confusion_compare(spark, sf):
    df = views.scored_models(spark, sf)
    ranked = metrics.areas(metrics.score_points(df, "p", "y", ["model"]), ["model"], 6)
    best = ranked.orderBy(F.desc("pr_auc"), "model").limit(3).select("model")
    return metrics.confusion(df, "p", "y", THRESHOLD, ["model"]).join(best, "model", "left_semi")


@query(
    "best_per_metric",
    f"""WITH r AS ({RANKED}), l AS (SELECT model, 'pr_auc' AS metric, pr_auc AS v FROM r UNION ALL SELECT model, 'f1', f1 FROM r UNION ALL SELECT model, 'recall', recall FROM r)
SELECT metric, arg_min(model, (-v, model)) AS best_model, max(v) AS best_value FROM l GROUP BY 1""",
)
def best_per_metric(spark, sf):
    table = metrics.model_table(views.scored_models(spark, sf), "p", "y", THRESHOLD, digits=6)
    return metrics.best_per_metric(table, "model", ["pr_auc", "f1", "recall"])
