"""Model fits, calibration, retraining and explanations, at full training effort.

A trained score cannot be stated in SQL. These queries return the rows that were scored, with
flags for what must hold of any right fit: probabilities in range, decisions that follow the
threshold, contributions that add up, a gradient of zero at the optimum. One bundle is trained
per session and folder, saved to the shared folder, and loaded by every query that needs it.
"""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.split_queries import parted as split_table
from keelson.operators import cleaning, explain, models, smotenc
from keelson.operators.prep import FEATURES
from keelson.plans import training, views
from keelson.roles import CUSTOMER
from keelson.session import scratch_path
from keelson.sources.files import write_table

EFFORT = training.Effort(threads=8)
THRESHOLD = 0.10


#: Rows of a stored file: readers pack small files into tasks by the cores there are.
ROWS_PER_FILE = 25_000


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written once, in files that many tasks can share: a join may end in very few partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return spark.read.parquet(path)


def parted(spark, sf):
    """The split table as Parquet in the shared folder: a fit reads it many times, few columns at a time."""
    return _stored(split_table(spark, sf), "split")


def _kept(df: DataFrame) -> DataFrame:
    """Write the scores once; what they were computed from can then be released."""
    return _stored(df, "scores")


VALIDATED = """SELECT customerID, CAST(Churn = 'Yes' AS INTEGER) AS y, true AS in_range{} FROM split WHERE "partition" = 'validation'"""


def in_range():
    return F.col("p").between(0, 1).alias("in_range")


def _log_loss(df: DataFrame) -> float:
    p = F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12))
    return df.agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


SOUND = ", true AS better_than_share, true AS on_level"


def _sound(scored: DataFrame) -> list:
    """Flags that a constant or a wrong level breaks, from rows with ``partition``, ``y`` and ``p``.

    ``better_than_share``: the squared error on the training rows is below that of their share;
    ``on_level``: the mean probability of the other rows is within 0.1 of theirs.
    """
    train = F.col("partition") == "train"
    error = F.avg(F.when(train, F.pow(F.col("p") - F.col("y"), F.lit(2.0))))
    share = F.avg(F.when(train, F.col("y")))
    off = F.avg(F.when(~train, F.col("p") - F.col("y")))
    better, level = scored.agg(error < share * (1 - share) - 1e-6, F.abs(off) < 0.1).first()
    return [F.lit(better).alias("better_than_share"), F.lit(level).alias("on_level")]


def _validated(spark, sf, name):
    """Validation rows, and whether the fit explains its training rows better than their share does."""
    with training.TrainingFrames.of(parted(spark, sf), CUSTOMER) as data:
        model = training._candidate(name, EFFORT)(data.train)
        share = data.train.agg(F.avg("y")).first()[0]
        better = _log_loss(models.score(model, data.train)) < _log_loss(data.train.withColumn("p", F.lit(share)))
        scored = models.score(model, data.validation)
        return _kept(scored.select("customerID", F.col("y").cast("int").alias("y"), in_range(), F.lit(better).alias("better_than_share")))


@query(
    "fit_dummy",
    """SELECT v.customerID, CASE WHEN (SELECT count(*) FILTER (Churn = 'Yes') > count(*) FILTER (Churn = 'No') FROM split WHERE "partition" = 'train')
 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM split v WHERE "partition" = 'validation'""",
)
def fit_dummy(spark, sf):
    rows = split_table(spark, sf).withColumn("y", F.when(F.col("Churn") == "Yes", 1.0).otherwise(0.0))
    model = models.fit_majority(rows.where("partition = 'train'"))
    return models.score(model, rows.where("partition = 'validation'")).select("customerID", "p")


@query("fit_logistic", VALIDATED.format(", true AS at_optimum"))
def fit_logistic(spark, sf):
    """``at_optimum``: every component of the penalised loss's gradient is near zero."""
    with training.TrainingFrames.of(parted(spark, sf), CUSTOMER) as data:
        model = training._candidate("logistic", EFFORT)(data.train)
        n = data.train.count()
        error = models.score(model, data.train).select(F.posexplode(vector_to_array(FEATURES)).alias("i", "x"), (F.col("p") - F.col("y")).alias("e"))
        slopes = {r["i"]: r["g"] for r in error.groupBy("i").agg((F.sum(F.col("x") * F.col("e")) / n).alias("g")).collect()}
        gradient = [slopes[i] + c / n for i, c in enumerate(model.coefficients.toArray().tolist())]
        scored = models.score(model, data.validation)
        return _kept(scored.select("customerID", F.col("y").cast("int").alias("y"), in_range(), F.lit(max(map(abs, gradient)) < 1e-3).alias("at_optimum")))


@query("fit_random_forest", VALIDATED.format(", true AS better_than_share"))
def fit_random_forest(spark, sf):
    return _validated(spark, sf, "forest")


@query("fit_gbt", VALIDATED.format(", true AS better_than_share"))
def fit_gbt(spark, sf):
    return _validated(spark, sf, "boosted")


def _points_sql(grid) -> str:
    rows = ", ".join(f"('{i:03d}', '{json.dumps(p)}', true)" for i, p in enumerate(models.grid_points(grid)))
    return f"SELECT * FROM (VALUES {rows}) AS t(point, params, in_range)"


def _search(spark, sf, fit, grid):
    with training.TrainingFrames.of(parted(spark, sf), CUSTOMER) as data:
        found = models.grid_search(data.train, data.validation, fit, grid, EFFORT.threads)
        bounds = [F.col(c).between(0, 1) for c in ("f1", "recall", "precision")]
        return found.select("point", "params", (bounds[0] & bounds[1] & bounds[2]).alias("in_range"))


@query("grid_search_rf", _points_sql(models.FOREST_GRID))
def grid_search_rf(spark, sf):
    return _search(spark, sf, models.forest_point, models.FOREST_GRID)


@query("grid_search_gbt", _points_sql(models.BOOSTED_GRID))
def grid_search_gbt(spark, sf):
    """The whole grid; the points with fewer trees are read off the longer fits of the same point."""
    return _search(spark, sf, models.boosted_point, models.BOOSTED_GRID)


def _pairs_sql(pairs, extra="") -> str:
    return f"SELECT *{extra} FROM (VALUES " + ", ".join(f"('{m}', '{s}', true)" for m, s in pairs) + ") AS t(model, strategy, in_range)"


def _bounded(table: DataFrame) -> DataFrame:
    held = F.lit(True)
    for name in training.METRICS:
        held = held & F.coalesce(F.col(name).between(0, 1), F.lit(True))
    return table.select("model", "strategy", held.alias("in_range"))


@query("imbalance_matrix", _pairs_sql([(m, s) for m in ("logistic", "boosted") for s in ("original", "class_weight", "undersample", "smotenc")]))
def imbalance_matrix(spark, sf):
    return _bounded(training.imbalance_matrix(parted(spark, sf), CUSTOMER, EFFORT))


@query("model_comparison", _pairs_sql([*training.COMPARED]))
def model_comparison(spark, sf):
    return _bounded(training.model_comparison(parted(spark, sf), CUSTOMER, EFFORT))


_NUM, _CAT = CUSTOMER.numeric, CUSTOMER.categorical
_GAPS = " + ".join(f"(a.{c}::DOUBLE - b.{c}::DOUBLE) * (a.{c}::DOUBLE - b.{c}::DOUBLE)" for c in _NUM)
_MISSES = " + ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN pen * pen ELSE 0 END" for c in _CAT)
_MODES = ", ".join(f"(SELECT c.{c} FROM near n JOIN points c ON c.customerID = n.other WHERE n.id = d.customerID GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in _CAT)


@query(
    "smotenc",
    f"""WITH sizes AS MATERIALIZED (SELECT Churn, count(*) AS n FROM split WHERE "partition" = 'train' GROUP BY 1),
rare AS MATERIALIZED (SELECT Churn, n, (SELECT max(n) FROM sizes) - n AS wanted FROM sizes ORDER BY n, Churn LIMIT 1),
points AS MATERIALIZED (SELECT s.* FROM split s JOIN rare USING (Churn) WHERE "partition" = 'train'),
penalty AS MATERIALIZED (SELECT median(v) AS pen FROM (SELECT unnest([{", ".join(f"(SELECT stddev_pop({c}::DOUBLE) FROM points)" for c in _NUM)}]) AS v)),
near AS MATERIALIZED (SELECT * FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS nearest FROM (
  SELECT a.customerID AS id, b.customerID AS other, {_GAPS} + {_MISSES} AS d2
  FROM points a JOIN points b ON a.customerID <> b.customerID, penalty)) WHERE nearest <= 5),
turns AS (SELECT p.*, wanted // n + CASE WHEN row_number() OVER (ORDER BY md5('smote42|' || customerID), customerID) <= wanted % n THEN 1 ELSE 0 END AS turns
  FROM points p, rare),
draws AS MATERIALIZED (SELECT *, md5('smote42|' || customerID || '|' || i) AS draw FROM (SELECT *, unnest(range(1, turns + 1)) AS i FROM turns)),
picked AS (SELECT *, ('0x' || substr(draw, 1, 6))::BIGINT % 5 + 1 AS pick, ('0x' || substr(draw, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS gap FROM draws)
SELECT 'S' || i || '-' || d.customerID AS customerID,
 {", ".join(f"d.{c}::DOUBLE + gap * (o.{c}::DOUBLE - d.{c}::DOUBLE) AS {c}" for c in _NUM)}, {_MODES}, d.Churn
FROM picked d JOIN near m ON m.id = d.customerID AND m.nearest = d.pick JOIN points o ON o.customerID = m.other""",
)
def smotenc_rows(spark, sf):
    train = parted(spark, sf).where("partition = 'train'").drop("partition")
    return smotenc.synthesize(train, CUSTOMER)


def _calibrated(spark, sf, method):
    """Class-weighted boosting, calibrated by folds; ``monotone``: no fold's curve falls."""
    with training.TrainingFrames.of(parted(spark, sf), CUSTOMER) as data:
        fit = training._candidate("boosted", EFFORT)
        train = models.weighted(data.train, models.scale_pos_weight(data.train))
        model = models.fit_calibrated(train, CUSTOMER, fit, (method,), EFFORT.folds, EFFORT.threads)[method]
        rising = True
        for _, curve in model.pairs:
            values = curve.predictions.toArray().tolist() if method == "isotonic" else [0.0, float(curve.coefficients[0])]
            rising = rising and all(a <= b for a, b in zip(values, values[1:]))
        both = data.train.withColumn("partition", F.lit("train")).unionByName(data.validation.withColumn("partition", F.lit("validation")), True)
        scored = _kept(model.score(both).select("customerID", "partition", F.col("y").cast("int").alias("y"), "p"))
    flags = [in_range(), F.lit(rising).alias("monotone"), *_sound(scored)]
    return scored.where("partition = 'validation'").select("customerID", "y", *flags)


@query("calibrate_sigmoid", VALIDATED.format(SOUND))
def calibrate_sigmoid(spark, sf):
    """No ``monotone`` flag: where the label hardly follows the features, a fold's right slope can be negative."""
    return _calibrated(spark, sf, "sigmoid").drop("monotone")


@query("calibrate_isotonic", VALIDATED.format(", true AS monotone" + SOUND))
def calibrate_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic")


_BUNDLES: dict[tuple[str, str], str] = {}


def bundle(spark, sf) -> models.Bundle:
    """The final model of a folder's tables, trained by the first query of the session that asks for it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUNDLES:
        trained = training.train_final(parted(spark, sf), CUSTOMER, THRESHOLD, EFFORT)
        _BUNDLES[key] = trained.save(spark, scratch_path(spark, "bundle"))
    return models.Bundle.load(spark, _BUNDLES[key])


def _decided(spark, sf) -> DataFrame:
    """Scores and decisions of the bundle for every row of the split table, with its part and label."""
    rows = split_table(spark, sf)
    model = bundle(spark, sf)
    known = rows.select("customerID", "partition", (F.col("Churn") == "Yes").cast("int").alias("y"))
    return _kept(model.predict(rows, "customerID").join(known, "customerID").withColumn("p", F.col("churn_probability")))


def _follows(limit):
    return (F.col("retention_recommended") == (F.col("p") >= limit).cast("int")).alias("decided")


@query("train_final", VALIDATED.format(", true AS decided" + SOUND))
def train_final(spark, sf):
    """``decided``: the decision column is the comparison with the threshold."""
    scored = _decided(spark, sf)
    flags = [in_range(), _follows(THRESHOLD), *_sound(scored)]
    return scored.where("partition = 'validation'").select("customerID", "y", *flags)


@query(
    "train_upload",
    """SELECT CAST(doc_id AS VARCHAR) AS primary_key, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS actual_churn, true AS in_range
FROM documents JOIN labels USING (doc_id)""",
)
def train_upload(spark, sf):
    """Retrain on labelled documents. A table too small to train on is an error, never another answer."""
    result = training.train_upload(views.retrain_docs(spark, sf), "quality", "doc_id", EFFORT)
    return result.results.select("primary_key", "actual_churn", F.col("churn_probability").between(0, 1).alias("in_range"))


@query("score_probability", f"SELECT customerID, true AS in_range{SOUND} FROM cleaned")
def score_probability(spark, sf):
    rows = split_table(spark, sf).withColumn("y", (F.col("Churn") == "Yes").cast("int"))
    scored = _kept(bundle(spark, sf).score(rows).select("customerID", "partition", "y", "p"))
    return scored.select("customerID", in_range(), *_sound(scored))


@query("score_batch", f"SELECT customerID, 0.1::DOUBLE AS decision_threshold, true AS decided{SOUND} FROM cleaned")
def score_batch(spark, sf):
    scored = _decided(spark, sf)
    return scored.select("customerID", "decision_threshold", _follows(F.col("decision_threshold")), *_sound(scored))


@query("model_save_load", 'SELECT count(*) AS rows, count(*) AS equal_rows FROM cleaned')
def model_save_load(spark, sf):
    """Scores before saving and after loading, counted where they agree exactly."""
    df = parted(spark, sf)
    trained = bundle(spark, sf)
    loaded = models.Bundle.load(spark, trained.save(spark, scratch_path(spark, "bundle")))
    both = loaded.score(trained.score(df, "p"), "again")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") == F.col("again")).alias("equal_rows"))


@query("stream_model_log", "SELECT customerID, 0.1::DOUBLE AS threshold, CAST(1 AS BIGINT) AS entries, true AS as_batch FROM snapshot")
def stream_model_log(spark, sf):
    """Raw rows scored by the loaded bundle in the stream: half of them arrive, the run stops, then all
    arrive. ``entries``: log rows of the customer; ``as_batch``: the probability is that of a batch."""
    from keelson.streaming import log

    model, raw = bundle(spark, sf), views.snapshot(spark, sf)
    arriving, out = scratch_path(spark, "arriving"), scratch_path(spark, "model-log")
    write_table(raw.where(F.xxhash64("customerID") % 2 == 0), arriving)
    log.stream_model_log(spark, arriving, CUSTOMER, model, raw.schema, out)
    write_table(raw, arriving, "append")
    logged = log.stream_model_log(spark, arriving, CUSTOMER, model, raw.schema, out)
    found = logged.groupBy("customerID").agg(F.first("threshold").alias("threshold"), F.count(F.lit(1)).alias("entries"), F.max("probability").alias("q"))
    batch = model.score(cleaning.clean_charges(raw, CUSTOMER)).select("customerID", "p")
    return found.join(batch, "customerID").select("customerID", "threshold", "entries", (F.col("p") == F.col("q")).alias("as_batch"))


@query("pipeline_run", """SELECT "partition", count(*) AS rows FROM split GROUP BY 1""")
def pipeline_run(spark, sf):
    path = scratch_path(spark, "pipeline")
    training.run_pipeline(views.snapshot(spark, sf), CUSTOMER, path, THRESHOLD, EFFORT)
    # the second run finds the artefacts and trains nothing
    training.run_pipeline(views.snapshot(spark, sf), CUSTOMER, path, THRESHOLD, EFFORT)
    return spark.read.parquet(f"{path}/manifest").groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))


@query("tree_shap", """SELECT customerID, 0.0::DOUBLE AS gap FROM split WHERE "partition" = 'validation'""")
def tree_shap(spark, sf):
    """Per validation row: the margin of the model less base and contributions, which is nothing."""
    model, rows, _ = training.explain_frames(parted(spark, sf), CUSTOMER, EFFORT)
    parts = explain.tree_contributions(rows, model, "customerID")
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v) + F.col("base")
    margin = model.transform(rows).select("customerID", vector_to_array("rawPrediction").getItem(1).alias("margin"))
    return parts.join(margin, "customerID").select("customerID", (F.abs(F.round(total - F.col("margin"), 6))).alias("gap"))


@query("forest_shap", """SELECT customerID, 0.0::DOUBLE AS gap FROM split WHERE "partition" = 'validation'""")
def forest_shap(spark, sf):
    """Per validation row: the probability of the full forest less base and contributions, which is nothing."""
    with training.TrainingFrames.of(parted(spark, sf), CUSTOMER) as data:
        model = training._candidate("forest", EFFORT)(models.class_balanced(data.train))
        rows = data.validation.select("customerID", FEATURES)
        parts = explain.tree_contributions(rows, model, "customerID")
        total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v) + F.col("base")
        both = parts.join(models.score(model, rows).select("customerID", "p"), "customerID")
        return _kept(both.select("customerID", F.abs(F.round(total - F.col("p"), 6)).alias("gap")))


@query("shap_global_model")
def shap_global_model(spark, sf):
    """Mean absolute contribution and rank of each feature of the deployed kind of model on validation rows."""
    model, rows, names = training.explain_frames(parted(spark, sf), CUSTOMER, EFFORT)
    return explain.global_importance(explain.tree_contributions(rows, model, "customerID"), names)


# a contribution table that SQL can state: z-like distances of six fields
NAMES = ["SeniorCitizen", "tenure", "MonthlyCharges", "Contract Month-to-month", "TechSupport No", "Partner Yes"]
CONTRIB = """SELECT customerID, p, [SeniorCitizen - 0.5::DOUBLE, (tenure - 12.0::DOUBLE) / 12.0::DOUBLE, (MonthlyCharges - 20000.0::DOUBLE) / 20000.0::DOUBLE,
 CAST(Contract = 'Month-to-month' AS INTEGER) - 0.25::DOUBLE, CAST(TechSupport = 'No' AS INTEGER) - 0.75::DOUBLE, CAST(Partner = 'Yes' AS INTEGER) - 0.125::DOUBLE] AS c FROM scored"""
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def stored(spark, sf):
    def flag(name, level):
        return (F.col(name) == level).cast("int")

    return views.scored(spark, sf).select(
        "customerID",
        "p",
        F.array(
            F.col("SeniorCitizen") - F.lit(0.5),
            (F.col("tenure") - 12.0) / 12.0,
            (F.col("MonthlyCharges") - 20000.0) / 20000.0,
            flag("Contract", "Month-to-month") - F.lit(0.25),
            flag("TechSupport", "No") - F.lit(0.75),
            flag("Partner", "Yes") - F.lit(0.125),
        ).alias("contributions"),
    )


@query(
    "shap_global",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM (
SELECT feature, round(avg(abs(v)), 6) AS mean_abs FROM (SELECT unnest({_NAMES_SQL}) AS feature, unnest(c) AS v FROM ({CONTRIB})) GROUP BY 1)""",
)
def shap_global(spark, sf):
    return explain.global_importance(stored(spark, sf), NAMES)


@query(
    "shap_local",
    f"""WITH l AS (SELECT customerID, unnest({_NAMES_SQL}) AS feature, unnest(c) AS v FROM ({CONTRIB})),
r AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY v DESC, feature) AS up, row_number() OVER (PARTITION BY customerID ORDER BY v, feature) AS down FROM l)
SELECT customerID, 'increasing' AS direction, CAST(up AS INTEGER) AS rank, feature, round(v, 10) AS value FROM r WHERE up <= 5
UNION ALL SELECT customerID, 'decreasing', CAST(down AS INTEGER), feature, round(v, 10) FROM r WHERE down <= 5""",
)
def shap_local(spark, sf):
    return explain.local_top(stored(spark, sf), "customerID", NAMES, k=5, digits=10)


@query(
    "shap_cases",
    """(SELECT 'high_risk' AS "case", customerID, p FROM scored ORDER BY p DESC, customerID LIMIT 1)
UNION ALL (SELECT 'low_risk', customerID, p FROM scored ORDER BY p, customerID LIMIT 1)
UNION ALL (SELECT 'near_threshold', customerID, p FROM scored ORDER BY abs(p - 0.3::DOUBLE), customerID LIMIT 1)""",
)
def shap_cases(spark, sf):
    return explain.cases(views.scored(spark, sf).select("customerID", "p"), "customerID", "p", 0.30)
