"""Preprocessing: fitted statistics and encoded features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.split_queries import parted as lazily_parted
from keelson.catalog.views_sql import CATEGORICAL, NUMERIC, long_form
from keelson.operators import prep
from keelson.plans import views
from keelson.roles import CUSTOMER, CUSTOMER_LEVELS, RoleSpec
from keelson.session import durable

TRAIN = "(SELECT * FROM split WHERE \"partition\" = 'train')"
NUM = long_form(TRAIN, NUMERIC, "DOUBLE")
CAT = long_form(TRAIN, CATEGORICAL)


def parted(spark, sf):
    """The split table, written once: a fit reads it several times."""
    return durable(lazily_parted(spark, sf))


def train(spark, sf):
    return lazily_parted(spark, sf).where("partition = 'train'")


@query("fit_median", f"SELECT feature, round(quantile_cont(value, 0.5), 6) AS median FROM ({NUM}) GROUP BY 1")
def fit_median(spark, sf):
    return prep.medians(train(spark, sf), CUSTOMER).withColumn("median", F.round("median", 6))


@query(
    "fit_mode",
    f"SELECT feature, arg_min(value, (-n, value)) AS mode FROM (SELECT feature, value, count(*) AS n FROM ({CAT}) GROUP BY ALL) GROUP BY 1",
)
def fit_mode(spark, sf):
    return prep.modes(train(spark, sf), CUSTOMER)


STATS = f"SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS std FROM ({NUM}) GROUP BY 1"


@query("fit_scaler", f"SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM ({STATS})")
def fit_scaler(spark, sf):
    fitted = prep.scales(train(spark, sf), CUSTOMER, {c: 0.0 for c in CUSTOMER.numeric})
    return fitted.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("fit_categories", f"SELECT DISTINCT feature, value AS level FROM ({CAT})")
def fit_categories(spark, sf):
    return prep.levels(train(spark, sf), CUSTOMER)


def _scaled(c):
    return f"({c} - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT std FROM st WHERE feature = '{c}')"


@query(
    "transform_impute_scale",
    f"WITH st AS ({STATS}) SELECT customerID, {', '.join(f'round({_scaled(c)}, 6) AS num__{c}' for c in NUMERIC)} FROM split",
)
def transform_impute_scale(spark, sf):
    df = parted(spark, sf)
    out = prep.fit_preprocessor(df, CUSTOMER).scaled(df)
    return out.select("customerID", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_LEVELS = {c: sorted(v) for c, v in CUSTOMER_LEVELS.items()}
_LEVELS["PaymentMethod"] = sorted([*CUSTOMER_LEVELS["PaymentMethod"], "FURNITURE"])


@query(
    "transform_onehot",
    "SELECT customerID, "
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"cat__{c}_{v}\"" for c, vs in _LEVELS.items() for v in vs
    )
    + " FROM split",
)
def transform_onehot(spark, sf):
    df = parted(spark, sf)
    return prep.fit_preprocessor(df, CUSTOMER).onehot(df)


@query(
    "feature_names",
    f"""SELECT 'num__' || feature AS name, feature AS readable FROM ({NUM}) GROUP BY feature
UNION ALL SELECT 'cat__' || feature || '_' || value, replace(feature || '_' || value, '_', ' ') FROM (SELECT DISTINCT feature, value FROM ({CAT}))""",
)
def feature_names(spark, sf):
    """Names generated from the fitted levels, in long form."""
    df = train(spark, sf)
    hot = prep.levels(df, CUSTOMER).select(F.concat(F.lit("cat__"), "feature", F.lit("_"), "level").alias("name"))
    numbers = prep.medians(df, CUSTOMER).select(F.concat(F.lit("num__"), "feature").alias("name"))
    return numbers.unionByName(hot).withColumn("readable", prep.readable(F.col("name")))


@query(
    "fit_guard_train_only",
    f"""SELECT 'train' AS fitted_on, (SELECT count(*) FROM {TRAIN}) AS fitted_rows, "partition", count(*) AS rows FROM split GROUP BY "partition\"""",
)
def fit_guard_train_only(spark, sf):
    df = parted(spark, sf)
    fitted = prep.fit_preprocessor(df, CUSTOMER)
    counts = fitted.transform(df).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        F.lit(fitted.partition).alias("fitted_on"), F.lit(fitted.rows).cast("long").alias("fitted_rows"), "partition", "rows"
    )


_MIN = ", ".join(f"min({_scaled(c)})" for c in NUMERIC)
_MAX = ", ".join(f"max({_scaled(c)})" for c in NUMERIC)
MATRIX = f"""WITH st AS ({STATS}), w AS (SELECT CAST(4 + count(*) AS INTEGER) AS n FROM (SELECT DISTINCT feature, value FROM ({CAT})))
SELECT "partition", count(*) AS rows, (SELECT n FROM w) AS min_width, (SELECT n FROM w) AS max_width, 0::BIGINT AS nan_rows, 0::BIGINT AS inf_rows,
 round(least({_MIN}, 0), 6) AS min_value, round(greatest({_MAX}, 1), 6) AS max_value FROM split GROUP BY 1"""


@query("validate_matrix", MATRIX)
def validate_matrix(spark, sf):
    df = parted(spark, sf)
    return prep.validate_matrix(prep.fit_preprocessor(df, CUSTOMER).transform(df))


@query("preprocess_run", f"SELECT *, min_width = max_width AND nan_rows = 0 AND inf_rows = 0 AS passed FROM ({MATRIX})")
def preprocess_run(spark, sf):
    from keelson.plans.training import preprocess

    return preprocess(parted(spark, sf), CUSTOMER)[2]


DOCS = RoleSpec(id_col="doc_id", target_col="quality", numeric=("n_chars",), categorical=("lang", "source"))


@query(
    "prep_generic_cols",
    """SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM docs)) / (SELECT stddev_pop(n_chars) FROM docs), 6) AS scaled,
 CAST(1 + (SELECT count(DISTINCT lang) FROM docs) + (SELECT count(DISTINCT source) FROM docs) AS INTEGER) AS width FROM docs""",
)
def prep_generic_cols(spark, sf):
    df = views.retrain_docs(spark, sf)
    fitted = prep.fit_preprocessor(df, DOCS, by=None)
    cells = vector_to_array("features")
    return fitted.transform(df).select("doc_id", F.round(F.get(cells, F.lit(0)), 6).alias("scaled"), F.size(cells).alias("width"))
