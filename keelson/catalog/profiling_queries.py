"""Profiles and exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.views_sql import CATEGORICAL, COLUMNS, NUMERIC, long_form, number
from keelson.operators import cleaning, profiling, sketches
from keelson.plans import views
from keelson.roles import CUSTOMER, INTERNET_FIELDS, NO_INTERNET, NO_PHONE
from keelson.session import scratch_path
from keelson.sources.files import write_table


def cleaned(spark, sf):
    return cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER)


DTYPES = {"customerID": "string", "SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}


@query(
    "profile_shape",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{DTYPES.get(c, 'string')}' AS dtype, count(*) AS rows, 21 AS columns FROM snapshot"
        for i, c in enumerate(COLUMNS)
    ),
)
def profile_shape(spark, sf):
    return profiling.shape(views.snapshot(spark, sf))


@query("profile_head", "SELECT * FROM snapshot ORDER BY customerID LIMIT 5")
def profile_head(spark, sf):
    return views.snapshot(spark, sf).orderBy("customerID").limit(5)


NUM_LONG = long_form("cleaned", NUMERIC, "DOUBLE")
NUM_LABEL = long_form("cleaned", NUMERIC, "DOUBLE", "Churn")


@query(
    "profile_numeric",
    f"""SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
 max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
 round(quantile_cont(value, 0.75), 6) AS q75 FROM ({NUM_LONG}) GROUP BY feature""",
)
def profile_numeric(spark, sf):
    return profiling.numeric_profile(cleaned(spark, sf), CUSTOMER.numeric)


CAT_LONG = long_form("cleaned", CATEGORICAL)


@query(
    "profile_categorical",
    f"""SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM (SELECT feature, value, count(*) AS n FROM ({CAT_LONG}) GROUP BY ALL) GROUP BY feature""",
)
def profile_categorical(spark, sf):
    return profiling.categorical_profile(cleaned(spark, sf), CUSTOMER.categorical)


UP_COLS = [*COLUMNS, "segment", "nation_code"]


@query(
    "profile_missing",
    'SELECT * FROM (' + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim({c}) = '') AS blanks,
round(100 * count(*) FILTER ({c} IS NULL OR trim({c}) = '') / CAST(count(*) AS DOUBLE), 6) AS missing_pct FROM upload"""
        for c in UP_COLS
    ) + ') WHERE nulls + blanks > 0',
)
def profile_missing(spark, sf):
    return profiling.missing_profile(views.upload(spark, sf))


@query(
    "profile_duplicates",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM snapshot)) AS duplicate_rows,
count(DISTINCT customerID) AS distinct_ids, count(DISTINCT customerID) = count(*) AS id_unique FROM snapshot""",
)
def profile_duplicates(spark, sf):
    return cleaning.duplicate_guard(views.snapshot(spark, sf), "customerID")


NUNIQUE = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS \"unique\" FROM cleaned" for c in COLUMNS)


@query("profile_nunique", NUNIQUE)
def profile_nunique(spark, sf):
    return profiling.distinct_counts(cleaned(spark, sf))


LOW_HIGH = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count({c}) AS present, {f'min(CAST({c} AS DOUBLE))' if c in NUMERIC else 'NULL::DOUBLE'} AS low,"
    f" {f'max(CAST({c} AS DOUBLE))' if c in NUMERIC else 'NULL::DOUBLE'} AS high, true AS unique_held, true AS median_held FROM cleaned"
    for c in COLUMNS
)


@query("profile_sketch", LOW_HIGH)
def profile_sketch(spark, sf):
    """Sketches of seven parts, stored and merged; the flags hold them against exact counts and ranks."""
    df = cleaned(spark, sf)
    parts = df.withColumn("part", F.pmod(F.xxhash64("customerID"), F.lit(7)))
    path = write_table(sketches.build(parts, ["part"]), scratch_path(spark, "sketches"))
    said = sketches.read(sketches.merge(spark.read.parquet(path)))
    exact = profiling.distinct_counts(df).select("feature", F.col("unique").alias("exact"))
    medians = said.where("q50 IS NOT NULL").select("feature", "q50")
    ranks = (
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in CUSTOMER.numeric])))
        .join(medians, "feature")
        .groupBy("feature")
        .agg(F.avg((F.col("v") < F.col("q50")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("q50")).cast("double")).alias("upto"))
    )
    near = F.abs(F.col("unique") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact")
    middle = (F.col("below") - sketches.RANK_ERROR <= 0.5) & (F.col("upto") + sketches.RANK_ERROR >= 0.5)
    return said.join(exact, "feature").join(ranks, "feature", "left").select(
        "feature", "rows", "present", "low", "high", near.alias("unique_held"), F.coalesce(middle, F.col("q50").isNull()).alias("median_held")
    )


@query(
    "value_counts",
    "SELECT Churn, count(*) AS n, round(100 * count(*) / CAST((SELECT count(*) FROM snapshot) AS DOUBLE), 6) AS pct FROM snapshot GROUP BY 1",
)
def value_counts(spark, sf):
    return profiling.level_counts(views.snapshot(spark, sf), "Churn")


_NUMS = ", ".join(f"'{c}'" for c in NUMERIC)


@query(
    "column_role_profile",
    f"""SELECT feature, kind, "unique", CASE WHEN feature = 'customerID' THEN 'identifier' WHEN feature = 'Churn' THEN 'target'
 WHEN "unique" = 2 THEN 'binary' WHEN kind = 'object' AND "unique" > 2 THEN 'multi_class' ELSE kind END AS role
FROM (SELECT *, CASE WHEN feature IN ({_NUMS}) THEN 'numeric' ELSE 'object' END AS kind FROM ({NUNIQUE}))""",
)
def column_role_profile(spark, sf):
    return profiling.role_profile(cleaned(spark, sf), CUSTOMER)


@query(
    "suspicious_columns",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        [
            "SELECT 'TotalCharges' AS \"column\", 'number stored as text' AS note, count(*) AS n FROM snapshot",
            f"SELECT 'TotalCharges', 'blank or non-numeric values', count(*) FILTER (({number('TotalCharges')}) IS NULL) FROM snapshot",
            "SELECT 'customerID', 'key not unique', count(*) - count(DISTINCT customerID) FROM snapshot",
            "SELECT 'SeniorCitizen', '0/1 stored as a number', count(*) FROM snapshot",
            *[
                f"SELECT '{c}', 'has a sentinel level', count(*) FILTER ({c} = '{NO_INTERNET}') FROM snapshot"
                for c in INTERNET_FIELDS
            ],
            f"SELECT 'MultipleLines', 'has a sentinel level', count(*) FILTER (MultipleLines = '{NO_PHONE}') FROM snapshot",
        ]
    )
    + ") WHERE n > 0",
)
def suspicious_columns(spark, sf):
    return profiling.suspicious(views.snapshot(spark, sf), CUSTOMER)


_DICT = {
    "customerID": "identifier", "Churn": "target", "TotalCharges": "numeric, needs cleaning",
    "SeniorCitizen": "binary number", "tenure": "numeric", "MonthlyCharges": "numeric",
}


@query(
    "data_dictionary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{DTYPES.get(c, 'string')}' AS dtype, count(DISTINCT {c}) AS "unique",
 count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing,
 """
        + (
            f"'{_DICT[c]}'"
            if c in _DICT
            else f"CASE count(DISTINCT {c}) WHEN 2 THEN 'binary category' WHEN 3 THEN 'category with 3 levels' ELSE 'review' END"
        )
        + " AS note FROM snapshot"
        for c in COLUMNS
    ),
)
def data_dictionary(spark, sf):
    return profiling.data_dictionary(views.snapshot(spark, sf), CUSTOMER)


@query(
    "numeric_by_label",
    f"""SELECT feature, Churn, round(round(avg(value), 6), 2) AS mean, round(round(quantile_cont(value, 0.5), 6), 2) AS median,
 round(round(stddev_samp(value), 6), 2) AS std FROM ({NUM_LABEL}) GROUP BY ALL""",
)
def numeric_by_label(spark, sf):
    return profiling.numeric_by_label(cleaned(spark, sf), CUSTOMER)


@query(
    "histogram_by_label",
    """WITH e AS (SELECT min(MonthlyCharges) AS lo, (max(MonthlyCharges) - min(MonthlyCharges)) / 30.0::DOUBLE AS w FROM cleaned)
SELECT Churn, CAST(least(floor((MonthlyCharges - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM cleaned, e GROUP BY ALL""",
)
def histogram_by_label(spark, sf):
    return profiling.histogram(cleaned(spark, sf), "Churn", "MonthlyCharges")


@query(
    "boxplot_stats",
    """WITH q AS (SELECT Churn AS c, quantile_cont(MonthlyCharges, 0.25) AS q1, quantile_cont(MonthlyCharges, 0.5) AS median,
  quantile_cont(MonthlyCharges, 0.75) AS q3 FROM cleaned GROUP BY 1),
j AS (SELECT *, MonthlyCharges BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM cleaned JOIN q ON Churn = c)
SELECT Churn, round(first(q1), 6) AS q1, round(first(median), 6) AS median, round(first(q3), 6) AS q3,
 min(MonthlyCharges) FILTER (inside) AS whisker_low, max(MonthlyCharges) FILTER (inside) AS whisker_high,
 count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY Churn""",
)
def boxplot_stats(spark, sf):
    return profiling.boxplot(cleaned(spark, sf), "Churn", "MonthlyCharges")


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS corr FROM cleaned"
        for a in NUMERIC
        for b in NUMERIC
    ),
)
def correlation_matrix(spark, sf):
    return profiling.correlations(cleaned(spark, sf), CUSTOMER.numeric)


RATE = "count(*) AS customers, round(100 * count(*) FILTER (Churn = 'Yes') / CAST(count(*) AS DOUBLE), 6) AS rate_pct"


@query("rate_by_category", f"SELECT Contract AS category, {RATE} FROM cleaned GROUP BY 1")
def rate_by_category(spark, sf):
    return profiling.rate_by(cleaned(spark, sf), "Contract", CUSTOMER)


@query(
    "rate_by_band",
    f"""SELECT CASE WHEN tenure > -1 AND tenure <= 12 THEN '0-12 mo' WHEN tenure > 12 AND tenure <= 24 THEN '13-24 mo'
 WHEN tenure > 24 AND tenure <= 48 THEN '25-48 mo' WHEN tenure > 48 AND tenure <= 72 THEN '49-72 mo' END AS category, {RATE} FROM cleaned
GROUP BY 1 HAVING category IS NOT NULL""",
)
def rate_by_band(spark, sf):
    return profiling.rate_by(cleaned(spark, sf), profiling.tenure_band("tenure"), CUSTOMER)


RATES = f"SELECT feature, value AS category, {RATE} FROM ({long_form('cleaned', CATEGORICAL, 'VARCHAR', 'Churn')}) GROUP BY ALL"


@query(
    "rate_overview",
    f"""WITH r AS ({RATES})
(SELECT *, 'top' AS part FROM r ORDER BY rate_pct DESC, feature, category LIMIT 15)
UNION ALL (SELECT *, 'bottom' AS part FROM r ORDER BY rate_pct, feature, category LIMIT 5)""",
)
def rate_overview(spark, sf):
    return profiling.extremes(profiling.rate_overview(cleaned(spark, sf), CUSTOMER))


@query(
    "before_after",
    f"""SELECT 'Rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM cleaned UNION ALL SELECT 'Columns', '21'
UNION ALL SELECT 'TotalCharges dtype (raw)', 'string' UNION ALL SELECT 'TotalCharges dtype (cleaned)', 'double'
UNION ALL SELECT 'Blank/non-numeric TotalCharges (raw)', CAST(count(*) FILTER (({number('TotalCharges')}) IS NULL) AS VARCHAR) FROM snapshot
UNION ALL SELECT 'Missing values (cleaned)', CAST(sum({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in COLUMNS)}) AS VARCHAR) FROM cleaned
UNION ALL SELECT 'Duplicate rows (cleaned)', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS VARCHAR) FROM cleaned""",
)
def before_after(spark, sf):
    raw = views.snapshot(spark, sf)
    return profiling.before_after(raw, cleaning.clean_charges(raw, CUSTOMER), CUSTOMER)


@query(
    "probability_summary",
    """SELECT model, min(p) AS p_min, round(avg(p), 6) AS p_mean, max(p) AS p_max, count(*) FILTER (p >= 0.5::DOUBLE) AS predicted
FROM models GROUP BY 1""",
)
def probability_summary(spark, sf):
    return profiling.probability_summary(views.scored_models(spark, sf), "model", "p")


@query(
    "probability_histogram",
    "SELECT model, CAST(least(floor(p / (1.0::DOUBLE / 30.0::DOUBLE)), 29) AS INTEGER) AS bin, count(*) AS n FROM models GROUP BY ALL",
)
def probability_histogram(spark, sf):
    return profiling.histogram(views.scored_models(spark, sf), "model", "p", 30, (0.0, 1.0))
