"""Split, folds, weights, resampling, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.profiling_queries import RATE, cleaned
from keelson.catalog.registry import query
from keelson.operators import combine, profiling, split
from keelson.plans import views
from keelson.roles import CUSTOMER


def parted(spark, sf):
    return split.stratified_split(cleaned(spark, sf), CUSTOMER)


@query("stratified_split", 'SELECT customerID, Churn, "partition" FROM split')
def stratified_split(spark, sf):
    return parted(spark, sf).select("customerID", "Churn", "partition")


SUMMARY = """SELECT "partition", count(*) AS n, count(*) FILTER (Churn = 'No') AS label_no, count(*) FILTER (Churn = 'Yes') AS label_yes,
 round(100 * count(*) FILTER (Churn = 'Yes') / CAST(count(*) AS DOUBLE), 6) AS yes_pct FROM split GROUP BY 1"""


@query("split_summary", SUMMARY)
def split_summary(spark, sf):
    return split.split_summary(parted(spark, sf), CUSTOMER, digits=6)


@query(
    "validate_split",
    f"""SELECT *, id_overlap = 0 AND yes_pct_spread <= greatest(0.1::DOUBLE, 100.0::DOUBLE / least(train_rows, validation_rows, test_rows)) AS passed FROM (
SELECT *, round(100 * train_rows / total_rows::DOUBLE, 6) AS train_pct, round(100 * validation_rows / total_rows::DOUBLE, 6) AS validation_pct,
 round(100 * test_rows / total_rows::DOUBLE, 6) AS test_pct FROM (
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n) FILTER ("partition" = 'train') AS BIGINT) AS train_rows,
 CAST(sum(n) FILTER ("partition" = 'validation') AS BIGINT) AS validation_rows, CAST(sum(n) FILTER ("partition" = 'test') AS BIGINT) AS test_rows,
 round(max(yes_pct) - min(yes_pct), 6) AS yes_pct_spread,
 (SELECT count(*) FROM (SELECT customerID FROM split GROUP BY 1 HAVING count(DISTINCT "partition") > 1)) AS id_overlap FROM ({SUMMARY})))""",
)
def validate_split(spark, sf):
    return split.validate_split(parted(spark, sf), CUSTOMER)


@query(
    "split_manifest",
    """SELECT customerID, "partition", 42 AS seed, 'stratified_two_stage' AS strategy FROM split""",
)
def split_manifest(spark, sf):
    return parted(spark, sf).select(
        "customerID", "partition", F.lit(42).alias("seed"), F.lit("stratified_two_stage").alias("strategy")
    )


@query(
    "kfold_stratified",
    """WITH t AS (SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY md5('cv|' || customerID), customerID) AS r,
  count(*) OVER (PARTITION BY Churn) AS n FROM split WHERE "partition" = 'train')
SELECT customerID, Churn, CAST(CASE WHEN r <= (n % 5) * (n // 5 + 1) THEN (r - 1) // (n // 5 + 1)
 ELSE (n % 5) + (r - 1 - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM t""",
)
def kfold_stratified(spark, sf):
    train = parted(spark, sf).where("partition = 'train'").select("customerID", "Churn")
    return split.assign_folds(train, CUSTOMER)


@query(
    "class_weight_pos",
    """SELECT count(*) FILTER (Churn = 'No') AS negatives, count(*) FILTER (Churn = 'Yes') AS positives,
 count(*) FILTER (Churn = 'No') / CAST(count(*) FILTER (Churn = 'Yes') AS DOUBLE) AS scale_pos_weight FROM split WHERE "partition" = 'train'""",
)
def class_weight_pos(spark, sf):
    return split.positive_weight(parted(spark, sf).where("partition = 'train'"), CUSTOMER)


@query(
    "class_weight_balanced",
    "SELECT Churn, count(*) AS n, (SELECT count(*) FROM cleaned) / CAST(2 * count(*) AS DOUBLE) AS weight FROM cleaned GROUP BY 1",
)
def class_weight_balanced(spark, sf):
    return split.balanced_weights(cleaned(spark, sf), CUSTOMER)


@query(
    "undersample",
    """SELECT customerID, Churn FROM (
SELECT customerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY hd, customerID) AS r FROM split WHERE "partition" = 'train')
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM split WHERE "partition" = 'train' GROUP BY Churn))""",
)
def undersample(spark, sf):
    train = parted(spark, sf).where("partition = 'train'").select("customerID", "Churn")
    return split.undersample(train, CUSTOMER)


@query("join_manifest", 'SELECT c.customerID, c.tenure, c.Churn, s."partition" FROM cleaned c JOIN split s ON c.customerID = s.customerID')
def join_manifest(spark, sf):
    manifest = parted(spark, sf).select("customerID", "partition")
    return combine.attach_manifest(cleaned(spark, sf).select("customerID", "tenure", "Churn"), manifest, "customerID")


@query("semi_partition", """SELECT customerID, tenure FROM cleaned WHERE customerID IN (SELECT customerID FROM split WHERE "partition" IN ('train', 'validation'))""")
def semi_partition(spark, sf):
    manifest = parted(spark, sf).select("customerID", "partition")
    df = cleaned(spark, sf).select("customerID", "tenure")
    return combine.keep_partitions(df, manifest, "customerID", ["train", "validation"])


@query(
    "anti_replace",
    """SELECT customerID, p FROM scored WHERE customerID NOT IN (SELECT customerID FROM models WHERE model = 'beta' AND y = 1)
UNION ALL SELECT customerID, p FROM models WHERE model = 'beta' AND y = 1""",
)
def anti_replace(spark, sf):
    existing = views.scored(spark, sf).select("customerID", "p")
    new = views.scored_models(spark, sf).where("model = 'beta' AND y = 1").select("customerID", "p")
    return combine.upsert(existing, new, "customerID")


@query("in_filter", "SELECT customerID, model, p FROM models WHERE model IN ('alpha', 'gamma')")
def in_filter(spark, sf):
    return views.scored_models(spark, sf).where(F.col("model").isin("alpha", "gamma")).select("customerID", "model", "p")


@query(
    "overlap_intersect",
    """SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(a * b) AS BIGINT) AS train_validation, CAST(sum(a * c) AS BIGINT) AS train_test,
 CAST(sum(b * c) AS BIGINT) AS validation_test FROM (
SELECT customerID, count(*) AS n, max(("partition" = 'train')::INT) AS a, max(("partition" = 'validation')::INT) AS b, max(("partition" = 'test')::INT) AS c
FROM split GROUP BY 1)""",
)
def overlap_intersect(spark, sf):
    return split.overlaps(parted(spark, sf), "customerID")


@query(
    "concat_union",
    f"SELECT 'Contract' AS feature, Contract AS category, {RATE} FROM cleaned GROUP BY 2 UNION ALL SELECT 'TechSupport', TechSupport, {RATE} FROM cleaned GROUP BY 2",
)
def concat_union(spark, sf):
    tables = [
        profiling.rate_by(cleaned(spark, sf), name, CUSTOMER).withColumn("feature", F.lit(name))
        for name in ("Contract", "TechSupport")
    ]
    return tables[0].unionByName(tables[1])


@query("nearest_threshold", "SELECT customerID, p FROM scored ORDER BY abs(p - 0.26::DOUBLE), customerID LIMIT 1")
def nearest_threshold(spark, sf):
    return combine.nearest(views.scored(spark, sf).select("customerID", "p"), "p", 0.26, "customerID")
