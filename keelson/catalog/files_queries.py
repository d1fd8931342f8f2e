"""Sources and sinks: each query writes or reads whole tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.metrics_queries import SWEEP, labelled
from keelson.catalog.policy_queries import RANKED, THRESHOLD
from keelson.catalog.profiling_queries import cleaned
from keelson.catalog.registry import query
from keelson.catalog.split_queries import parted
from keelson.operators import metrics, policy
from keelson.plans import views
from keelson.roles import CUSTOMER
from keelson.session import scratch_path
from keelson.sources import files


@query("scan_raw_csv", "SELECT * FROM snapshot")
def scan_raw_csv(spark, sf):
    path = files.write_csv(views.snapshot(spark, sf), scratch_path(spark, "raw"))
    return files.read_raw_csv(spark, path)


@query("scan_upload_csv", "SELECT customerID, CAST(tenure AS VARCHAR) AS tenure, TotalCharges, Contract, Churn FROM snapshot")
def scan_upload_csv(spark, sf):
    df = views.snapshot(spark, sf).select("customerID", "tenure", "TotalCharges", "Contract", "Churn")
    messy = df.toDF("Customer ID", "TENURE", "total_charges", " contract ", "churn")
    path = files.write_csv(messy, scratch_path(spark, "upload"))
    return files.read_upload_csv(spark, path).select("customerID", "tenure", "TotalCharges", "Contract", "Churn")


@query(
    "scan_json_records",
    "SELECT CASE WHEN tenure = 0 THEN 'K' || customerID ELSE customerID END AS primary_key, tenure, TotalCharges, Churn FROM snapshot",
)
def scan_json_records(spark, sf):
    df = views.snapshot(spark, sf).select("customerID", "tenure", "TotalCharges", "Churn")
    keyed = df.withColumn("account", F.when(F.col("tenure") == 0, F.concat(F.lit("K"), "customerID")))
    path = files.write_json(keyed, scratch_path(spark, "records"))
    records = files.read_json_records(spark, path, keyed.schema, "account")
    return records.select("primary_key", "tenure", "TotalCharges", "Churn")


@query("scan_report_csv", f"SELECT threshold, total_cost, 'Sigmoid (Platt)' AS method FROM ({SWEEP})")
def scan_report_csv(spark, sf):
    swept = metrics.sweep(labelled(spark, sf), "p", "y", digits=6).select("threshold", "total_cost")
    both = swept.withColumn("method", F.explode(F.array(F.lit("Uncalibrated"), F.lit("Sigmoid (Platt)"))))
    path = files.write_csv(both, scratch_path(spark, "report"))
    report = files.read_report_csv(spark, path, "threshold double, total_cost long, method string")
    return files.pick_report(report, "method", "SIGMOID")


@query("sink_cleaned", "SELECT * FROM cleaned")
def sink_cleaned(spark, sf):
    return spark.read.parquet(files.write_table(cleaned(spark, sf), scratch_path(spark, "cleaned")))


@query("sink_manifest_json", """SELECT customerID, "partition" FROM split""")
def sink_manifest_json(spark, sf):
    manifest = parted(spark, sf).select("customerID", "partition")
    path = files.write_json(manifest, scratch_path(spark, "manifest"))
    return spark.read.schema(manifest.schema).json(path)


@query("sink_report_csv", SWEEP)
def sink_report_csv(spark, sf):
    swept = metrics.sweep(labelled(spark, sf), "p", "y", digits=6)
    path = files.write_csv(swept, scratch_path(spark, "sweep"))
    return spark.read.schema(swept.schema).option("header", True).csv(path)


@query("sink_report_json", f"SELECT threshold, recall, total_cost FROM ({SWEEP})")
def sink_report_json(spark, sf):
    swept = metrics.sweep(labelled(spark, sf), "p", "y", digits=6)
    path = files.write_json(swept, scratch_path(spark, "sweep-json"))
    return spark.read.schema("threshold double, recall double, total_cost long").json(path)


@query("sink_prediction_log", "SELECT customerID, p, 'scored' AS model_version, true AS stamped FROM scored")
def sink_prediction_log(spark, sf):
    path = scratch_path(spark, "prediction-log")
    entries = views.scored(spark, sf).select("customerID", "p").withColumn("model_version", F.lit("scored"))
    files.append_log(entries, path)
    log = spark.read.schema("timestamp string, customerID string, p double, model_version string").json(path)
    return log.select("customerID", "p", "model_version", F.col("timestamp").try_cast("timestamp").isNotNull().alias("stamped"))


@query("sink_predictions_csv", f"SELECT primary_key, churn_probability, risk_level FROM ({RANKED} FROM scored) WHERE retention_recommended = 1")
def sink_predictions_csv(spark, sf):
    ranked = policy.rank_scores(views.scored(spark, sf), CUSTOMER, THRESHOLD, details=())
    flagged = ranked.where("retention_recommended = 1").select("primary_key", "churn_probability", "risk_level")
    path = files.write_csv(flagged, scratch_path(spark, "predictions"))
    return spark.read.schema(flagged.schema).option("header", True).csv(path)


