"""Scoring decisions, ranking and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.views_sql import CATEGORICAL, long_form
from keelson.functions import scalars
from keelson.operators import cleaning, policy
from keelson.plans import flagship, views
from keelson.roles import CUSTOMER

THRESHOLD = 0.30
FLAG = "CASE WHEN p >= 0.3::DOUBLE THEN 1 ELSE 0 END"
LABEL = "CASE WHEN p >= 0.3::DOUBLE THEN 'Churn' ELSE 'No Churn' END"
BAND = "CASE WHEN p < 0.3::DOUBLE THEN 'Low' WHEN p < 0.5::DOUBLE THEN 'Elevated' ELSE 'High' END"
ACTION = f"CASE WHEN p >= 0.3::DOUBLE THEN '{scalars.ACTION_OUTREACH}' ELSE '{scalars.ACTION_ROUTINE}' END"


@query("decide_flag", f"SELECT customerID, p, {FLAG} AS retention_recommended FROM scored")
def decide_flag(spark, sf):
    df = views.scored(spark, sf)
    return df.select("customerID", "p", scalars.decision_flag("p", THRESHOLD).alias("retention_recommended"))


@query("decide_label", f"SELECT customerID, {LABEL} AS prediction FROM scored")
def decide_label(spark, sf):
    return views.scored(spark, sf).select("customerID", scalars.decision_label("p", THRESHOLD).alias("prediction"))


@query("risk_band", f"SELECT customerID, {BAND} AS risk_level FROM scored")
def risk_band(spark, sf):
    return views.scored(spark, sf).select("customerID", scalars.risk_band("p", THRESHOLD).alias("risk_level"))


@query("recommended_action", f"SELECT customerID, {ACTION} AS recommended_action FROM scored")
def recommended_action(spark, sf):
    flag = scalars.decision_flag("p", THRESHOLD)
    return views.scored(spark, sf).select("customerID", scalars.recommended_action(flag).alias("recommended_action"))


@query("filter_flagged", f"SELECT customerID, p, {BAND} AS risk_level FROM scored WHERE p >= 0.3::DOUBLE")
def filter_flagged(spark, sf):
    decided = policy.decide(views.scored(spark, sf), "p", THRESHOLD)
    return decided.where("retention_recommended = 1").select("customerID", "p", "risk_level")


RANKED = f"""SELECT customerID AS primary_key, round(p, 4) AS churn_probability, {LABEL} AS prediction, {BAND} AS risk_level,
 {FLAG} AS retention_recommended, {ACTION} AS recommended_action, 0.3::DOUBLE AS decision_threshold"""


@query(
    "score_rank",
    f"""{RANKED}, SeniorCitizen, tenure, MonthlyCharges,
 CASE WHEN trim(TotalCharges) = '' THEN 0.0::DOUBLE ELSE CAST(TotalCharges AS DOUBLE) END AS TotalCharges, gender, Partner, Dependents, PhoneService,
 CASE WHEN PhoneService = 'No' THEN 'No phone service' ELSE MultipleLines END AS MultipleLines, InternetService,
 {", ".join(f"CASE WHEN InternetService = 'No' THEN 'No internet service' ELSE {c} END AS {c}" for c in ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"])},
 Contract, PaperlessBilling, PaymentMethod, Churn AS actual_churn FROM scored""",
)
def score_rank(spark, sf):
    """Clean, repair services, score, decide and rank every customer."""
    return flagship.retention_list(views.scored(spark, sf), CUSTOMER, THRESHOLD)


@query("attach_ids", "SELECT customerID, p AS churn_probability, 0.3::DOUBLE AS decision_threshold FROM scored")
def attach_ids(spark, sf):
    return views.scored(spark, sf).select(
        "customerID", F.col("p").alias("churn_probability"), F.lit(THRESHOLD).alias("decision_threshold")
    )


@query("attach_actual", "SELECT s.customerID, p, c.Churn AS actual_churn FROM scored s LEFT JOIN snapshot c ON s.customerID = c.customerID")
def attach_actual(spark, sf):
    labels = views.snapshot(spark, sf).select("customerID", F.col("Churn").alias("actual_churn"))
    return views.scored(spark, sf).select("customerID", "p").join(labels, "customerID", "left")


@query(
    "batch_kpis",
    """SELECT count(*) AS scored, count(*) FILTER (p >= 0.3::DOUBLE) AS flagged, count(*) FILTER (p < 0.3::DOUBLE) AS routine,
count(*) FILTER (p >= 0.5::DOUBLE) AS high_risk FROM scored""",
)
def batch_kpis(spark, sf):
    return policy.batch_kpis(policy.decide(views.scored(spark, sf), "p", THRESHOLD))


@query(
    "batch_response",
    f"""SELECT *, (SELECT count(*) FROM scored) AS customers_scored, (SELECT count(*) FROM scored WHERE p >= 0.3::DOUBLE) AS outreach_flagged
FROM ({RANKED} FROM scored)""",
)
def batch_response(spark, sf):
    return flagship.batch_response(views.scored(spark, sf), CUSTOMER, THRESHOLD)


_PCT = "CAST(floor(round(p, 4) * 1000 + 0.5::DOUBLE) AS BIGINT)"


@query(
    "action_table",
    f"""SELECT customerID AS primary_key, CAST({_PCT} // 10 AS VARCHAR) || '.' || CAST({_PCT} % 10 AS VARCHAR) || '%' AS churn_probability,
 {BAND} AS risk_level, {LABEL} AS prediction, CASE WHEN p >= 0.3::DOUBLE THEN 'Yes — outreach' ELSE 'No — monitor' END AS retention_recommended,
 {ACTION} AS recommended_action, Churn AS actual_churn FROM scored""",
)
def action_table(spark, sf):
    return policy.action_table(policy.rank_scores(views.scored(spark, sf), CUSTOMER, THRESHOLD, details=()))


@query(
    "priority_topk",
    f"""SELECT customerID AS primary_key, round(p, 4) AS churn_probability, {BAND} AS risk_level, {ACTION} AS recommended_action,
 greatest((SELECT count(*) FROM scored WHERE p >= 0.3::DOUBLE) - 10, 0) AS remaining
FROM scored WHERE p >= 0.3::DOUBLE ORDER BY p DESC, customerID LIMIT 10""",
)
def priority_topk(spark, sf):
    return policy.priority_list(policy.decide(views.scored(spark, sf), "p", THRESHOLD), CUSTOMER)


@query("categorical_domains", f"SELECT DISTINCT feature, value AS level FROM ({long_form('cleaned', CATEGORICAL)}) WHERE value IS NOT NULL")
def categorical_domains(spark, sf):
    return policy.level_options(cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER), CUSTOMER.categorical)


@query("scan_sample_n", "SELECT * FROM snapshot ORDER BY customerID LIMIT 10")
def scan_sample_n(spark, sf):
    return views.snapshot(spark, sf).orderBy("customerID").limit(10)
