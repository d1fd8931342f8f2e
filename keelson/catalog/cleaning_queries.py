"""Cleaning, validation and request checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.views_sql import CATEGORICAL, COLUMNS, NUMERIC, number
from keelson.operators import cleaning, compat, policy
from keelson.plans import views
from keelson.roles import CUSTOMER, CUSTOMER_LEVELS, INTERNET_FIELDS, NO_INTERNET, NO_PHONE

TEN = number("tenure")
CHG = number("TotalCharges")
BLANK = "coalesce(trim(TotalCharges) = '', false)"
ZERO = f"coalesce(({TEN}) = 0, false)"


@query("scan_cleaned", "SELECT * FROM cleaned")
def scan_cleaned(spark, sf):
    return cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER)


@query("clean_blank_numeric", "SELECT customerID, tenure, MonthlyCharges, TotalCharges FROM cleaned")
def clean_blank_numeric(spark, sf):
    return cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER).select(
        "customerID", "tenure", "MonthlyCharges", "TotalCharges"
    )


@query(
    "clean_violations",
    f"""SELECT customerID, tenure, TotalCharges, code FROM (
SELECT *, CASE WHEN NOT {BLANK} AND ({CHG}) IS NULL THEN 'not_numeric' WHEN {BLANK} AND NOT {ZERO} THEN 'blank_with_tenure' END AS code
FROM upload) WHERE code IS NOT NULL""",
)
def clean_violations(spark, sf):
    return cleaning.charge_violations(views.upload(spark, sf), CUSTOMER)


@query(
    "clean_audit",
    """SELECT customerID, tenure, MonthlyCharges, '' AS TotalCharges_before, 0.0::DOUBLE AS TotalCharges_after,
'imputed_zero_for_new_customer' AS action FROM snapshot WHERE trim(TotalCharges) = '' AND tenure = 0""",
)
def clean_audit(spark, sf):
    return cleaning.cleaning_audit(views.snapshot(spark, sf), CUSTOMER)


@query(
    "clean_guard_duplicates",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM upload)) AS duplicate_rows,
count(DISTINCT customerID) AS distinct_ids, count(DISTINCT customerID) = count(*) AS id_unique FROM upload""",
)
def clean_guard_duplicates(spark, sf):
    return cleaning.duplicate_guard(views.upload(spark, sf), "customerID")


@query(
    "clean_guard_invariants",
    """SELECT s.Churn, rows_before, rows_after, missing_after, rows_before = rows_after AND missing_after = 0 AS unchanged
FROM (SELECT Churn, count(*) AS rows_before FROM snapshot GROUP BY 1) s
JOIN (SELECT Churn, count(*) AS rows_after, count(*) FILTER (TotalCharges IS NULL) AS missing_after FROM cleaned GROUP BY 1) c
ON s.Churn = c.Churn""",
)
def clean_guard_invariants(spark, sf):
    raw = views.snapshot(spark, sf)
    return cleaning.cleaning_invariants(raw, cleaning.clean_charges(raw, CUSTOMER), CUSTOMER)


@query(
    "clean_summary",
    """SELECT count(*) AS rows_before, count(*) AS rows_after, 21 AS columns_before, 21 AS columns_after,
count(*) FILTER (trim(TotalCharges) = '' AND tenure = 0) AS imputed_rows FROM snapshot""",
)
def clean_summary(spark, sf):
    return cleaning.cleaning_summary(views.snapshot(spark, sf), CUSTOMER)


NULLS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in COLUMNS)


@query(
    "validate_cleaned",
    f"""SELECT *, duplicate_rows = 0 AND duplicate_ids = 0 AND missing_values_total = 0 AS passed FROM (
SELECT count(*) AS row_count, 21 AS column_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS duplicate_rows,
  count(*) - count(DISTINCT customerID) AS duplicate_ids, CAST(sum({NULLS}) AS BIGINT) AS missing_values_total,
  count(*) FILTER (TotalCharges IS NULL) AS charges_missing,
  count(*) FILTER (Churn = 'No') AS label_no, count(*) FILTER (Churn = 'Yes') AS label_yes FROM cleaned)""",
)
def validate_cleaned(spark, sf):
    return cleaning.validate_cleaned(cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER), CUSTOMER)


@query("separate_roles", f"SELECT {', '.join(COLUMNS)} FROM cleaned")
def separate_roles(spark, sf):
    return cleaning.separate(cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER), CUSTOMER)


@query("scan_separated", f"SELECT customerID, {', '.join(NUMERIC + CATEGORICAL)} FROM cleaned")
def scan_separated(spark, sf):
    cleaned = cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER)
    return cleaning.separate(cleaned, CUSTOMER, check=False).drop(CUSTOMER.target_col)


@query(
    "validate_separation",
    """SELECT *, id_unique AND label_other = 0 AND label_no > 0 AND label_yes > 0 AS passed FROM (
SELECT count(*) AS row_count, 19 AS feature_count, 4 AS numeric_feature_count, 15 AS categorical_feature_count,
 false AS identifier_in_features, false AS target_in_features, count(DISTINCT customerID) = count(*) AS id_unique,
 count(*) FILTER (Churn = 'No') AS label_no, count(*) FILTER (Churn = 'Yes') AS label_yes,
 count(*) FILTER (Churn NOT IN ('No', 'Yes')) AS label_other FROM cleaned)""",
)
def validate_separation(spark, sf):
    cleaned = cleaning.clean_charges(views.snapshot(spark, sf), CUSTOMER)
    return cleaning.validate_separation(cleaned, CUSTOMER)


@query("encode_label", "SELECT customerID, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS y FROM snapshot")
def encode_label(spark, sf):
    from keelson.functions.scalars import encode_label as encoded

    return views.snapshot(spark, sf).select("customerID", encoded("Churn").alias("y"))


@query(
    "normalize_binary_target",
    """SELECT 'upload' AS source, lower(trim(Churn)) AS spelling,
  CASE WHEN lower(trim(Churn)) IN ('yes','true','1','churn') THEN 'Yes'
       WHEN lower(trim(Churn)) IN ('no','false','0','no churn','not churn') THEN 'No' END AS label, count(*) AS n
FROM upload GROUP BY ALL
UNION ALL
SELECT 'docs', CAST(quality AS VARCHAR), CASE WHEN quality = (SELECT min(quality) FROM docs) THEN 'No' ELSE 'Yes' END, count(*)
FROM docs GROUP BY ALL""",
)
def normalize_binary_target(spark, sf):
    text = cleaning.target_spellings(views.upload(spark, sf), "Churn").select(
        F.lit("upload").alias("source"), "spelling", "label", "n"
    )
    numeric = (
        cleaning.normalize_target(views.retrain_docs(spark, sf), "quality")
        .groupBy(F.col("quality").cast("string").alias("spelling"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("docs").alias("source"), "spelling", "label", "n")
    )
    return text.unionByName(numeric)


@query(
    "validate_retrain",
    """SELECT unnest([1,2,3,4,5,6,7]) AS step,
 unnest(['too_few_rows','unknown_target','not_two_classes','small_class','id_repeated','no_features','constant_feature']) AS code,
 unnest([n, 0, classes, small, n - ids, 3, constants]) AS value,
 unnest([n < 100, false, classes <> 2, small < 5, n <> ids, false, constants > 0]) AS failed
FROM (SELECT count(*) AS n, count(DISTINCT quality) AS classes, count(DISTINCT doc_id) AS ids,
 least(count(*) FILTER (quality = 0), count(*) FILTER (quality = 1)) AS small,
 CAST(count(DISTINCT n_chars) <= 1 AS BIGINT) + CAST(count(DISTINCT lang) <= 1 AS BIGINT) + CAST(count(DISTINCT source) <= 1 AS BIGINT) AS constants
 FROM docs)""",
)
def validate_retrain(spark, sf):
    return cleaning.retrain_checks(views.retrain_docs(spark, sf), "quality", "doc_id")


_FIXED = ", ".join(
    [f"CASE WHEN InternetService = 'No' THEN '{NO_INTERNET}' ELSE {c} END AS {c}" for c in INTERNET_FIELDS]
    + [f"CASE WHEN PhoneService = 'No' THEN '{NO_PHONE}' ELSE MultipleLines END AS MultipleLines"]
)


@query("service_normalize", f"SELECT customerID, InternetService, PhoneService, {_FIXED} FROM snapshot")
def service_normalize(spark, sf):
    return policy.normalize_services(views.snapshot(spark, sf), CUSTOMER).select(
        "customerID", "InternetService", "PhoneService", *INTERNET_FIELDS, "MultipleLines"
    )


@query(
    "service_normalize_notes",
    " UNION ALL ".join(
        [
            f"SELECT customerID, '{c}' AS field, '{c} was set to ''{NO_INTERNET}'' because Internet Service is No.' AS note FROM snapshot WHERE InternetService = 'No' AND {c} <> '{NO_INTERNET}'"
            for c in INTERNET_FIELDS
        ]
        + [
            f"SELECT customerID, 'MultipleLines', 'Multiple Lines was set to ''{NO_PHONE}'' because Phone Service is No.' FROM snapshot WHERE PhoneService = 'No' AND MultipleLines <> '{NO_PHONE}'"
        ]
    ),
)
def service_normalize_notes(spark, sf):
    return policy.service_notes(views.snapshot(spark, sf), CUSTOMER)


_INT = {c: f"CASE WHEN ({number(c)}) = floor({number(c)}) THEN CAST({number(c)} AS INTEGER) END" for c in ("SeniorCitizen", "tenure")}


@query(
    "prep_record",
    f"""SELECT customerID, {_INT['SeniorCitizen']} AS SeniorCitizen, {_INT['tenure']} AS tenure,
 {number('MonthlyCharges')} AS MonthlyCharges, CASE WHEN {BLANK} AND {ZERO} THEN 0.0::DOUBLE ELSE {CHG} END AS TotalCharges,
 CASE WHEN TotalCharges IS NULL THEN 'TotalCharges:missing' WHEN {BLANK} AND NOT {ZERO} THEN 'TotalCharges:blank'
  WHEN NOT {BLANK} AND ({CHG}) IS NULL THEN 'TotalCharges:number'
  WHEN ({number('SeniorCitizen')}) IS NULL THEN 'SeniorCitizen:integer' WHEN ({TEN}) IS NULL THEN 'tenure:integer'
  WHEN ({number('MonthlyCharges')}) IS NULL THEN 'MonthlyCharges:number' END AS problem
FROM upload""",
)
def prep_record(spark, sf):
    return policy.prepare_features(views.upload(spark, sf), CUSTOMER).select(
        "customerID", *CUSTOMER.numeric, "problem"
    )


@query(
    "prep_batch",
    f"""SELECT customerID AS primary_key, tenure, MonthlyCharges, CASE WHEN trim(TotalCharges) = '' THEN 0.0::DOUBLE ELSE CAST(TotalCharges AS DOUBLE) END AS TotalCharges,
 CASE WHEN InternetService = 'No' THEN '{NO_INTERNET}' ELSE TechSupport END AS TechSupport,
 TotalCharges AS raw_charges, TechSupport AS raw_support, Churn FROM snapshot""",
)
def prep_batch(spark, sf):
    incoming = views.snapshot(spark, sf).withColumnsRenamed({"customerID": "account", "tenure": "months"})
    ready = policy.prepare_batch(incoming, CUSTOMER, "account", {"account": "customerID", "months": "tenure"})
    return ready.select(
        "primary_key",
        "tenure",
        "MonthlyCharges",
        "TotalCharges",
        "TechSupport",
        F.col("raw.TotalCharges").alias("raw_charges"),
        F.col("raw.TechSupport").alias("raw_support"),
        "Churn",
    )


def _constraint_sql() -> str:
    parts = [
        f"CASE WHEN ({number('SeniorCitizen')}) IS NULL OR ({number('SeniorCitizen')}) <> floor({number('SeniorCitizen')}) THEN 'SeniorCitizen:integer' END",
        f"CASE WHEN ({number('SeniorCitizen')}) < 0 OR ({number('SeniorCitizen')}) > 1 THEN 'SeniorCitizen:range' END",
        f"CASE WHEN ({TEN}) IS NULL OR ({TEN}) <> floor({TEN}) THEN 'tenure:integer' END",
        f"CASE WHEN ({TEN}) < 0 OR ({TEN}) > 100 THEN 'tenure:range' END",
        f"CASE WHEN ({number('MonthlyCharges')}) IS NULL THEN 'MonthlyCharges:number' END",
        f"CASE WHEN ({number('MonthlyCharges')}) < 0 THEN 'MonthlyCharges:range' END",
        "CASE WHEN TotalCharges IS NULL THEN 'TotalCharges:missing' END",
        f"CASE WHEN TotalCharges IS NOT NULL AND NOT {BLANK} AND ({CHG}) IS NULL THEN 'TotalCharges:number' END",
        f"CASE WHEN {BLANK} AND NOT {ZERO} THEN 'TotalCharges:blank' END",
        f"CASE WHEN ({CHG}) < 0 THEN 'TotalCharges:range' END",
    ]
    for name, levels in CUSTOMER_LEVELS.items():
        listed = ", ".join(f"'{v}'" for v in levels)
        parts.append(f"CASE WHEN {name} IS NULL OR {name} NOT IN ({listed}) THEN '{name}:level' END")
    for name in INTERNET_FIELDS:
        parts.append(f"CASE WHEN InternetService = 'No' AND {name} IS DISTINCT FROM '{NO_INTERNET}' THEN '{name}:dependency' END")
    parts.append(f"CASE WHEN PhoneService = 'No' AND MultipleLines IS DISTINCT FROM '{NO_PHONE}' THEN 'MultipleLines:dependency' END")
    return f"SELECT customerID, concat_ws(';', {', '.join(parts)}) AS violations FROM upload"


@query("constraint_check", _constraint_sql())
def constraint_check(spark, sf):
    return policy.violations(views.upload(spark, sf), CUSTOMER).select("customerID", "violations")


_PATTERNS = ["cancel", "termination", "final invoice", "post-churn", "exit", "departure", "closed date", "end date"]


@query(
    "leakage_name_scan",
    f"""SELECT file, header, concat_ws(', ', {", ".join(f"CASE WHEN contains(lower(header), '{p}') THEN '{p}' END" for p in _PATTERNS)}) AS patterns
FROM headers WHERE {" OR ".join(f"contains(lower(header), '{p}')" for p in _PATTERNS)}""",
)
def leakage_name_scan(spark, sf):
    return compat.forbidden_headers(views.headers(spark, sf))
