"""Header matching and upload compatibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog.registry import query
from keelson.catalog.views_sql import CATEGORICAL, COLUMNS, NUMERIC, number
from keelson.operators import compat
from keelson.plans import views
from keelson.roles import CUSTOMER, CUSTOMER_LEVELS, INTERNET_FIELDS, NO_INTERNET, NO_PHONE

NORM = r"regexp_replace(lower(trim(header)), '[\s_-]+', '_', 'g')"
FEATURES = NUMERIC + CATEGORICAL


def _list(names):
    return ", ".join(f"'{n}'" for n in names)


_ALIAS = "CASE " + NORM + " " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in compat.HEADER_ALIASES.items()) + " END"
_CI = "CASE {x} " + " ".join(f"WHEN '{c.lower()}' THEN '{c}'" for c in COLUMNS) + " END"
RESOLVED = f"""SELECT *, CASE WHEN exact IS NOT NULL THEN 0 WHEN alias IS NOT NULL THEN 1 WHEN ci IS NOT NULL THEN 2 END AS priority,
 coalesce(exact, alias, ci) AS target FROM (SELECT file, position, header,
 CASE WHEN trim(header) IN ({_list(COLUMNS)}) THEN trim(header) END AS exact, {_ALIAS} AS alias,
 coalesce({_CI.format(x=NORM)}, {_CI.format(x="lower(trim(header))")}) AS ci FROM headers)"""


@query("header_normalize", f"SELECT file, position, header, {NORM} AS normalized FROM headers")
def header_normalize(spark, sf):
    return views.headers(spark, sf).select("file", "position", "header", compat.normal_header("header").alias("normalized"))


@query("header_resolve", f"SELECT file, position, header, target, priority FROM ({RESOLVED})")
def header_resolve(spark, sf):
    return compat.resolve_headers(views.headers(spark, sf))


# sequence similarity of at least 0.85: every expected name with one letter more
NEAR_MISSES = ", ".join(f"('{c}x', '{c}')" for c in COLUMNS)


@query(
    "header_suggest",
    f"""WITH resolved AS ({RESOLVED}),
near(header, target) AS (VALUES {NEAR_MISSES}),
close AS (SELECT r.file, r.position, r.header, n.target, 3 AS priority FROM resolved r JOIN near n ON trim(r.header) = n.header WHERE r.target IS NULL),
every AS (SELECT file, position, header, target, priority FROM resolved WHERE target IS NOT NULL UNION ALL SELECT * FROM close)
SELECT file, position, header, target, priority FROM (
 SELECT *, row_number() OVER (PARTITION BY file, target ORDER BY priority, position) AS rn FROM every) WHERE rn = 1 AND priority > 0""",
)
def header_suggest(spark, sf):
    return compat.suggest_headers(views.headers(spark, sf))


@query("header_rename", "SELECT * FROM snapshot")
def header_rename(spark, sf):
    messy = views.snapshot(spark, sf).toDF(
        *[(" " + c.upper() + " ") if i % 2 else c.lower() for i, c in enumerate(CUSTOMER.columns)]
    )
    return compat.rename_headers(messy)


@query("mapping_apply", 'SELECT customerID, tenure AS months, Contract AS plan FROM snapshot')
def mapping_apply(spark, sf):
    df = views.snapshot(spark, sf).select("customerID", "tenure", "Contract")
    return df.withColumnsRenamed({"tenure": "months", "Contract": "plan"})


@query(
    "readiness",
    f"""WITH resolved AS ({RESOLVED}),
need AS (SELECT unnest([{_list(FEATURES)}]) AS name, unnest(range({len(FEATURES)})) AS pos),
got AS (SELECT file, list(DISTINCT target) FILTER (target IN ({_list(FEATURES)})) AS got,
  list_sort(list(DISTINCT trim(header)) FILTER (target IS NULL)) AS extra FROM resolved GROUP BY file)
SELECT file, coalesce(len(got), 0) AS matched_count, 19 AS required_count,
 coalesce((SELECT string_agg(name, ',' ORDER BY pos) FROM need WHERE NOT list_contains(coalesce(g.got, []), name)), '') AS missing_columns,
 coalesce(array_to_string(extra, ','), '') AS extra_columns, coalesce(len(got), 0) = 19 AS ready_to_score FROM got g""",
)
def readiness(spark, sf):
    return compat.readiness(views.headers(spark, sf))


def _key_sql():
    parts = []
    for i, c in enumerate(COLUMNS):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, "
            f"count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS blanks, count(DISTINCT {c}) = count(*) AS distinct_ok FROM snapshot"
        )
    return f"""SELECT position, "column", nulls, blanks, ok AS is_unique,
 ok AND rank() OVER (ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, CASE WHEN "column" = 'customerID' THEN 0 ELSE 1 END, position) = 1 AS chosen
FROM (SELECT *, distinct_ok AND nulls = 0 AND blanks = 0 AS ok FROM ({" UNION ALL ".join(parts)}))"""


@query("detect_key", _key_sql())
def detect_key(spark, sf):
    return compat.detect_key(views.snapshot(spark, sf))


KEYS = """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (k IS NULL OR k = ''), 0) AS BIGINT) AS blank_keys,
 CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_members FROM (SELECT trim(customerID) AS k, count(*) AS n FROM upload GROUP BY 1)"""


@query("key_quality", KEYS)
def key_quality(spark, sf):
    return compat.key_quality(views.upload(spark, sf), "customerID")


TEN0 = f"coalesce(({number('tenure')}) = 0, false)"
_BAD = {c: f"({number(c)}) IS NULL" for c in NUMERIC}
_BAD["TotalCharges"] += f" AND NOT (coalesce(trim(TotalCharges) = '', false) AND {TEN0})"
_NUMQ = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({_BAD[c]}) AS non_numeric, "
    + (f"count(*) FILTER (({number(c)}) NOT IN (0, 1))" if c == "SeniorCitizen" else "0::BIGINT")
    + " AS not_binary, "
    + ("0::BIGINT" if c == "SeniorCitizen" else f"count(*) FILTER (({number(c)}) < 0)")
    + " AS negative FROM upload"
    for c in NUMERIC
)


@query("numeric_quality", _NUMQ)
def numeric_quality(spark, sf):
    return compat.numeric_quality(views.upload(spark, sf), CUSTOMER)


BLANK_CHARGE = f"(TotalCharges IS NULL OR trim(TotalCharges) = '') AND NOT {TEN0}"


@query("blank_charge_quality", f"SELECT count(*) FILTER ({BLANK_CHARGE}) AS blank_with_tenure FROM upload")
def blank_charge_quality(spark, sf):
    return compat.blank_charge_quality(views.upload(spark, sf), CUSTOMER)


def _bl(c):
    return f"({c} IS NULL OR trim({c}) = '')"


def _inv(c):
    return f"(NOT {_bl(c)} AND trim({c}) NOT IN ({_list(CUSTOMER_LEVELS[c])}))"


_CATQ = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({_bl(c)}) AS blank_cells, count(*) FILTER ({_inv(c)}) AS invalid_cells,
coalesce(array_to_string(list_slice(list_sort(list(DISTINCT trim({c})) FILTER ({_inv(c)})), 1, 10), '|'), '') AS invalid_levels FROM upload"""
    for c in CATEGORICAL
)


@query("categorical_quality", _CATQ)
def categorical_quality(spark, sf):
    return compat.categorical_quality(views.upload(spark, sf), CUSTOMER)


_SVC = [
    (c, "InternetService", f"trim(InternetService) = 'No' AND trim({c}) NOT IN ('', '{NO_INTERNET}')") for c in INTERNET_FIELDS
] + [("MultipleLines", "PhoneService", f"trim(PhoneService) = 'No' AND trim(MultipleLines) NOT IN ('', '{NO_PHONE}')")]


@query(
    "service_combo_issues",
    " UNION ALL ".join(f"SELECT customerID, '{c}' AS field, '{p}' AS parent FROM upload WHERE {w}" for c, p, w in _SVC),
)
def service_combo_issues(spark, sf):
    return compat.service_issues(views.upload(spark, sf), CUSTOMER)


_RANGE = " + ".join(
    f"count(*) FILTER (({number(c)}) {'NOT IN (0, 1)' if c == 'SeniorCitizen' else '< 0'})" for c in NUMERIC
)
_REPORT = f"""SELECT *, key_found AND missing_columns = '' AND numeric_issues = 0 AND range_issues = 0 AND blank_charges = 0
 AND blank_categories = 0 AND blank_keys = 0 AND duplicate_keys = 0 AS is_compatible FROM (
SELECT count(*) AS row_count, {" + ".join(f"count(*) FILTER ({_BAD[c]})" for c in NUMERIC)} AS numeric_issues,
 {_RANGE} AS range_issues, count(*) FILTER ({BLANK_CHARGE}) AS blank_charges,
 {" + ".join(f"count(*) FILTER ({_bl(c)})" for c in CATEGORICAL)} AS blank_categories,
 {" + ".join(f"CAST(count(*) FILTER ({_inv(c)}) > 0 AS BIGINT)" for c in CATEGORICAL)} AS invalid_columns,
 {" + ".join(f"count(*) FILTER ({w})" for _, _, w in _SVC)} AS service_issues,
 true AS key_found, (SELECT blank_keys FROM ({KEYS})) AS blank_keys, (SELECT duplicate_members FROM ({KEYS})) AS duplicate_keys,
 19 AS matched_count, '' AS missing_columns, 'segment,nation_code' AS extra_columns FROM upload)"""


@query("compat_report", _REPORT)
def compat_report(spark, sf):
    return compat.compatibility(views.upload(spark, sf), CUSTOMER, "customerID")


_MSG = " UNION ALL ".join(
    f"SELECT {i + 1} AS rank, '{code}' AS code, "
    + {"missing_columns": "0::BIGINT", "key_found": "0::BIGINT"}.get(code, code)
    + f" AS n, {str(code not in compat.WARNINGS).lower()} AS blocking, '{text}' AS message FROM report"
    for i, (code, text) in enumerate(compat.MESSAGES)
)


@query("compat_messages", f"WITH report AS ({_REPORT}) SELECT * FROM ({_MSG}) WHERE n > 0")
def compat_messages(spark, sf):
    return compat.messages(compat.compatibility(views.upload(spark, sf), CUSTOMER, "customerID"))


_ISSUES = f"""SELECT code, "column", n, '' AS detail FROM (SELECT 'duplicate_keys' AS code, 'customerID' AS "column", duplicate_members AS n FROM ({KEYS})
 UNION ALL SELECT 'blank_keys', 'customerID', blank_keys FROM ({KEYS})
 UNION ALL SELECT 'non_numeric', "column", non_numeric FROM ({_NUMQ}) UNION ALL SELECT 'not_binary', "column", not_binary FROM ({_NUMQ})
 UNION ALL SELECT 'negative', "column", negative FROM ({_NUMQ})
 UNION ALL SELECT 'blank_with_tenure', 'TotalCharges', count(*) FILTER ({BLANK_CHARGE}) FROM upload
 UNION ALL SELECT 'blank_cells', "column", blank_cells FROM ({_CATQ}))
UNION ALL SELECT 'invalid_cells', "column", invalid_cells, invalid_levels FROM ({_CATQ})"""
_RULES = ", ".join(f"({i + 1}, '{c}', {str(b).lower()}, '{m}')" for i, (c, (b, m)) in enumerate(compat.COLUMN_RULES.items()))


def renamed_upload(spark, sf):
    """The upload as a file whose headers are not the expected ones."""
    return views.upload(spark, sf).withColumnsRenamed({"tenure": "months", "MonthlyCharges": "monthly_charges"})


@query(
    "compat_column_issues",
    f"""SELECT r.rank, i.code, "column", n, blocking, replace(replace(replace(message, '{{column}}', "column"), '{{n}}', CAST(n AS VARCHAR)), '{{detail}}', detail) AS message
FROM ({_ISSUES}) i JOIN (VALUES {_RULES}) r(rank, code, blocking, message) ON i.code = r.code WHERE n > 0""",
)
def compat_column_issues(spark, sf):
    return compat.column_issues(renamed_upload(spark, sf), CUSTOMER, "customerID", {"months": "tenure", "monthly_charges": "MonthlyCharges"})


@query(
    "compat_mapped_report",
    f"""SELECT row_count, 18 AS matched_count, 'MonthlyCharges' AS missing_columns, duplicate_members AS duplicate_keys, '{{"months": "tenure"}}' AS column_mapping,
 '{{"monthly_charges": "MonthlyCharges"}}' AS rename_suggestions, false AS is_compatible,
 concat_ws('|', 'Column MonthlyCharges is missing; map a column of the file to it.',
  CASE WHEN duplicate_members > 0 THEN duplicate_members || ' rows share a key in customerID; every row needs its own.' END,
  CASE WHEN blank_keys > 0 THEN 'customerID is blank in ' || blank_keys || ' rows; fill in a key.' END) AS messages,
 concat_ws('|', 'Map columns of the file to the 19 required ones.', 'Look up the required columns in the data dictionary.',
  CASE WHEN duplicate_members > 0 THEN 'Remove or correct repeated keys in ''customerID''.' END,
  CASE WHEN blank_keys > 0 THEN 'Correct the blocking issues, then check the file again.' END) AS actions
FROM ({KEYS}), (SELECT count(*) AS row_count FROM upload)""",
)
def compat_mapped_report(spark, sf):
    """A file mapped in part: what is missing, what is suggested, and what to do."""
    report = compat.mapped_report(renamed_upload(spark, sf), CUSTOMER, "customerID", {"months": "tenure"})
    kept = ("row_count", "matched_count", "missing_columns", "duplicate_keys", "column_mapping", "rename_suggestions", "is_compatible")
    return report.select(*kept, *[F.array_join(c, "|").alias(c) for c in ("messages", "actions")])
