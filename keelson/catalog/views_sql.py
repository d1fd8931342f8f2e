"""The derived views as ANSI SQL, written apart from the Spark code as a cross-check."""

from __future__ import annotations

import re

# fixed values: dates and digest digits of the derived views
_YN = "CASE WHEN substr(hx,{d},1) < '{b}' THEN 'Yes' ELSE 'No' END AS {n}"
_LV = "CASE WHEN substr(hx,{d},1) < '6' THEN 'Yes' WHEN substr(hx,{d},1) < 'e' THEN 'No' ELSE '{s}' END AS {n}"
_NET = "No internet service"


def _base(day: str, end: str) -> str:
    y, m = int(day[:4]), int(day[5:7])
    return f"""
SELECT custkey, 'C' || custkey AS customerID, md5('f|C' || custkey) AS hx, c_nationkey, c_acctbal, c_mktsegment,
  n_prior, n_next, tenure, sum_prior,
  coalesce(CAST(sum_prior * 100 AS BIGINT) // greatest(tenure, 1), 0) AS monthly_cents
FROM (SELECT c_custkey AS custkey, c_nationkey, c_acctbal, c_mktsegment, coalesce(n_prior, 0) AS n_prior,
    coalesce(n_next, 0) AS n_next, sum_prior,
    coalesce(({y} - year(first_prior)) * 12 + ({m} - month(first_prior)), 0) AS tenure
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '{day}') AS n_prior,
      min(o_orderdate) FILTER (o_orderdate < TIMESTAMP '{day}') AS first_prior,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderdate < TIMESTAMP '{day}') AS DECIMAL(18,2)) AS sum_prior,
      count(*) FILTER (o_orderdate >= TIMESTAMP '{day}') AS n_next
    FROM orders WHERE o_orderdate < TIMESTAMP '{end}' GROUP BY o_custkey) ON c_custkey = o_custkey)"""


def _shaped(source: str, extra: str = "") -> str:
    return f"""
SELECT {extra} customerID, CAST(c_acctbal < 0 AS INTEGER) AS SeniorCitizen, CAST(tenure AS INTEGER) AS tenure,
  CAST(monthly_cents AS DOUBLE) / 100.0::DOUBLE AS MonthlyCharges,
  coalesce(CAST(sum_prior AS VARCHAR), ' ') AS TotalCharges,
  CASE WHEN substr(hx,1,1) < '8' THEN 'Female' ELSE 'Male' END AS gender,
  {_YN.format(d=2, b="8", n="Partner")}, {_YN.format(d=3, b="8", n="Dependents")}, {_YN.format(d=4, b="e", n="PhoneService")},
  {_LV.format(d=5, s="No phone service", n="MultipleLines")},
  CASE c_nationkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' ELSE 'Fiber optic' END AS InternetService,
  {_LV.format(d=6, s=_NET, n="OnlineSecurity")}, {_LV.format(d=7, s=_NET, n="OnlineBackup")},
  {_LV.format(d=8, s=_NET, n="DeviceProtection")}, {_LV.format(d=9, s=_NET, n="TechSupport")},
  {_LV.format(d=10, s=_NET, n="StreamingTV")}, {_LV.format(d=11, s=_NET, n="StreamingMovies")},
  CASE WHEN n_prior <= 2 THEN 'Month-to-month' WHEN n_prior <= 4 THEN 'One year' ELSE 'Two year' END AS Contract,
  {_YN.format(d=12, b="8", n="PaperlessBilling")},
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Electronic check' WHEN 'AUTOMOBILE' THEN 'Mailed check'
    WHEN 'MACHINERY' THEN 'Bank transfer (automatic)' WHEN 'HOUSEHOLD' THEN 'Credit card (automatic)'
    ELSE c_mktsegment END AS PaymentMethod,
  CASE WHEN n_next = 0 THEN 'Yes' ELSE 'No' END AS Churn
FROM {source}"""


def _score(salt: str, weight: str) -> str:
    u = f"CAST(('0x' || substr(md5('{salt}|' || customerID), 1, 3))::BIGINT AS DOUBLE) / 4096.0::DOUBLE"
    return f"0.55::DOUBLE * ({u}) + {weight}::DOUBLE * (CASE WHEN Churn = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.05::DOUBLE"


NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
]
COLUMNS = ["customerID", *NUMERIC, *CATEGORICAL, "Churn"]
NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(expr: str) -> str:
    return f"CASE WHEN regexp_matches(trim({expr}), '{NUM_RE}') THEN CAST(trim({expr}) AS DOUBLE) END"


def long_form(source: str, names: list[str], kind: str = "VARCHAR", keep: str = "") -> str:
    """UNION ALL of (feature, value) rows."""
    k = keep + ", " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, CAST({c} AS {kind}) AS value FROM {source}" for c in names
    )


_UP_HEADERS = ", ".join(f"'{c}'" for c in [*COLUMNS, "Cancel Reason", "exit_date", "notes"])

VIEWS: dict[str, str] = {
    "snapshot_base": _base("2000-08-02", "2001-08-02"),
    "snapshot": _shaped("snapshot_base"),
    "baseline_base": _base("1997-01-01", "1998-01-01"),
    "baseline_b": _shaped("baseline_base"),
    "cleaned": "SELECT * REPLACE (CASE WHEN trim(TotalCharges) = '' AND tenure = 0 THEN 0.0::DOUBLE ELSE CAST(trim(TotalCharges) AS DOUBLE) END AS TotalCharges) FROM snapshot",
    "baseline_clean": "SELECT * REPLACE (CASE WHEN trim(TotalCharges) = '' AND tenure = 0 THEN 0.0::DOUBLE ELSE CAST(trim(TotalCharges) AS DOUBLE) END AS TotalCharges) FROM baseline_b",
    "scored": f"SELECT *, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS y, {_score('p', '0.35')} AS p FROM snapshot",
    "models": " UNION ALL ".join(
        f"SELECT customerID, Churn, '{n}' AS model, {_score(s, w)} AS p, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS y FROM snapshot"
        for n, s, w in [("alpha", "p", "0.35"), ("beta", "q", "0.25"), ("gamma", "r", "0.15")]
    ),
    "shaped_keys": _shaped("snapshot_base", "custkey, hx, monthly_cents, c_mktsegment, c_nationkey,"),
    "upload": f"""
SELECT CASE WHEN substr(hx,21,1) = '0' AND substr(hx,22,1) < '8' THEN '  ' WHEN substr(hx,21,1) = '0' THEN NULL
    WHEN substr(hx,21,1) = '1' THEN ' C1 ' ELSE customerID END AS customerID,
  CASE substr(hx,23,1) WHEN '0' THEN '2' WHEN '1' THEN 'x' ELSE CAST(SeniorCitizen AS VARCHAR) END AS SeniorCitizen,
  CASE substr(hx,24,1) WHEN '0' THEN 'abc' WHEN '1' THEN '-3' ELSE CAST(tenure AS VARCHAR) END AS tenure,
  CASE WHEN substr(hx,25,1) = '0' THEN '-5.00' ELSE CAST(monthly_cents // 100 AS VARCHAR) || '.' || lpad(CAST(monthly_cents % 100 AS VARCHAR), 2, '0') END AS MonthlyCharges,
  CASE substr(hx,26,1) WHEN '0' THEN 'n/a' WHEN '1' THEN '1d' WHEN '2' THEN 'nan' WHEN '3' THEN ' ' WHEN '4' THEN NULL WHEN '5' THEN '-1.50' ELSE TotalCharges END AS TotalCharges,
  CASE substr(hx,27,1) WHEN '0' THEN ' ' WHEN '1' THEN NULL WHEN '2' THEN 'F' ELSE gender END AS gender,
  {", ".join(c for c in CATEGORICAL if c not in ("gender", "Contract"))},
  CASE substr(hx,28,1) WHEN '0' THEN 'month-to-month' WHEN '1' THEN ' Two year ' ELSE Contract END AS Contract,
  CASE substr(hx,29,1) WHEN '0' THEN 'TRUE' WHEN '1' THEN 'No churn' WHEN '2' THEN ' 0 ' WHEN '3' THEN 'maybe' ELSE Churn END AS Churn,
  c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation_code
FROM shaped_keys, (SELECT unnest([1, 2]) AS copy_no) WHERE copy_no = 1 OR custkey % 97 = 0""",
    "headers": f"""
SELECT file, CAST(position AS INTEGER) AS position,
  CASE d WHEN '1' THEN upper(name) WHEN '2' THEN lower(name)
    WHEN '3' THEN lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')) WHEN '4' THEN '  ' || name || ' '
    WHEN '5' THEN regexp_replace(name, '([a-z])([A-Z])', '\\1- \\2', 'g') WHEN '6' THEN name || 'x'
    WHEN '7' THEN 'customer_id' ELSE name END AS header
FROM (SELECT file, position, name, substr(md5('h|' || file), CAST(position AS INTEGER) + 1, 1) AS d
  FROM (SELECT 'C' || c_custkey AS file, unnest([{_UP_HEADERS}]) AS name, unnest(range(24)) AS position FROM customer))
WHERE d <> '0'""",
    "plog": """SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'batch' ELSE 'single' END AS kind,
  TRY_CAST(props ->> '$.k' AS INTEGER) AS "count", value / (SELECT max(value) FROM events) AS p, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events""",
    "docs": "SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "hashed": "SELECT *, ('0x' || substr(md5('42|' || customerID), 1, 8))::BIGINT AS h, md5('42|' || customerID) AS hd FROM cleaned",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY hd, customerID) AS rk, count(*) OVER (PARTITION BY Churn) AS nc, count(*) OVER () AS nt FROM hashed",
    "holdout": """
SELECT Churn, nc, nt, ht, sum(1) OVER () AS classes, q - floor(q) AS frac, floor(q) AS base
FROM (SELECT Churn, nc, nt, CAST(ceil(0.3::DOUBLE * nt) AS BIGINT) AS ht, (nt - ceil(0.3::DOUBLE * nt)) * nc / CAST(nt AS DOUBLE) AS q
  FROM (SELECT DISTINCT Churn, nc, nt FROM ranked))""",
    "quota": """
SELECT Churn, nc, nt, CAST(base AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY frac DESC, Churn) <= (nt - ht) - sum(base) OVER () THEN 1 ELSE 0 END AS n_train
FROM holdout""",
    "quota2": """
SELECT *, CAST(b2 AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY f2 DESC, Churn) <= n_val_all - sum(b2) OVER () THEN 1 ELSE 0 END AS n_val
FROM (SELECT *, floor(q2) AS b2, q2 - floor(q2) AS f2 FROM (
  SELECT *, n_val_all * nh / CAST(h_all AS DOUBLE) AS q2 FROM (
    SELECT *, nc - n_train AS nh, sum(nc - n_train) OVER () AS h_all,
      sum(nc - n_train) OVER () - CAST(ceil(0.5::DOUBLE * sum(nc - n_train) OVER ()) AS BIGINT) AS n_val_all FROM quota)))""",
    "split": """
SELECT r.* EXCLUDE (h, nc, nt), CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_val THEN 'validation' ELSE 'test' END AS "partition"
FROM ranked r JOIN quota2 q ON r.Churn = q.Churn""",
}


def with_views(sql: str) -> str:
    """Prepend the views that ``sql`` names (directly or through other views)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s|$)", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
