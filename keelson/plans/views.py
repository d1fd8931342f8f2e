"""Customer views derived from the star-schema tables.

* ``snapshot``  one row per customer as of a day, from orders before that day only;
* ``scored``    snapshot plus a deterministic score, for the policy and metric jobs;
* ``upload``    the snapshot as a messy all-text upload with copies and bad cells;
* ``headers``   one uploaded header per (file, position): each customer is a file.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.scalars import hex_digest, hex_number
from keelson.roles import CUSTOMER, NO_INTERNET, NO_PHONE
from keelson.session import spread
from keelson.sources.tables import instant, table

#: The main day: its label window of 365 days ends after the last order, so every order is read.
AS_OF = "2000-08-02"
#: The early day that drift reports hold the main snapshot against.
BASELINE_AS_OF = "1997-01-01"
MODEL_SALTS = {"alpha": ("p", 0.35), "beta": ("q", 0.25), "gamma": ("r", 0.15)}

# fixed values: digit of the row digest that drives each made-up service column
DIGIT = {
    "gender": 1,
    "Partner": 2,
    "Dependents": 3,
    "PhoneService": 4,
    "MultipleLines": 5,
    "OnlineSecurity": 6,
    "OnlineBackup": 7,
    "DeviceProtection": 8,
    "TechSupport": 9,
    "StreamingTV": 10,
    "StreamingMovies": 11,
    "PaperlessBilling": 12,
}


def _digit(position: int) -> Column:
    return F.substring("hx", position, 1)


def _yes_no(position: int, below: str = "8") -> Column:
    return F.when(_digit(position) < below, "Yes").otherwise("No")


def _levels(position: int, sentinel: str) -> Column:
    digit = _digit(position)
    return F.when(digit < "6", "Yes").when(digit < "e", "No").otherwise(sentinel)


def snapshot_base(spark: SparkSession, folder: str, as_of: str = AS_OF) -> DataFrame:
    """Customer attributes with order totals before ``as_of``: one scan per table."""
    orders = table(spark, folder, "orders")
    start = instant(orders, "o_orderdate", f"{as_of} 00:00:00")
    end_day = date.fromisoformat(as_of) + timedelta(days=365)
    end = instant(orders, "o_orderdate", f"{end_day} 00:00:00")
    day = F.col("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    history = (
        orders.where(day < end)
        .groupBy("o_custkey")
        .agg(
            F.count_if(day < start).alias("n_prior"),
            F.min(F.when(day < start, day)).alias("first_prior"),
            F.sum(F.when(day < start, price)).cast("decimal(18,2)").alias("sum_prior"),
            F.count_if(day >= start).alias("n_next"),
        )
    )
    year, month = int(as_of[:4]), int(as_of[5:7])
    first = F.col("first_prior")
    return (
        table(spark, folder, "customer")
        .join(history, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("custkey"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("customerID"),
            "c_nationkey",
            "c_acctbal",
            "c_mktsegment",
            F.coalesce("n_prior", F.lit(0)).alias("n_prior"),
            F.coalesce("n_next", F.lit(0)).alias("n_next"),
            F.coalesce((year - F.year(first)) * 12 + (month - F.month(first)), F.lit(0)).alias("tenure"),
            "sum_prior",
        )
        .withColumn("hx", hex_digest("f", "customerID"))
        .withColumn(
            "monthly_cents",
            F.coalesce(
                F.expr("cast(sum_prior * 100 as bigint) div greatest(tenure, 1)"), F.lit(0)
            ).cast("long"),
        )
    )


def _shaped() -> list[Column]:
    prior = F.col("n_prior")
    columns = {
        "customerID": F.col("customerID"),
        "SeniorCitizen": (F.col("c_acctbal") < 0).cast("int"),
        "tenure": F.col("tenure").cast("int"),
        "MonthlyCharges": F.col("monthly_cents") / F.lit(100.0),
        "TotalCharges": F.coalesce(F.col("sum_prior").cast("string"), F.lit(" ")),
        "gender": F.when(_digit(DIGIT["gender"]) < "8", "Female").otherwise("Male"),
        "Partner": _yes_no(DIGIT["Partner"]),
        "Dependents": _yes_no(DIGIT["Dependents"]),
        "PhoneService": _yes_no(DIGIT["PhoneService"], "e"),
        "MultipleLines": _levels(DIGIT["MultipleLines"], NO_PHONE),
        "InternetService": F.when(F.col("c_nationkey") % 3 == 0, "No")
        .when(F.col("c_nationkey") % 3 == 1, "DSL")
        .otherwise("Fiber optic"),
        **{
            name: _levels(DIGIT[name], NO_INTERNET)
            for name in (
                "OnlineSecurity",
                "OnlineBackup",
                "DeviceProtection",
                "TechSupport",
                "StreamingTV",
                "StreamingMovies",
            )
        },
        "Contract": F.when(prior <= 2, "Month-to-month").when(prior <= 4, "One year").otherwise("Two year"),
        "PaperlessBilling": _yes_no(DIGIT["PaperlessBilling"]),
        "PaymentMethod": F.when(F.col("c_mktsegment") == "BUILDING", "Electronic check")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "Mailed check")
        .when(F.col("c_mktsegment") == "MACHINERY", "Bank transfer (automatic)")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Credit card (automatic)")
        .otherwise(F.col("c_mktsegment")),
        "Churn": F.when(F.col("n_next") == 0, "Yes").otherwise("No"),
    }
    return [columns[name].alias(name) for name in CUSTOMER.columns]


def snapshot(spark: SparkSession, folder: str, as_of: str = AS_OF) -> DataFrame:
    """The 21-column raw customer table (charges are dirty text)."""
    return snapshot_base(spark, folder, as_of).select(*_shaped())


def unit_hash(salt: str, key: Column | str) -> Column:
    """Uniform value k/4096 from three digest digits (so scores have ties)."""
    return hex_number(hex_digest(salt, key), 1, 3) / F.lit(4096.0)


def with_score(df: DataFrame, salt: str = "p", weight: float = 0.35, name: str = "p") -> DataFrame:
    label = F.when(F.col("Churn") == "Yes", 1.0).otherwise(0.0)
    return df.withColumn(
        name, F.lit(0.55) * unit_hash(salt, "customerID") + F.lit(weight) * label + F.lit(0.05)
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return with_score(snapshot(spark, folder))


def scored_models(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of three models in long form: (customerID, Churn, y, model, p)."""
    base = snapshot(spark, folder).select("customerID", "Churn")
    for name, (salt, weight) in MODEL_SALTS.items():
        base = with_score(base, salt, weight, name)
    return base.unpivot(["customerID", "Churn"], list(MODEL_SALTS), "model", "p").withColumn(
        "y", F.when(F.col("Churn") == "Yes", 1).otherwise(0)
    )


def upload(spark: SparkSession, folder: str) -> DataFrame:
    """A messy text upload: bad keys, bad numbers, bad levels and copied rows."""
    wide = snapshot_base(spark, folder).select(
        "custkey", "hx", "monthly_cents", "c_mktsegment", "c_nationkey", *_shaped()
    )
    digit = _digit
    cents = F.col("monthly_cents")
    text = wide.select(
        "custkey",
        F.when((digit(21) == "0") & (digit(22) < "8"), "  ")
        .when(digit(21) == "0", F.lit(None).cast("string"))
        .when(digit(21) == "1", " C1 ")
        .otherwise(F.col("customerID"))
        .alias("customerID"),
        F.when(digit(23) == "0", "2").when(digit(23) == "1", "x").otherwise(F.col("SeniorCitizen").cast("string")).alias("SeniorCitizen"),
        F.when(digit(24) == "0", "abc").when(digit(24) == "1", "-3").otherwise(F.col("tenure").cast("string")).alias("tenure"),
        F.when(digit(25) == "0", "-5.00")
        .otherwise(F.concat(F.expr("monthly_cents div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
        .alias("MonthlyCharges"),
        F.when(digit(26) == "0", "n/a")
        .when(digit(26) == "1", "1d")
        .when(digit(26) == "2", "nan")
        .when(digit(26) == "3", " ")
        .when(digit(26) == "4", F.lit(None).cast("string"))
        .when(digit(26) == "5", "-1.50")
        .otherwise(F.col("TotalCharges"))
        .alias("TotalCharges"),
        F.when(digit(27) == "0", " ")
        .when(digit(27) == "1", F.lit(None).cast("string"))
        .when(digit(27) == "2", "F")
        .otherwise(F.col("gender"))
        .alias("gender"),
        *[c for c in CUSTOMER.categorical if c not in ("gender", "Contract")],
        F.when(digit(28) == "0", "month-to-month")
        .when(digit(28) == "1", " Two year ")
        .otherwise(F.col("Contract"))
        .alias("Contract"),
        F.when(digit(29) == "0", "TRUE")
        .when(digit(29) == "1", "No churn")
        .when(digit(29) == "2", " 0 ")
        .when(digit(29) == "3", "maybe")
        .otherwise(F.col("Churn"))
        .alias("Churn"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation_code"),
    )
    copies = F.when(F.col("custkey") % 97 == 0, 2).otherwise(1)
    return (
        text.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy", "custkey")
    )



# fixed values: column names that give away what happened after the outcome
EXTRA_HEADERS = ("Cancel Reason", "exit_date", "notes")
#: Uploaded files (customers) whose headers one task spells out.
FILES_PER_TASK = 10_000


def _variants(name: str) -> dict[str, str]:
    """Spelling of a header by digest digit; other digits leave it as it is."""
    spaced = re.sub("([a-z])([A-Z])", r"\1- \2", name)
    snake = re.sub("([a-z])([A-Z])", r"\1_\2", name).lower()
    return {
        "1": name.upper(),
        "2": name.lower(),
        "3": snake,
        "4": f"  {name} ",
        "5": spaced,
        "6": f"{name}x",
        "7": "customer_id",
    }


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(file, position, header): spelling variants of the expected columns per file."""
    names = (*CUSTOMER.columns, *EXTRA_HEADERS)
    # a file becomes two dozen rows, and one part of the table file may hold all customers
    files = (
        spread(table(spark, folder, "customer").select("c_custkey"), FILES_PER_TASK)
        .select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("file"))
        .withColumn("hx", hex_digest("h", "file"))
    )

    spelled = F.array(*[F.array(*[F.lit(_variants(n).get(d, n)) for d in "0123456789abcdef"]) for n in names])
    listed = files.select("file", "hx", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("position"))
    digit = F.expr("substring(hx, position + 1, 1)")
    header = F.get(F.get(spelled, F.col("position")), F.instr(F.lit("0123456789abcdef"), digit) - 1)
    # a generated column is computed once per row, however often a job refers to it
    return listed.where(digit != "0").select("file", "position", F.explode(F.array(header)).alias("header"))


def retrain_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as a table with other roles: id, label, one number, two categories."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(labels, "doc_id")


def prediction_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a service log: kind of request, rows scored, score and label."""
    events = table(spark, folder, "events")
    peak = events.agg(F.max("value")).scalar()
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(kind == "error", "error").when(kind == "purchase", "batch").otherwise("single").alias("kind"),
        F.get_json_object("props", "$.k").try_cast("int").alias("count"),
        (F.col("value") / peak).alias("p"),
        (kind == "purchase").cast("int").alias("y"),
    )
