"""Plans stay shuffle-friendly: no nested loops, no single-partition exchange of rows."""

import re

import pytest

import __spark_entry__ as entry

NARROW = ["clean_blank_numeric", "constraint_check", "risk_band", "service_normalize", "header_resolve", "stratified_split"]
GROUPED = [
    "score_rank", "clean_guard_duplicates", "validate_cleaned", "compat_report", "categorical_quality", "header_suggest",
    "profile_numeric", "boxplot_stats", "profile_nunique", "rate_overview", "average_precision", "roc_curve",
    "threshold_sweep", "calibration_error", "psi", "categorical_drift", "drift_report", "kfold_stratified",
    "undersample", "join_manifest", "ks_drift", "rolling_performance", "batch_response", "shap_local",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW + GROUPED)
def test_no_nested_loop_or_cartesian(name, spark, small):
    plan = plan_of(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


@pytest.mark.parametrize("name", ["stratified_split", "kfold_stratified", "undersample"])
def test_split_assigns_without_window(name, spark, small):
    assert "Window" not in plan_of(entry.queries()[name](spark, small))


def test_running_totals_window_is_partitioned(spark):
    from pyspark.sql import functions as F

    from keelson.functions.ranked import running_totals

    df = spark.range(1000).select((F.col("id") / 7).alias("v"), F.lit(1).alias("n"))
    plan = plan_of(running_totals(df, [], "v", ["n"]))
    for window in re.findall(r"Window \[.*", plan):
        assert "_range" in window


def test_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(entry.queries()["batch_kpis"](spark, small))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert schemas and all("o_orderpriority" not in s and "o_totalprice" not in s for s in schemas)
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in plan


def test_drift_against_a_stored_baseline_reads_the_batch_only(spark, small):
    from keelson.catalog import drift_queries as q
    from keelson.operators import drift
    from keelson.plans import views
    from keelson.roles import CUSTOMER

    held = q.stored_baseline(spark, small)
    old, batch = q.early(spark, small), q.cleaned(spark, small)
    report = drift.drift_report(held, batch, CUSTOMER, "b", 6)
    plan = plan_of(report)
    # the early snapshot filters orders at its own date; only the batch's date may be in the plan
    assert "keelson-baseline" in plan and views.BASELINE_AS_OF not in plan and views.AS_OF in plan
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(drift.numeric_drift(held, batch, CUSTOMER.numeric, 6)) == rows(drift.numeric_drift(old, batch, CUSTOMER.numeric, 6))
    assert rows(drift.categorical_drift(held, batch, CUSTOMER.categorical, 6)) == rows(drift.categorical_drift(old, batch, CUSTOMER.categorical, 6))
    assert {r["version"] for r in held.numeric.collect()} == {views.BASELINE_AS_OF}
    assert all(sum(r["counts"]) == r["n"] for r in held.numeric.where("size(edges) > 1").collect())
