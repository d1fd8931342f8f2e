"""Small frames with known answers, brute-force twins, and the decided semantics."""

import dataclasses
import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from keelson.functions import scalars
from keelson.functions.ranked import exact_quantiles, running_totals
from keelson.operators import cleaning, combine, compat, drift, explain, metrics, monitor, policy, prep, profiling, sketches, smotenc, split
from keelson.plans import training, views
from keelson.roles import CUSTOMER, CUSTOMER_LEVELS, INTERNET_FIELDS, RoleSpec
from keelson.sources import files


def row(key="A1", **changes):
    base = {
        "customerID": key, "SeniorCitizen": "0", "tenure": "12", "MonthlyCharges": "70.5", "TotalCharges": "846.0",
        "gender": "Female", "Partner": "Yes", "Dependents": "No", "PhoneService": "Yes", "MultipleLines": "No",
        "InternetService": "DSL", **{c: "No" for c in INTERNET_FIELDS}, "Contract": "One year",
        "PaperlessBilling": "Yes", "PaymentMethod": "Mailed check", "Churn": "No",
    }
    return {**base, **changes}


@pytest.fixture
def table(spark):
    schema = ", ".join(f"{c} string" for c in CUSTOMER.columns)
    return lambda *rows: spark.createDataFrame([tuple(r[c] for c in CUSTOMER.columns) for r in rows], schema)


# ------------------------------------------------------------------ scalars and cleaning


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), (".5", 0.5), ("nan", None), ("1d", None), ("1f", None), ("inf", None), ("", None), (None, None), ("a", None), ("\t7\n", 7.0)],
)
def test_parse_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.parse_number("t")).first()[0] == value


def test_clean_blank_at_zero_tenure(table):
    out = cleaning.clean_charges(table(row(tenure="0", TotalCharges=" ")), CUSTOMER, strict=True)
    assert out.first()["TotalCharges"] == 0.0
    assert dict(out.dtypes)["TotalCharges"] == "double"


@pytest.mark.parametrize("bad", [{"TotalCharges": " "}, {"TotalCharges": "n/a"}, {"TotalCharges": None}])
def test_strict_cleaning_fails(table, bad):
    with pytest.raises(ValueError, match="TotalCharges"):
        cleaning.clean_charges(table(row(**bad)), CUSTOMER, strict=True)


def test_integer_charges_become_double(spark):
    df = spark.createDataFrame([("a", 1, 5)], "customerID string, tenure int, TotalCharges int")
    assert dict(cleaning.clean_charges(df, CUSTOMER).dtypes)["TotalCharges"] == "double"


def test_separate_rejects_repeated_ids(table):
    with pytest.raises(ValueError, match="unique"):
        cleaning.separate(table(row("X"), row("X", gender="Male")), CUSTOMER)


def test_separate_rejects_extra_columns(table):
    with pytest.raises(ValueError, match="unexpected"):
        cleaning.separate(table(row()).withColumn("extra", F.lit(1)), CUSTOMER)


def test_normalize_numeric_target(spark):
    df = spark.createDataFrame([(0,), (1,), (0,), (1,)], "t int")
    assert [r[0] for r in cleaning.normalize_target(df, "t").select("label").collect()] == ["No", "Yes", "No", "Yes"]
    two = spark.createDataFrame([(3.5,), (9.0,)], "t double")
    assert [r[0] for r in cleaning.normalize_target(two, "t").select("label").collect()] == ["No", "Yes"]
    flag = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert [r[0] for r in cleaning.normalize_target(flag, "t").select("label").collect()] == ["Yes", "No"]


def retrain_frame(spark, n):
    rng = np.random.default_rng(n)
    months, fee = rng.integers(1, 60, n).tolist(), rng.uniform(15, 120, n).round(2).tolist()
    plan, left = rng.choice(["basic", "plus", "max"], n).tolist(), (np.arange(n) % 5 < 2).tolist()
    data = [(f"key-{k:04d}", m, f, m * f, p, "Yes" if x else "No") for k, (m, f, p, x) in enumerate(zip(months, fee, plan, left))]
    return spark.createDataFrame(data, "customerID string, tenure int, MonthlyCharges double, TotalCharges double, Contract string, Churn string")


def test_retrain_checks(spark):
    def failed(df, **k):
        return [r["code"] for r in cleaning.retrain_checks(df, "Churn", "customerID").where("failed").orderBy("step").collect()]

    good = retrain_frame(spark, 120)
    assert failed(good) == []
    assert "too_few_rows" in failed(retrain_frame(spark, 20))
    assert "constant_feature" in failed(good.withColumn("c", F.lit(None).cast("string")))
    assert "id_repeated" in failed(good.withColumn("customerID", F.lit("x")))
    assert failed(good.drop("Churn")) == ["target_missing"]


# ------------------------------------------------------------------ policy


@pytest.mark.parametrize(("p", "band"), [(0.03, "Low"), (0.2399, "Low"), (0.24, "Elevated"), (0.4999, "Elevated"), (0.5001, "High"), (1.0, "High")])
def test_risk_bands(spark, p, band):
    assert spark.range(1).select(scalars.risk_band(F.lit(p), 0.24)).first()[0] == band


def test_decisions_use_unrounded_probability(spark):
    df = spark.createDataFrame([("a", 0.09996)], "customerID string, p double")
    out = policy.rank_scores(df, CUSTOMER, 0.10, details=()).first()
    assert (out["churn_probability"], out["risk_level"], out["retention_recommended"]) == (0.1, "Low", 0)


def test_ranking_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "customerID string, p double")
    assert [r[0] for r in policy.rank_scores(df, CUSTOMER, 0.1, details=()).collect()] == ["c", "a", "b"]


def test_fractional_flag_is_a_problem_not_a_truncation(table):
    out = policy.prepare_features(table(row(SeniorCitizen="0.9")), CUSTOMER).first()
    assert out["problem"] == "SeniorCitizen:integer" and out["SeniorCitizen"] is None


def test_two_modes_for_service_rules(table):
    bad = table(row(PhoneService="No", MultipleLines="Yes"))
    assert "MultipleLines:dependency" in policy.violations(bad, CUSTOMER).first()["violations"]
    assert policy.violations(bad, CUSTOMER, mode="fix").first()["violations"] == ""
    assert policy.normalize_services(bad, CUSTOMER).first()["MultipleLines"] == "No phone service"


def test_batch_without_required_column_raises(table):
    with pytest.raises(ValueError, match="Contract"):
        policy.prepare_batch(table(row()).drop("Contract"), CUSTOMER, "customerID")
    with pytest.raises(ValueError, match="primary key"):
        policy.prepare_batch(table(row()), CUSTOMER, "nope")


# ------------------------------------------------------------------ compatibility


def report(df, **k):
    return compat.compatibility(df, CUSTOMER, "customerID", **k)


def test_compatible_file_has_no_message(table):
    out = report(table(row("1"), row("2")))
    assert out.first()["is_compatible"]
    assert compat.messages(out).count() == 0


def test_blank_charge_at_zero_tenure_is_compatible_unless_strict(table):
    df = table(row("1", tenure="0", TotalCharges=" "))
    assert report(df).first()["is_compatible"]
    assert not report(df, strict=True).first()["is_compatible"]


def test_categorical_blank_is_not_reported_as_key_problem(table):
    codes = {r["code"] for r in compat.messages(report(table(row("1", gender=" ")))).collect()}
    assert codes == {"blank_categories"}


def test_missing_column_and_missing_key(table):
    out = report(table(row()).drop("Contract")).first()
    assert out["missing_columns"] == "Contract" and not out["is_compatible"]
    assert not compat.compatibility(table(row()), CUSTOMER, "nope").first()["is_compatible"]


def test_mapping_makes_a_file_compatible(table):
    renamed = table(row("A1"), row("A2")).withColumnRenamed("MonthlyCharges", "monthly_charges")
    before = compat.mapped_report(renamed, CUSTOMER, "customerID").first()
    assert not before["is_compatible"] and json.loads(before["rename_suggestions"]) == {"monthly_charges": "MonthlyCharges"}
    assert "'monthly_charges' -> 'MonthlyCharges'" in before["actions"][2]
    after = compat.mapped_report(renamed, CUSTOMER, "customerID", {"monthly_charges": "MonthlyCharges"}).first()
    assert after["is_compatible"] and after["messages"] == [] and after["actions"] == []
    with pytest.raises(ValueError, match="mapped to one"):
        compat.mapped(renamed, {"tenure": "customerID"})


def test_column_issues_name_column_and_levels(table):
    bad = table(row("A1", tenure="5", TotalCharges="", Contract="Weekly"), row("A1", gender=" ", SeniorCitizen="2"))
    found = {r["code"]: r for r in compat.column_issues(bad, CUSTOMER, "customerID").collect()}
    assert {c: (r["column"], r["n"]) for c, r in found.items()} == {
        "duplicate_keys": ("customerID", 2), "blank_with_tenure": ("TotalCharges", 1), "non_numeric": ("TotalCharges", 1),
        "not_binary": ("SeniorCitizen", 1), "blank_cells": ("gender", 1), "invalid_cells": ("Contract", 1),
    }
    assert found["invalid_cells"]["message"].endswith(": Weekly") and not found["invalid_cells"]["blocking"]
    gone = compat.mapped_report(bad.drop("customerID"), CUSTOMER, "customerID").first()
    assert not gone["key_found"] and any("Key column customerID" in m for m in gone["messages"])


def test_doubled_headers_raise_and_exact_name_wins(spark):
    df = spark.createDataFrame([("a", "b")], "gender string, Gender2 string").toDF("gender", "GENDER")
    with pytest.raises(ValueError, match="several headers"):
        compat.rename_headers(df)


def test_suggestions_skip_taken_targets():
    found = compat.suggest_for(["tenure", "Tenure", "monthly_charges", "Contrct", "notes"])
    assert found == {"monthly_charges": "MonthlyCharges", "Contrct": "Contract"}


def test_detect_key_prefers_alias(spark):
    df = spark.createDataFrame([("x1", "1", "a"), ("x2", "2", "a")], "other string, id string, c string")
    chosen = compat.detect_key(df).where("chosen").first()
    assert chosen["column"] == "id"
    assert {r["column"] for r in compat.detect_key(df).where("is_unique").collect()} == {"id", "other"}


# ------------------------------------------------------------------ ranks and quantiles


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(400, 5.0), rng.normal(5, 2, 803).round(3)])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values}))
    wanted = {f"q{i}": i / 10 for i in range(11)}
    got = exact_quantiles(df, ["g"], "v", wanted).first()
    expect = np.quantile(values, list(wanted.values()))
    assert np.allclose([got[k] for k in wanted], expect, atol=1e-12)


def test_running_totals_descending_without_keys(spark):
    df = spark.createDataFrame([(float(i % 50), i) for i in range(500)], "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    got = running_totals(df, [], "v", ["n"], descending=True).toPandas().sort_values("v", ascending=False)
    assert (got["n"].cumsum().to_numpy() == got["cum_n"].to_numpy()).all()


# ------------------------------------------------------------------ split


@given(st.integers(1, 5000), st.integers(1, 5000), st.floats(0.05, 0.95))
def test_largest_remainder_adds_up(a, b, share):
    total = math.floor((a + b) * share)
    parts = split.largest_remainder(total, {"a": a, "b": b})
    assert sum(parts.values()) == total
    assert all(abs(parts[k] - total * n / (a + b)) < 1 for k, n in {"a": a, "b": b}.items())


def test_split_sizes_of_the_full_table(spark):
    labels = ["No"] * 5174 + ["Yes"] * 1869
    df = spark.createDataFrame([(f"id{i}", y) for i, y in enumerate(labels)], "customerID string, Churn string")
    parted = split.stratified_split(df, CUSTOMER)
    got = {r["partition"]: r for r in split.split_summary(parted, CUSTOMER).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"train": 4930, "validation": 1056, "test": 1057}
    weight = split.positive_weight(parted.where("partition = 'train'"), CUSTOMER).first()
    assert round(weight["scale_pos_weight"], 4) == 2.7691
    assert split.validate_split(parted, CUSTOMER).first()["passed"]
    again = split.stratified_split(df.repartition(5), CUSTOMER)
    assert parted.exceptAll(again.select(*parted.columns)).count() == 0


def test_folds_cover_every_row_once(spark):
    df = spark.createDataFrame([(f"id{i}", "Yes" if i % 3 else "No") for i in range(103)], "customerID string, Churn string")
    sizes = {(r["Churn"], r["fold"]): r["count"] for r in split.assign_folds(df, CUSTOMER, 5).groupBy("Churn", "fold").count().collect()}
    assert sum(sizes.values()) == 103 and {f for _, f in sizes} == set(range(5))
    for label in ("Yes", "No"):
        mine = [n for (y, _), n in sizes.items() if y == label]
        assert max(mine) - min(mine) <= 1


def test_three_classes_are_refused(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "customerID string, Churn string")
    with pytest.raises(ValueError, match="classes"):
        split.stratified_split(df, CUSTOMER)


# ------------------------------------------------------------------ metrics


def scores(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_perfect_and_cost_examples(spark):
    out = metrics.report(scores(spark, [1, 0, 0, 0, 1, 0], [0.71, 0.3, 0.02, 0.44, 0.62, 0.6]), "p", "y", 0.61).first()
    assert (out["precision"], out["recall"], out["f1"], out["roc_auc"]) == (1.0, 1.0, 1.0, 1.0)
    out = metrics.evaluate(scores(spark, [0, 0, 1, 1, 1, 0], [0.7, 0.66, 0.3, 0.9, 0.41, 0.2]), "p", "y", 0.5).first()
    assert (out["false_positives"], out["false_negatives"], out["total_cost"]) == (2, 2, 1100)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_an_error(spark, bad):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, bad), (0, 0.4)], "y int, p double")
    for job in (lambda: metrics.report(df, "p", "y", 0.5), lambda: metrics.sweep(df, "p", "y", [0.1, 0.5]), lambda: metrics.confusion(df, "p", "y", 0.5)):
        with pytest.raises(Exception, match="null or NaN score"):
            job().collect()


def test_known_costs(spark):
    total = metrics.cost(F.lit(373), F.lit(15)), metrics.cost(F.lit(353), F.lit(26))
    assert tuple(spark.range(1).select(*total).first()) == (26150, 30650)


def test_grid_is_the_numpy_grid():
    thresholds = metrics.grid()
    assert len(thresholds) == 91 and thresholds[5] == 0.1 and thresholds[-1] == 0.9500000000000002


def test_sweep_small(spark):
    labels, values = [1, 0, 0, 1, 0, 1, 1], [0.33, 0.32, 0.07, 0.58, 0.21, 0.77, 0.5]
    df = scores(spark, labels, values)
    grid = [0.25, 0.325, 0.5, 0.625, 0.9]
    got = metrics.sweep(df, "p", "y", grid).orderBy("threshold").collect()
    for r, t in zip(got, grid):
        p, y = np.array(values), np.array(labels)
        hit = p >= t
        assert (r["predicted"], r["false_positives"], r["false_negatives"]) == (hit.sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum())
    best = metrics.cheapest(metrics.sweep(df, "p", "y", grid)).first()
    assert best["total_cost"] == 0 and best["threshold"] == 0.33


def test_areas_with_ties_match_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 600)
    p = np.round(rng.random(600) * 0.6 + 0.4 * y, 1)
    got = metrics.areas(metrics.score_points(scores(spark, y, p), "p", "y"), digits=10).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall, precision = (pos >= t).mean(), y[p >= t].mean()
        ap += (recall - last) * precision
        last = recall
    assert math.isclose(got["roc_auc"], auc, abs_tol=1e-9) and math.isclose(got["pr_auc"], ap, abs_tol=1e-9)


def test_one_class_slice_has_no_area(spark):
    out = metrics.report(scores(spark, [1, 1], [0.3, 0.7]), "p", "y", 0.5).first()
    assert out["roc_auc"] is None and out["pr_auc"] is None and out["recall"] == 0.5


def test_calibration_bins_are_right_closed(spark):
    got = metrics.calibration_bins(scores(spark, [0, 1, 1], [0.1, 0.1000001, 1.0]), "p", "y").orderBy("bin").collect()
    assert [r["bin"] for r in got] == [0, 1, 9]


# ------------------------------------------------------------------ drift


def numpy_psi(expected, actual, bins=10):
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    e, a = (np.histogram(x, bins=edges)[0] / len([v for v in x if edges[0] <= v <= edges[-1]]) for x in (expected, actual))
    used = (e > 0) | (a > 0)
    e, a = np.maximum(e[used], 1e-6), np.maximum(a[used], 1e-6)
    return max(float(((a - e) * np.log(a / e)).sum()), 0.0)


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    base, batch = rng.normal(0, 1, 900), rng.normal(0.7, 1.4, 700)
    flag_a, flag_b = np.arange(900) % 3 == 0, np.ones(700)
    old = spark.createDataFrame(pd.DataFrame({"x": base, "flag": flag_a.astype(float)}))
    new = spark.createDataFrame(pd.DataFrame({"x": batch, "flag": flag_b}))
    got = {r["feature"]: r for r in drift.psi(old, new, ["x", "flag"], digits=9).collect()}
    assert math.isclose(got["x"]["psi"], numpy_psi(base, batch), abs_tol=1e-8)
    assert got["x"]["out_of_range_share"] > 0
    assert got["flag"]["psi"] == numpy_psi(flag_a.astype(float), flag_b) == 0.0  # collapsed bins; watched as category shares instead
    shares = drift.categorical_drift(old.select("flag"), new.select("flag"), ["flag"]).first()
    assert shares["alert"]


def test_unseen_level_is_reported(spark):
    old = spark.createDataFrame([("a",), ("b",)], "c string")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    out = drift.categorical_drift(old, new, ["c"]).first()
    assert (out["max_share_shift"], out["worst_category"], out["unseen_share"]) == (0.5, "b", 0.5)


# ------------------------------------------------------------------ preprocessing and models


def planted(spark, n=1600, seed=11):
    rng = np.random.default_rng(seed)
    tenure, spend = rng.integers(0, 72, n), rng.normal(60, 20, n).round(2)
    plan = rng.choice(["month", "year", "two"], n)
    logit = 1.6 * (plan == "month") - 0.06 * tenure + 0.03 * (spend - 60) + rng.normal(0, 0.4, n)
    y = np.where(rng.random(n) < 1 / (1 + np.exp(-1.5 * logit)), "Yes", "No")
    pdf = pd.DataFrame({"id": [f"u{i}" for i in range(n)], "tenure": tenure, "spend": spend, "plan": plan, "label": y})
    return spark.createDataFrame(pdf)


SPEC = RoleSpec(id_col="id", target_col="label", numeric=("tenure", "spend"), categorical=("plan",))
LIGHT = training.Effort(trees=8, folds=2, forest_trees=5, forest_depth=4, iterations=50, threads=2)


@pytest.fixture(scope="module")
def parted(spark):
    return split.stratified_split(planted(spark), SPEC).persist()


@pytest.fixture(scope="module")
def bundle(parted):
    return training.train_final(parted, SPEC, 0.10, LIGHT)


def test_preprocessor_guards_and_unknown_levels(spark, parted):
    fitted = prep.fit_preprocessor(parted, SPEC)
    assert fitted.feature_names() == ["num__tenure", "num__spend", "cat__plan_month", "cat__plan_two", "cat__plan_year"]
    odd = parted.limit(1).withColumn("plan", F.lit("__UNSEEN_CATEGORY__"))
    vector = fitted.transform(odd).first()["features"].toArray()
    assert len(vector) == 5 and (vector[2:] == 0).all()
    hole = parted.limit(1).withColumn("tenure", F.lit(None).cast("int")).withColumn("plan", F.lit(None).cast("string"))
    assert np.isfinite(fitted.transform(hole).first()["features"].toArray()).all()
    with pytest.raises(ValueError, match="fitted on"):
        prep.fit_preprocessor(parted, SPEC, partition="test").transform(parted)


def test_customer_table_encodes_to_45_features(spark):
    rows = [
        tuple("Yes" if c == "Churn" else str(i) if c in ("customerID",) else (CUSTOMER_LEVELS[c][i % len(CUSTOMER_LEVELS[c])] if c in CUSTOMER_LEVELS else str(i)) for c in CUSTOMER.columns)
        for i in range(12)
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in CUSTOMER.columns))
    typed = policy.prepare_features(df, CUSTOMER).drop("problem")
    fitted = prep.fit_preprocessor(typed, CUSTOMER, by=None)
    assert len(fitted.feature_names()) == 45


def test_planted_signal_is_found_and_calibrated(spark, parted, bundle):
    y = F.when(F.col("label") == "Yes", 1).otherwise(0)
    held = parted.where("partition = 'validation'").withColumn("y", y)
    out = metrics.report(bundle.score(held), "p", "y", 0.5).first()
    assert out["roc_auc"] > 0.8
    frames = training.TrainingFrames.of(parted, SPEC)
    weighted = training.models.weighted(frames.train, training.models.scale_pos_weight(frames.train) * 3)
    plain = training.models.score(training.models.fit_boosted(weighted, trees=8), frames.validation)
    raw = plain.agg(metrics.brier("p", "y")).first()[0]
    assert out["brier_score"] < raw


def test_bundle_round_trip_and_single_row(spark, parted, bundle, tmp_path):
    path = bundle.save(spark, str(tmp_path / "bundle"))
    loaded = training.models.Bundle.load(spark, path)
    assert loaded.threshold == 0.10 and loaded.metadata["trained_on"] == "train_only"
    both = loaded.score(bundle.score(parted, "p"), "q")
    assert both.where("p <> q OR p < 0 OR p > 1").count() == 0
    one = parted.orderBy("id").limit(1)
    assert one.count() == 1
    whole = bundle.predict(parted, "id").where(F.col("id") == one.first()["id"]).first()
    assert bundle.predict(one, "id").first() == whole
    with pytest.raises(ValueError, match="at least one row"):
        bundle.score(parted.where("false"))
    with pytest.raises(FileNotFoundError):
        training.models.Bundle.load(spark, str(tmp_path / "none"))


def test_isotonic_is_monotone(spark, parted):
    frames = training.TrainingFrames.of(parted, SPEC)
    fit = lambda df: training.models.fit_boosted(df, trees=4)
    model, scored = training.models.out_of_fold(frames.train, SPEC, fit, 2)[0]
    curve = training.models.fit_isotonic(scored)
    out = training.models.calibrate(curve, scored.select("p"), "p", "c").toPandas().sort_values("p")
    assert (out["c"].diff().dropna() >= -1e-12).all()


def test_out_of_fold_scores_each_row_once(spark, parted):
    frames = training.TrainingFrames.of(parted, SPEC)
    held = training.models.out_of_fold(frames.train, SPEC, training.models.fit_majority, 3)
    ids = held[0][1].select("id")
    for _, scored in held[1:]:
        ids = ids.unionByName(scored.select("id"))
    assert ids.count() == ids.distinct().count() == frames.train.count()


def test_train_upload(spark):
    result = training.train_upload(planted(spark, 400), "label", "id", training.Effort(trees=3, folds=2))
    assert result.results.count() == 400
    order = [r[0] for r in result.results.select("churn_probability").collect()]
    assert order == sorted(order, reverse=True)
    assert result.spec.numeric == ("tenure", "spend")
    with pytest.raises(ValueError, match="too_few_rows"):
        training.train_upload(retrain_frame(spark, 20), "Churn", "customerID")


def test_shap_is_additive_and_matches_brute_force(spark, parted):
    model, rows, names = training.explain_frames(parted, SPEC, LIGHT)
    parts = explain.tree_contributions(rows, model, "id").toPandas().set_index("id")
    scored = model.transform(rows).toPandas().set_index("id")
    margin = scored["rawPrediction"].map(lambda v: v[1])
    total = parts["contributions"].map(sum) + parts["base"]
    assert np.allclose(total.sort_index(), margin.sort_index(), atol=1e-6)
    # Shapley values by definition, over all feature subsets, for a few rows
    paths = explain.leaf_paths(explain.tree_table(spark, model).toPandas())
    for key in list(parts.index[:3]):
        x = scored.loc[key, "features"].toArray()[None, :]

        def worth(known, x=x):
            out = 0.0
            for value, steps in paths:
                for s in steps:
                    value *= float(s.taken(x)[0]) if s.feature in known else s.share
                out += value
            return out

        m = x.shape[1]
        for f in range(m):
            rest = [i for i in range(m) if i != f]
            phi = sum(
                math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (worth({*s, f}) - worth(set(s)))
                for k in range(m)
                for s in itertools.combinations(rest, k)
            )
            assert math.isclose(phi, parts.loc[key, "contributions"][f], abs_tol=1e-9)


def test_contributions_are_those_of_all_subsets():
    rng = np.random.default_rng(0)
    for m in range(1, 8):
        known, unknown = rng.integers(0, 2, (m, 9)).astype(float), rng.random(m)
        unknown[0] = 0.0  # a child that no training row reached
        got = explain._leaf_weights(known, unknown)
        for f in range(m):
            rest, want = [i for i in range(m) if i != f], np.zeros(9)
            for k in range(m):
                for s in itertools.combinations(rest, k):
                    term = np.full(9, math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m))
                    for i in rest:
                        term = term * (known[i] if i in s else unknown[i])
                    want += term
            assert np.allclose(got[f], want, atol=1e-12)


def test_deep_forest_is_explained_to_global_importance(spark, parted):
    """Trees of depth 10, whose paths have too many features for a sum over subsets."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 14))
    y = (x[:, :10].sum(axis=1) + rng.normal(size=900) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "y": y, "a": list(x)}))
    df = df.select("id", "y", array_to_vector("a").alias(prep.FEATURES))
    model = training.models.fit_forest(df, trees=8, depth=10, leaf=1)
    paths = explain.leaf_paths(explain.tree_table(spark, model).toPandas())
    assert max(len({s.feature for s in steps}) for _, steps in paths) >= 8
    parts = explain.tree_contributions(df, model, "id").toPandas().set_index("id")
    p = training.models.score(model, df).toPandas().set_index("id")["p"]
    assert np.allclose((parts["contributions"].map(sum) + parts["base"]).sort_index(), p.sort_index(), atol=1e-9)
    names = [f"f{i:02d}" for i in range(14)]
    importance = explain.global_importance(explain.tree_contributions(df, model, "id"), names).collect()
    want = np.abs(np.vstack(parts["contributions"].to_numpy())).mean(axis=0)
    assert {r["feature"]: r["mean_abs"] for r in importance} == pytest.approx(dict(zip(names, want.round(6))), abs=2e-6)
    assert [r["feature"] for r in sorted(importance, key=lambda r: r["rank"])] == [names[i] for i in np.argsort(-want)]


def test_tree_of_one_leaf_has_no_contributions():
    values, base = explain.contributions(np.zeros((3, 2)), [(0.25, [])])
    assert base == 0.25 and not values.any()


def test_contributions_by_tree_walk_are_those_by_path(spark, monkeypatch):
    """Deep trees, few rows (their own patterns) and many (all patterns); rows of one partition go to several tasks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 9)).round(1)
    y = (x[:, :6].sum(axis=1) + rng.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "y": y, "a": list(x)})).coalesce(1)
    df = df.select("id", "y", array_to_vector("a").alias(prep.FEATURES))
    model = training.models.fit_forest(df, trees=4, depth=None, leaf=1)
    nodes = explain.tree_table(spark, model).toPandas()
    paths, trees = explain.leaf_paths(nodes), explain.trees_of(nodes)
    for part in (x[:3], x):
        want, base = explain.contributions(part, paths)
        got, same = explain.forest_contributions(part, trees)
        assert np.allclose(got, want, atol=1e-12) and same == pytest.approx(base)
    monkeypatch.setattr(explain, "CHUNK", 100)
    assert explain.tree_contributions(df, model, "id").rdd.getNumPartitions() == 6


def test_contributions_looked_up_are_those_by_path(spark, monkeypatch):
    """Features tried again below, children without rows, and tables of any size; the work per tree is done once for all rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 5)).round(1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=700) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(700), "y": y, "a": list(x)})).coalesce(1)
    df = df.select("id", "y", array_to_vector("a").alias(prep.FEATURES))
    nodes = explain.tree_table(spark, training.models.fit_forest(df, trees=2, depth=8, leaf=1)).toPandas()
    nodes.loc[nodes["leftChild"] < 0, "rawCount"] *= rng.integers(0, 2, (nodes["leftChild"] < 0).sum())
    paths, trees = explain.leaf_paths(nodes), explain.trees_of(nodes)
    assert max(len(steps) - len({s.feature for s in steps}) for _, steps in paths) >= 3
    want, base = explain.contributions(x, paths)
    for bits in (0, 1, 4, 9, 13):
        monkeypatch.setattr(explain, "TABLE_BITS", bits)
        got, same = explain.forest_contributions(np.tile(x, (4, 1)), trees)
        assert np.allclose(got, np.tile(want, (4, 1)), atol=1e-12) and same == pytest.approx(base)
    monkeypatch.setattr(explain, "TABLE_BITS", 9)
    calls, whole = [], explain._subtree_terms
    monkeypatch.setattr(explain, "_subtree_terms", lambda *a: calls.append(a) or whole(*a))
    explain.forest_contributions(x, trees)
    once = len(calls)
    explain.forest_contributions(np.tile(x, (8, 1)), trees)
    assert 0 < once and len(calls) == 2 * once
    # rows of many batches come to a task together, and no core has more tasks than its rows need
    monkeypatch.setattr(explain, "CHUNK", 10)
    assert explain._dealt(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(explain, "MOST_ROWS", 300)
    parts = [pd.DataFrame({"id": range(n)}) for n in (700, 0, 120, 90, 250)]
    sizes = [len(p) for p in explain._gathered(iter(parts))]
    assert sum(sizes) == 1160 and max(sizes) <= 300 and len(sizes) <= 6


def test_training_rows_of_one_partition_go_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(training.models, "ROWS_PER_TASK", 100)
    df = spark.range(1000).coalesce(1).select("id", F.lit(1.0).alias("y"), array_to_vector(F.array(F.col("id").cast("double"))).alias(prep.FEATURES))
    for _ in range(2):
        parts = training.models.sized(df).select("id").rdd.glom().collect()
        assert len(parts) == spark.sparkContext.defaultParallelism and max(map(len, parts)) < 200
        assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 1000
    assert training.models.sized(df.limit(90)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(training.models, "MOST_ROWS_PER_TASK", 20)
    assert training.models.sized(df).rdd.getNumPartitions() == 50


def test_headers_of_one_file_part_go_to_several_tasks(spark, small, monkeypatch):
    from keelson.plans import views

    want = sorted(map(tuple, views.headers(spark, small).collect()))
    monkeypatch.setattr(views, "FILES_PER_TASK", 40)
    got = views.headers(spark, small)
    assert sorted(map(tuple, got.collect())) == want and got.rdd.getNumPartitions() == 4
    # what a header resolves to is computed in one place and only referred to by filters
    plan = compat.resolve_headers(got).where("target IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 1


def test_header_similarity_runs_after_the_distinct(spark):
    rows = [(f"f{i}", 0, "tenurex") for i in range(50)]
    found = compat.suggest_headers(spark.createDataFrame(rows, "file string, position int, header string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :].splitlines()[:6] if "ArrowEvalPython" in plan else []
    assert any("Aggregate" in line for line in below), plan
    assert plan.count("EvalPython") == 1 and {r["target"] for r in found.collect()} == {"tenure"}


def test_failed_save_leaves_the_version_before(spark, bundle, tmp_path, monkeypatch):
    path = bundle.save(spark, str(tmp_path / "bundle"))
    changed = dataclasses.replace(bundle, threshold=0.5)
    with monkeypatch.context() as broken:
        broken.setattr(training.models, "folder_digest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            changed.save(spark, path)
    assert training.models.Bundle.load(spark, path).threshold == 0.10
    changed.save(spark, path)
    assert training.models.Bundle.load(spark, path).threshold == 0.5
    assert training.models.Bundle.load(spark, path, number=1).threshold == 0.10
    with pytest.raises(FileNotFoundError):
        training.models.Bundle.load(spark, path, number=7)
    version = training.models.bundle_versions(spark, path)[0]["version"]
    (tmp_path / "bundle" / "versions" / version / "pipeline" / "metadata" / "part-x").write_text("{}")
    with pytest.raises(ValueError, match="not those that were saved"):
        training.models.Bundle.load(spark, path)


@pytest.mark.parametrize("block", [16, 256])
def test_smotenc_neighbours_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(smotenc, "BLOCK", block)  # small blocks need several rounds
    rng = np.random.default_rng(2)
    n = 260
    pdf = pd.DataFrame({"id": [f"m{i}" for i in range(n)], "tenure": rng.integers(0, 9, n).astype(float), "spend": np.where(rng.random(n) < 0.34, 50.0, rng.normal(50, 9, n)), "plan": rng.choice(["a", "b"], n)})
    df = spark.createDataFrame(pdf)
    penalty, _ = smotenc.mismatch_penalty(df, SPEC)
    got = smotenc.nearest_neighbours(df, SPEC, 5).toPandas().sort_values(["id", "nearest"])
    assert len(got) == 5 * n and (got["id"] != got["neighbour"]).all()
    num, cat = pdf[["tenure", "spend"]].to_numpy(), pdf["plan"].to_numpy()
    d2 = ((num[:, None] - num[None]) ** 2).sum(-1) + (cat[:, None] != cat[None]) * penalty**2
    np.fill_diagonal(d2, np.inf)
    expect = np.sort(d2, axis=1)[:, :5]
    order = {k: i for i, k in enumerate(pdf["id"])}
    for key, group in got.groupby("id"):
        assert np.allclose(np.sort(group["distance2"]), expect[order[key]], atol=1e-9)


def test_smotenc_neighbours_of_copies_and_ties(spark, monkeypatch):
    """A third of the rows equal, categories that outweigh the numbers: neighbours by distance, then id."""
    monkeypatch.setattr(smotenc, "BLOCK", 8)
    rng = np.random.default_rng(4)
    n = 240
    pdf = pd.DataFrame({"id": rng.permutation(n), "tenure": rng.integers(0, 4, n).astype(float), "spend": rng.integers(0, 3, n) * 40.0})
    pdf["plan"] = rng.choice(["a", "b", "c", None], n)
    pdf.loc[: n // 3, ["tenure", "spend", "plan"]] = [1.0, 40.0, "a"]
    df = spark.createDataFrame(pdf.astype({"plan": object}), "id long, tenure double, spend double, plan string")
    penalty, _ = smotenc.mismatch_penalty(df, SPEC)
    got = smotenc.nearest_neighbours(df, SPEC, 5).collect()
    num, cat = pdf[["tenure", "spend"]].to_numpy(), pdf["plan"].fillna("-").to_numpy()
    d2 = ((num[:, None] - num[None]) ** 2).sum(-1) + (cat[:, None] != cat[None]) * (penalty * penalty)
    ids = pdf["id"].to_numpy()
    want = {}
    for i in range(n):
        order = [j for j in np.lexsort((ids, np.round(d2[i], 9))) if j != i][:5]
        want.update({(ids[i], place + 1): ids[j] for place, j in enumerate(order)})
    assert {(r["id"], r["nearest"]): r["neighbour"] for r in got} == want and len(got) == 5 * n
    with pytest.raises(ValueError, match="without nulls"):
        smotenc.nearest_neighbours(df.withColumn("spend", F.when(F.col("id") > 3, F.col("spend"))), SPEC)


def test_smotenc_brings_few_rows_together(spark, monkeypatch):
    """Where categories outweigh the numbers, spots wait for cells that hold their neighbours: no cell asks all 27 around it."""
    monkeypatch.setattr(smotenc, "BLOCK", 8)
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"id": [f"m{i:03d}" for i in range(n)], "tenure": rng.integers(0, 60, n) * 1.0, "spend": rng.integers(0, 60, n) * 5.0})
    pdf["plan"] = rng.choice([*"abcdefgh"], n)
    df = spark.createDataFrame(pdf)
    met = spark.sparkContext.accumulator(0)
    closest = smotenc._closest

    def counted(*sides):
        met.add(sum(len(side) for side in sides if not isinstance(side, (int, float, RoleSpec))))
        return closest(*sides)

    monkeypatch.setattr(smotenc, "_closest", counted)
    got = smotenc.nearest_neighbours(df, SPEC, 5).collect()
    penalty, _ = smotenc.mismatch_penalty(df, SPEC)
    num, cat = pdf[["tenure", "spend"]].to_numpy(), pdf["plan"].to_numpy()
    d2 = ((num[:, None] - num[None]) ** 2).sum(-1) + (cat[:, None] != cat[None]) * (penalty * penalty)
    np.fill_diagonal(d2, np.inf)
    want = {(f"m{i:03d}", place + 1): f"m{j:03d}" for i in range(n) for place, j in enumerate(np.lexsort((np.arange(n), np.round(d2[i], 9)))[:5])}
    assert {(r["id"], r["nearest"]): r["neighbour"] for r in got} == want
    assert 0 < met.value <= 40 * n, met.value / n  # 87 a row when every round asked the cells around


def test_too_many_levels_are_refused_by_name(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_LEVELS", 40)
    df = planted(spark, 200).withColumn("plan2", F.concat(F.lit("p"), F.col("id"))).withColumn("partition", F.lit("train"))
    spec = dataclasses.replace(SPEC, categorical=("plan", "plan2"))
    for limit in (40, 150):  # more rows than are fetched, and fewer
        monkeypatch.setattr(prep, "MAX_LEVELS", limit)
        with pytest.raises(ValueError, match=rf"more than {limit} levels in plan2 \(200\)"):
            prep.fit_preprocessor(df, spec)
    monkeypatch.setattr(prep, "MAX_LEVELS", 200)
    assert len(prep.fit_preprocessor(df, spec).level_lists()["plan2"]) == 200


def test_smotenc_balances_and_stays_in_range(spark):
    df = planted(spark, 300)
    grown = smotenc.oversample(df, SPEC)
    sizes = [r["count"] for r in grown.groupBy("label").count().collect()]
    assert sizes[0] == sizes[1]
    assert grown.select("id").distinct().count() == grown.count()
    label, _ = smotenc.minority(df, SPEC)
    low, high = df.where(F.col("label") == label).agg(F.min("spend"), F.max("spend")).first()
    made = grown.where(F.col("id").startswith("S"))
    assert made.where(~F.col("spend").between(low - 1e-9, high + 1e-9)).count() == 0
    assert made.where(~F.col("plan").isin("month", "year", "two")).count() == 0


# ------------------------------------------------------------------ sources, profile, joins


def test_json_records_get_keys(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("\n".join(json.dumps(r) for r in [{"customerID": "a", "tenure": 1}, {"customerID": None, "tenure": 2}, {"account": "k", "tenure": 3}]))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("customerID", T.StringType()), T.StructField("account", T.StringType()), T.StructField("tenure", T.IntegerType())])
    keys = [r["primary_key"] for r in files.read_json_records(spark, str(path), schema, "account").orderBy("tenure").collect()]
    assert keys[0] == "a" and keys[1].startswith("BATCH-") and keys[2] == "k"


def test_log_is_optional_and_appends(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "id string, p double")
    assert files.append_log(df, None) is None
    path = str(tmp_path / "log")
    files.append_log(df, path)
    files.append_log(df, path)
    assert spark.read.json(path).count() == 2


def test_upload_must_be_csv(spark):
    with pytest.raises(ValueError, match="CSV"):
        files.read_upload_csv(spark, "/tmp/x.xlsx")


def test_tenure_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 12, 13, 24, 48, 49, 72, 73)], "tenure int")
    got = [r[0] for r in df.select(profiling.tenure_band("tenure")).collect()]
    assert got == ["0-12 mo", "0-12 mo", "13-24 mo", "13-24 mo", "25-48 mo", "49-72 mo", "49-72 mo", None]


def test_merged_sketches_are_those_of_the_whole(spark, tmp_path):
    """Two parts, stored and merged, against the sketch of all rows and against exact values."""
    df = spark.range(30_000).select(
        F.when(F.col("id") < 20_000, "a").otherwise("b").alias("part"),
        F.when(F.col("id") % 5 != 0, F.sqrt(F.col("id").cast("double"))).otherwise(F.when(F.col("id") % 10 == 0, F.lit(float("nan")))).alias("x"),
        F.concat(F.lit("k"), F.col("id") % 9000).alias("name"),
        F.lit(None).cast("int").alias("nothing"),
    )
    sketches.build(df, ["part"]).write.parquet(str(tmp_path / "s"))
    merged = {r["feature"]: r for r in sketches.read(sketches.merge(spark.read.parquet(str(tmp_path / "s")))).collect()}
    whole = {r["feature"]: r for r in sketches.read(sketches.build(df.drop("part"))).collect()}
    assert set(merged) == set(whole) == {"x", "name", "nothing"}
    ids = np.arange(30_000)
    values = np.sort(np.sqrt(ids[ids % 5 != 0]))
    for found in (merged, whole):
        x, name, nothing = found["x"], found["name"], found["nothing"]
        assert (x["rows"], x["present"], x["low"], x["high"]) == (30_000, 27_000, values[0], values[-1])
        for q in (25, 50, 75):
            assert abs(np.searchsorted(values, x[f"q{q}"]) / len(values) - q / 100) <= sketches.RANK_ERROR
        assert abs(name["unique"] - 9000) <= sketches.DISTINCT_ERROR * 9000 and name["q50"] is None
        assert (nothing["present"], nothing["unique"], nothing["low"], nothing["q50"]) == (0, 0, None, None)
    assert sketches.build(df.where("false")).count() == 0


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, combine.upsert(old, new, "k").collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_snapshot_uses_only_orders_before_the_day(spark, small):
    early = views.snapshot_base(spark, small, "1995-01-01")
    assert early.agg(F.max("n_prior")).first()[0] == 0
    assert views.snapshot(spark, small).columns == list(CUSTOMER.columns)


# ------------------------------------------------------------------ drift, keys, headers, streams


def test_alerts_are_taken_before_rounding(spark):
    base = spark.createDataFrame([("a",)] * 5000 + [("b",)] * 5000, "c string")
    below = spark.createDataFrame([("a",)] * 64_996 + [("b",)] * 35_004, "c string")
    row = drift.categorical_drift(base, below, ["c"], digits=3).first()
    assert (row["max_share_shift"], row["alert"]) == (0.15, False)


def test_key_detection_is_exact(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("almost"), F.col("id").alias("free"), F.lit("x").alias("same"), F.when(F.col("id") > 0, F.col("id")).alias("gap")
    )
    df = df.withColumn("almost", F.when(F.col("free") == 2999, F.lit("7")).otherwise(F.col("almost")))
    found = {r["column"]: (r["is_unique"], r["chosen"]) for r in compat.detect_key(df).collect()}
    assert found == {"almost": (False, False), "free": (True, True), "same": (False, False), "gap": (False, False)}


def test_near_headers_follow_the_sequence_ratio(spark):
    import difflib

    names = ["Churnx", "tenur", "Contrakt", "PaymentMehod", "gendr", "Depend", "xyz", "MonthlyCharge", "TechSuport", "Partne"]
    rows = [("f%d" % i, 0, name) for i, name in enumerate(names)]
    got = {r["header"]: r["target"] for r in compat.suggest_headers(spark.createDataFrame(rows, "file string, position int, header string")).where("priority = 3").collect()}
    want = {n: m[0] for n in names if (m := difflib.get_close_matches(n, CUSTOMER.columns, n=1, cutoff=0.85))}
    assert got == want and got["Churnx"] == "Churn"


def test_stream_counts_days_in_any_order(spark, tmp_path):
    from keelson.streaming.log import LOG_SCHEMA, count_stream, daily

    days = [10, 5, 12, 1, 28, 5, 3]
    rows = [(k, dt.datetime(2024, 1, d, 3, k), "single" if k % 2 else "batch", k, 0.5, 1) for k, d in enumerate(days * 3)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    for k in range(len(rows)):  # one file each, in this order
        log.where(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = count_stream(stream, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, daily(log).collect()))


def test_recent_batches_in_any_order(spark, tmp_path):
    """More batches than the ring holds, newest first and last, with nulls and entries that scored nothing."""
    from keelson.streaming.log import LOG_SCHEMA, recent_counters

    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    kinds = ["batch", "batch", "batch", "single", "error", None]
    rows = [
        (i, start + dt.timedelta(minutes=int(rng.integers(0, 200))), kinds[rng.integers(6)], int(rng.integers(0, 50)) if i % 11 else None, 0.5, 0)
        for i in range(600)
    ]
    rows += [(None, None, "batch", 5, 0.5, 0), (7, None, "single", None, None, None)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    log.repartition(5, "count").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = recent_counters(stream, str(tmp_path / "out")).first()
    want = monitor.service_counters(log).first()
    assert tuple(got) == tuple(want) and want["batch_requests_total"] > monitor.RECENT_BATCHES
    # more arrives, older than all: totals grow, the mean of the newest stays
    log.where("kind = 'batch' AND count > 0").withColumn("ts", F.lit(start) - F.expr("interval 9 days")).write.mode("append").parquet(str(tmp_path / "in"))
    more = recent_counters(stream, str(tmp_path / "out")).first()
    assert more["batch_requests_total"] == 2 * want["batch_requests_total"]
    assert more["avg_recent_batch_size"] == want["avg_recent_batch_size"] and more["last_prediction_at"] == want["last_prediction_at"]


def test_weekly_alerts_are_taken_before_rounding(spark):
    def week(day, scores):
        return [(dt.datetime(2024, 1, day), s, 0) for s in scores]

    # the second mean is 2.00003 standard errors above the first: 2.0 when rounded
    first, n = [0.4, 0.6], 4
    spread = np.std(first, ddof=1)
    mean = float(0.5 + 2.00003 * spread / math.sqrt(n))
    log = spark.createDataFrame(week(4, first) + week(11, [mean] * n), "ts timestamp, p double, y int")
    late = monitor.score_drift(log, 0.3).orderBy("week").collect()[-1]
    assert late["sigmas"] == 2.0 and late["alert"]


def test_booleans_and_dates_can_be_features(spark):
    df = spark.range(40).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 2 == 0).alias("flag"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")).alias("day"), F.lit("train").alias("partition"), F.lit("Yes").alias("label")
    )
    spec = RoleSpec.infer(df.drop("partition"), "label", "k")
    assert spec.numeric == ("flag",) and spec.categorical == ("day",)
    fitted = prep.fit_preprocessor(df, spec)
    assert fitted.feature_names() == ["num__flag", "cat__day_2024-01-01", "cat__day_2024-01-02", "cat__day_2024-01-03"]
    assert fitted.transform(df).select(prep.FEATURES).first()[0].size == 4


def test_frames_are_released(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("k"), (F.col("id") * 1.5).alias("v"), F.when(F.col("id") % 3 == 0, "validation").otherwise("train").alias("partition"), F.when(F.col("id") % 2 == 0, "Yes").otherwise("No").alias("label")
    )
    spec = RoleSpec.infer(df.drop("partition"), "label", "k")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with training.TrainingFrames.of(df, spec) as frames:
        frames.train.count()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before + 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_minority_must_be_larger_than_the_neighbourhood(spark):
    rows = [(f"r{i}", float(i), "Yes" if i < 5 else "No") for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, label string")
    spec = RoleSpec(id_col="k", target_col="label", numeric=("v",), categorical=())
    with pytest.raises(ValueError, match="5 neighbours need more"):
        smotenc.synthesize(df, spec)
