"""Every query with check SQL gives the same rows as that SQL."""

import time

import pytest
from harness import compare

import __spark_entry__ as entry
from keelson.catalog import load, model_queries
from keelson.operators import models
from keelson.plans import training
from keelson.roles import CUSTOMER

# minutes each at full effort; test_grid_points_share_fits covers their search on a smaller grid
SLOW = {"grid_search_rf", "grid_search_gbt"}
ORACLES = load()[1]


@pytest.fixture
def brief(monkeypatch):
    """Few trees and folds: what the flags of a model query state holds of any fit."""
    monkeypatch.setattr(model_queries, "EFFORT", training.Effort(trees=6, folds=2, forest_trees=5, forest_depth=4, threads=4))
    monkeypatch.setattr(model_queries, "_BUNDLES", {})


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW - {"train_upload"}))
def test_query_matches_sql(name, spark, duck, small, brief):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert compare(entry.queries()[name](spark, small), duck, ORACLES[name]) is None
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held


def test_upload_too_small_to_train_on_is_an_error(spark, small, brief):
    with pytest.raises(ValueError, match="too_few_rows"):
        entry.queries()["train_upload"](spark, small)


def test_grid_points_share_fits(spark, small):
    grid = {"trees": (3, 6), "depth": (2, 3), "rate": (0.1,), "subsample": (0.8,), "columns": (0.8,), "weight_factor": (0.0, 1.2)}
    points = models.grid_points(grid)
    assert len(models.longest_points(points)) == len(points) / 2
    with training.TrainingFrames.of(model_queries.parted(spark, small), CUSTOMER) as data:
        shared = models.fit_points(data.train, models.boosted_point, points, 4)
        for point, model in list(zip(points, shared))[:2]:
            alone = models.boosted_point(data.train, **point)
            both = models.score(alone, models.score(model, data.validation, "q")).collect()
            assert both and all(r["p"] == r["q"] for r in both)


def test_grid_search_equals_single_fits(spark, small):
    """Metrics from the stored distinct scores are those of each model scored on its own."""
    grid = {"trees": (3, 5), "depth": (2, None), "leaf": (5,), "balanced": (True,)}
    with training.TrainingFrames.of(model_queries.parted(spark, small), CUSTOMER) as data:
        found = {r["point"]: r for r in models.grid_search(data.train, data.validation, models.forest_point, grid, 4).collect()}
        assert len(found) == 4
        alone = {f"{i:03d}": models.score(models.forest_point(data.train, **p), data.validation) for i, p in enumerate(models.grid_points(grid))}
        for r in models.compare(alone).collect():
            assert all(found[r["model"]][c] == r[c] for c in ("f1", "pr_auc", "roc_auc", "recall", "precision"))


def test_boosted_grid_search_reads_short_points_in_threads(spark, small):
    """The first trees of a model are taken in the thread that fitted it, and score as a fit of so many trees."""
    grid = {"trees": (2, 4), "depth": (2, 3), "rate": (0.1,), "subsample": (0.8,), "columns": (0.8,), "weight_factor": (1.2,)}
    with training.TrainingFrames.of(model_queries.parted(spark, small), CUSTOMER) as data:
        found = {r["point"]: r for r in models.grid_search(data.train, data.validation, models.boosted_point, grid, 4).collect()}
        alone = {f"{i:03d}": models.score(models.boosted_point(data.train, **p), data.validation) for i, p in enumerate(models.grid_points(grid))}
        assert len(found) == 4
        for r in models.compare(alone).collect():
            assert all(found[r["model"]][c] == r[c] for c in ("f1", "pr_auc", "roc_auc", "recall", "precision"))


def test_grid_fits_read_rows_without_history(spark, small):
    """A fit is many short jobs, and each ships the lineage of its input: that of a checkpoint, for all points the same."""
    seen = []

    def fit(train, share):
        seen.append((train._jdf.queryExecution().executedPlan().toString(), train.count()))
        return models.MajorityModel(share)

    with training.TrainingFrames.of(model_queries.parted(spark, small), CUSTOMER) as data:
        found = models.grid_search(data.train, data.validation, fit, {"share": (0.0, 0.4, 1.0)}, 2).collect()
        rows = data.train.count()
    assert len(found) == len(seen) == 3
    assert all("ExistingRDD" in plan and "InMemory" not in plan and "Filter" not in plan and n == rows for plan, n in seen)


def test_deep_points_are_fitted_first():
    """The shallow fits fill the threads up at the end; each point that needs a fit is there once."""
    points = models.grid_points(models.BOOSTED_GRID)
    depths = [p["depth"] for p in models.longest_points(points)]
    assert depths == [5] * 24 + [3] * 24
    assert [p for p in points if p["trees"] == 200] == sorted(models.longest_points(points), key=points.index)


def test_parallel_jobs_are_handed_out_singly(spark):
    """A thread that still works on a long job keeps no other job back."""
    done = []

    def long():
        until = time.time() + 20
        while len(done) < 39 and time.time() < until:
            time.sleep(0.01)
        return len(done)

    assert models.run_parallel([long, *[lambda i=i: done.append(i) or i for i in range(39)]], 2) == [39, *range(39)]


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 150
    assert df.columns[:2] == ["primary_key", "churn_probability"]


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
