"""Trees grown from binned rows against those of Spark ML, against themselves, and in number of jobs."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector

from keelson.operators import models, prep, trees


def table(spark, rows, seed=3, parts=1):
    """Six features of few values and two of 0 and 1, label that follows some of them, copies of rows among them."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(0, 20, (rows, 6)), rng.integers(0, 2, (rows, 2))], axis=1).astype(float)
    y = (x[:, 0] + 6 * x[:, 6] * x[:, 1] / 20 + rng.normal(scale=4, size=rows) > 13).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(rows), "y": y, "x": list(x)}))
    df = df.unionAll(df.limit(rows // 10)).coalesce(1)
    return df.select("id", "y", array_to_vector("x").alias(prep.FEATURES)).repartition(parts, "id")


def jobs_of(spark, work):
    """Number of Spark jobs of ``work``, with what it returned."""
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "counted")
    try:
        out = work()
        return len(context.statusTracker().getJobIdsForGroup(group)), out
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def scores(model, df):
    rows = models.score(model, df).select("id", "p").toPandas()
    return rows.sort_values(["id", "p"])["p"].to_numpy()


@pytest.mark.parametrize("leaf", [1, 20])
def test_tree_is_that_of_spark(spark, leaf):
    df = table(spark, 3000)
    with trees.binned(df) as rows:
        (block,) = rows.blocks.collect()
        how = trees.Growth(5, leaf, 8, (1.0, 1.0), 1)
        tree = trees._grow(how, block.codes, block.y, np.ones(len(block.y), np.uint8), 0)
    model = DecisionTreeClassifier(featuresCol=prep.FEATURES, labelCol="y", maxDepth=5, minInstancesPerNode=leaf).fit(df)
    assert len(tree.feature) == model.numNodes > 15
    assert np.allclose(scores(trees.GrownModel((tree,), rows.cuts), df), scores(model, df), atol=1e-12)


@pytest.mark.parametrize("balanced", [False, True])
def test_forest_is_the_same_wherever_its_nodes_are_split(spark, monkeypatch, balanced):
    """Nodes split in passes over the blocks and nodes grown in one task give one and the same forest."""
    monkeypatch.setattr(trees, "BLOCK_ROWS", 300)
    df = table(spark, 1500, parts=3)
    point = {"trees": 4, "depth": None, "leaf": 1, "balanced": balanced}
    with trees.binned(df) as rows:
        assert rows.blocks.getNumPartitions() == 6
        whole = models.forest_point(rows, **point)
        monkeypatch.setattr(trees, "GROUP_ROWS", 150)
        parted = models.forest_point(rows, **point)
        monkeypatch.setattr(trees, "GROUP_ROWS", 0)
        passes = models.forest_point(rows, **point)
    assert len(whole.trees) == 4 and all(len(t.feature) > 100 for t in whole.trees)
    for other in (parted, passes):
        assert [len(t.feature) for t in other.trees] == [len(t.feature) for t in whole.trees]
        assert (scores(other, df) == scores(whole, df)).all()


def test_forest_learns_and_keeps_its_limits(spark):
    df = table(spark, 3000)
    y = df.toPandas().sort_values("id")["y"].to_numpy()
    deep = models.forest_point(df, trees=10, depth=None, leaf=1, balanced=False)
    assert np.corrcoef(scores(deep, df), y)[0, 1] > 0.9
    assert not (deep.trees[0].feature[:50].tolist() == deep.trees[1].feature[:50].tolist())
    flat = models.forest_point(df, trees=10, depth=3, leaf=5, balanced=False)
    assert max(len(t.feature) for t in flat.trees) <= 15
    even = models.forest_point(df, trees=10, depth=3, leaf=5, balanced=True)
    assert scores(even, df).mean() > scores(flat, df).mean() + 0.05 and y.mean() < 0.45


def test_deep_forest_takes_few_jobs(spark):
    """A job for each batch of nodes made the jobs of a fit grow with its depth."""
    df = table(spark, 3000)
    jobs, model = jobs_of(spark, lambda: models.forest_point(df, trees=5, depth=None, leaf=1, balanced=True))
    assert len(model.trees) == 5 and 0 < jobs < 12


def test_many_values_are_cut_at_quantiles_of_all_rows(spark):
    x = np.random.default_rng(1).exponential(size=5000)
    df = spark.createDataFrame(pd.DataFrame({"y": (x > 1).astype(float), "x": [[v, 1.0] for v in x]}))
    with trees.binned(df.select("y", array_to_vector("x").alias(prep.FEATURES))) as rows:
        (block,) = rows.blocks.collect()
    assert len(rows.cuts[0]) == 31 and len(rows.cuts[1]) == 0
    counts = np.bincount(block.codes[0], minlength=32)
    assert counts.sum() == 5000 and counts.min() > 120 and counts.max() < 200


def test_table_without_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="no training rows"):
        trees.binned(table(spark, 30).where("id < 0"))


@pytest.mark.parametrize(("factor", "fit_rows"), [(0.0, 0), (1.2, 100_000)])
def test_boosted_trees_are_those_of_spark(spark, monkeypatch, factor, fit_rows):
    """Without draws of rows or features a fit beside others scores as Spark ML's."""
    monkeypatch.setattr(trees, "FIT_ROWS", fit_rows)
    df = table(spark, 3000)
    point = {"trees": 12, "depth": 3, "subsample": 1.0, "columns": 1.0, "weight_factor": factor}
    points = [point | {"rate": 0.1}, point | {"rate": 0.5}]
    for p, model in zip(points, models.boosted_points(df, points, 2), strict=True):
        ratio = models.scale_pos_weight(df) * factor if factor else 1.0
        alone = models.fit_boosted(models.weighted(df, ratio), trees=12, depth=3, rate=p["rate"], subsample=1.0, columns=1.0)
        assert [len(t.feature) for t in model.trees] == [t.numNodes for t in alone.trees]
        assert np.allclose(scores(model, df), scores(alone, df), atol=1e-9)


def test_boosted_fits_are_the_same_alone_and_over_any_steps(spark, monkeypatch):
    """A task for each fit, jobs for all of them, and margins computed anew give the same trees."""
    monkeypatch.setattr(trees, "BLOCK_ROWS", 300)
    df = table(spark, 1500, parts=3)
    grid = {"trees": (3, 9), "depth": (2, 4), "rate": (0.1,), "subsample": (0.6, 1.0), "columns": (0.5, 1.0), "weight_factor": (1.0,)}
    points = models.grid_points(grid)
    with trees.binned(df) as rows:
        assert rows.blocks.getNumPartitions() == 6
        together = models.fit_points(rows, models.boosted_point, points, 2)
        monkeypatch.setattr(trees, "FIT_ROWS", 0)
        monkeypatch.setattr(trees, "STEPS", 2)
        monkeypatch.setattr(trees, "CELLS", 500)
        alone = [models.boosted_point(rows, **p) for p in points[-3:]]
        short = models.boosted_point(rows, **points[0])
    seen = [scores(m, df) for m in together]
    assert [len(m.trees) for m in together] == [p["trees"] for p in points]
    assert all(np.allclose(scores(a, df), b, atol=1e-12) for a, b in zip(alone, seen[-3:], strict=True))
    assert np.allclose(scores(short, df), seen[0], atol=1e-12)
    y = df.toPandas().sort_values("id")["y"].to_numpy()
    assert all(np.corrcoef(s, y)[0, 1] > 0.5 for s in seen)
    assert len({tuple(s) for s in seen}) == len(points)  # each setting changes the fit


def test_boosted_points_share_their_jobs(spark, monkeypatch):
    """A job for each level of each tree of each fit made the grid 38,400 jobs."""
    df = table(spark, 600)
    grid = {"trees": (5,), "depth": (2,), "rate": (0.1,), "subsample": (0.8, 1.0), "columns": (0.8, 1.0), "weight_factor": (0.0, 1.0)}
    points = models.grid_points(grid)
    with trees.binned(df) as rows:
        small, found = jobs_of(spark, lambda: models.fit_points(rows, models.boosted_point, points, 4))
        monkeypatch.setattr(trees, "FIT_ROWS", 0)
        large, same = jobs_of(spark, lambda: models.fit_points(rows, models.boosted_point, points, 4))
    assert len(points) == len(found) == len(same) == 8
    assert small == 1 and 0 < large <= 5 * 2


def test_features_of_one_value_give_the_share(spark):
    """Nothing to split by: a tree of one leaf, and boosting that moves the level only."""
    df = spark.createDataFrame([(i, float(i % 4 == 0), [1.0, 2.0]) for i in range(80)], "id int, y double, x array<double>")
    df = df.select("id", "y", array_to_vector("x").alias(prep.FEATURES))
    point = {"depth": 3, "rate": 0.1, "subsample": 1.0, "columns": 1.0, "weight_factor": 0.0}
    boosted = models.boosted_point(df, trees=60, **point)
    assert all(len(t.feature) == 1 for t in boosted.trees) and np.allclose(scores(boosted, df), 0.25, atol=0.01)
    forest = models.forest_point(df, trees=30, depth=3, leaf=1, balanced=False)
    assert all(len(t.feature) == 1 for t in forest.trees) and abs(scores(forest, df)[0] - 0.25) < 0.05
