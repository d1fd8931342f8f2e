"""Model fits, calibration and search on Spark ML.

Encoded frames hold (id, y, partition, features).  Every fit reads the train
partition only; every score is a transform, so batches and streams share it.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keelson.operators import metrics, split
from keelson.operators import trees as grown
from keelson.operators.prep import FEATURES
from keelson.roles import RoleSpec
from keelson.session import durable, scratch_path

# ---------------------------------------------------------------- fixed values
SEED = 42
FOLDS = 5
BOOSTED = {"trees": 200, "depth": 3, "rate": 0.1, "subsample": 0.8, "columns": 1.0}
FOREST = {"trees": 200, "depth": 10, "leaf": 5}
LOGISTIC_ITERATIONS = 1000
FOREST_GRID = {
    "trees": (100, 200),
    "depth": (None, 10, 20),
    "leaf": (1, 5),
    "balanced": (False, True),
}
BOOSTED_GRID = {
    "trees": (100, 200),
    "depth": (3, 5),
    "rate": (0.05, 0.1),
    "subsample": (0.8, 1.0),
    "columns": (0.8, 1.0),
    "weight_factor": (0.0, 1.0, 1.2),
}
UNLIMITED_DEPTH = 30  # deepest tree that Spark ML grows
FORESTS_AT_A_TIME = 2  # of a grid: the driver holds the nodes of so many
# ------------------------------------------------------------ end fixed values

Fit = Callable[[DataFrame], Model]


def labelled(encoded: DataFrame, spec: RoleSpec) -> DataFrame:
    """Keep what a fit needs: id, 0/1 label, partition, vector."""
    y = F.when(F.col(spec.target_col) == spec.positive, 1.0).otherwise(0.0)
    kept = [spec.id_col, spec.target_col, *(["partition"] if "partition" in encoded.columns else [])]
    return encoded.select(*kept, y.alias("y"), FEATURES)


#: Training rows that one task reads at least, as a fit is many short jobs, and at most, which bounds its memory.
ROWS_PER_TASK = 20_000
MOST_ROWS_PER_TASK = 500_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` in even partitions, one per core of the cluster; small tables get fewer, very large ones more.

    Rows are dealt anew, as one file or shuffle partition may hold them all, and sorted, as the
    sampling of a fit goes by their order.
    """
    rows = df.count()
    tasks = min(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(tasks, -(-rows // MOST_ROWS_PER_TASK))
    if tasks <= 1:
        return df.coalesce(1)
    return df.repartition(tasks).sortWithinPartitions(*[c for c in df.columns if c != FEATURES])


def class_counts(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col("y") == 0).alias("n"), F.count_if(F.col("y") == 1).alias("p")).first()
    return int(row["n"]), int(row["p"])


def scale_pos_weight(df: DataFrame) -> float:
    negatives, positives = class_counts(df)
    if positives == 0:
        raise ValueError("no positive training rows")
    return negatives / positives


def weighted(df: DataFrame, positive: float, negative: float = 1.0) -> DataFrame:
    return df.withColumn("w", F.when(F.col("y") == 1, float(positive)).otherwise(float(negative)))


def class_balanced(df: DataFrame) -> DataFrame:
    negatives, positives = class_counts(df)
    n = negatives + positives
    return weighted(df, n / (2 * max(positives, 1)), n / (2 * max(negatives, 1)))


@dataclass(frozen=True)
class MajorityModel:
    """Predicts the majority class; the positive probability is 0 or 1."""

    p: float

    def transform(self, df: DataFrame) -> DataFrame:
        share = F.lit(float(self.p))
        return df.withColumn("probability", array_to_vector(F.array(1 - share, share)))


def fit_majority(df: DataFrame) -> MajorityModel:
    negatives, positives = class_counts(df)
    return MajorityModel(1.0 if positives > negatives else 0.0)


def fit_logistic(df: DataFrame, *, c: float = 1.0, iterations: int = LOGISTIC_ITERATIONS) -> LogisticRegressionModel:
    """L2 with strength C: the penalty is shared over the summed weights."""
    source = df if "w" in df.columns else df.withColumn("w", F.lit(1.0))
    total = source.agg(F.sum("w")).first()[0]
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol="y",
        weightCol="w",
        maxIter=iterations,
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        standardization=False,
    ).fit(source)


def fit_forest(df: DataFrame, *, trees: int = FOREST["trees"], depth: int | None = FOREST["depth"], leaf: int = FOREST["leaf"], seed: int = SEED) -> Model:
    source = df if "w" in df.columns else df.withColumn("w", F.lit(1.0))
    return RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol="y",
        weightCol="w",
        numTrees=trees,
        maxDepth=UNLIMITED_DEPTH if depth is None else depth,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt",
        maxMemoryInMB=512,
        cacheNodeIds=True,
        seed=seed,
    ).fit(source)


def fit_boosted(df: DataFrame, *, trees: int = BOOSTED["trees"], depth: int = BOOSTED["depth"], rate: float = BOOSTED["rate"], subsample: float = BOOSTED["subsample"], columns: float = BOOSTED["columns"], seed: int = SEED) -> GBTClassificationModel:
    source = df if "w" in df.columns else df.withColumn("w", F.lit(1.0))
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol="y",
        weightCol="w",
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy="all" if columns >= 1.0 else str(columns),
        seed=seed,
    ).fit(source)


def score(model: Any, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the positive probability; other model outputs are dropped."""
    kept = df.columns
    out = model.transform(df)
    return out.select(*kept, vector_to_array("probability").getItem(1).alias(name))


def run_parallel(jobs: Sequence[Callable[[], Any]], threads: int) -> list[Any]:
    """Submit independent Spark jobs from a few driver threads, results in order."""
    if threads <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    session = SparkSession.getActiveSession()
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(session)(lambda job: job()), jobs, chunksize=1)


# ------------------------------------------------------------------ calibration


def fit_platt(scored: DataFrame) -> LogisticRegressionModel:
    """Logistic curve on the held-out probability with soft targets.

    A soft target t enters as a positive row of weight t and a negative row of
    weight 1 - t.
    """
    negatives, positives = class_counts(scored)
    high, low = (positives + 1.0) / (positives + 2.0), 1.0 / (negatives + 2.0)
    target = F.when(F.col("y") == 1, high).otherwise(low)
    both = F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w")))
    rows = scored.select(array_to_vector(F.array("p")).alias("x"), F.inline(both))
    return LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=200, tol=1e-9, standardization=False
    ).fit(rows)


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    # equal probabilities first become one weighted row: the same fit, and no value is a hot key
    levels = scored.groupBy("p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    rows = levels.select(array_to_vector(F.array("p")).alias("x"), "y", "w")
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=True).fit(rows)


def calibrate(model: Model, df: DataFrame, source: str, name: str) -> DataFrame:
    """Map the probability column ``source`` through one calibrator."""
    if isinstance(model, LogisticRegressionModel):
        slope, shift = float(model.coefficients[0]), float(model.intercept)
        return df.withColumn(name, 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col(source) + F.lit(shift)))))
    kept = df.columns
    prepared = df.withColumn("_x", array_to_vector(F.array(source)))
    out = model.setFeaturesCol("_x").setPredictionCol("_cal").transform(prepared)
    return out.select(*kept, F.least(F.greatest("_cal", F.lit(0.0)), F.lit(1.0)).alias(name))


@dataclass(frozen=True)
class CalibratedModel:
    """Pairs of (model, calibrator), one per fold; probabilities are averaged."""

    pairs: tuple[tuple[Any, Model], ...]
    method: str

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        out, kept = df, df.columns
        for i, (model, calibrator) in enumerate(self.pairs):
            out = score(model, out, f"_raw_{i}")
            out = calibrate(calibrator, out, f"_raw_{i}", f"_p_{i}")
        mean = sum((F.col(f"_p_{i}") for i in range(len(self.pairs))), F.lit(0.0)) / len(self.pairs)
        return out.select(*kept, mean.alias(name))


def out_of_fold(df: DataFrame, spec: RoleSpec, fit: Fit, folds: int = FOLDS, threads: int = 2) -> list[tuple[Any, DataFrame]]:
    """Per fold: the model fitted on the other folds, and its scores of the fold."""
    folded = split.assign_folds(df, spec, folds)

    def one(k: int) -> tuple[Any, DataFrame]:
        model = fit(folded.where(F.col("fold") != k).drop("fold"))
        return model, score(model, folded.where(F.col("fold") == k))

    return run_parallel([lambda k=k: one(k) for k in range(folds)], threads)


def fit_calibrated(df: DataFrame, spec: RoleSpec, fit: Fit, methods: Sequence[str] = ("sigmoid",), folds: int = FOLDS, threads: int = 2) -> dict[str, CalibratedModel]:
    """Calibrated models per method, sharing the fold fits."""
    curves = {"sigmoid": fit_platt, "isotonic": fit_isotonic}
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = out_of_fold(cached, spec, fit, folds, threads)
        jobs = [lambda m=m, scored=scored: curves[m](scored) for m in methods for _, scored in held]
        fitted = iter(run_parallel(jobs, threads))
        return {m: CalibratedModel(tuple((model, next(fitted)) for model, _ in held), m) for m in methods}
    finally:
        cached.unpersist()


# ------------------------------------------------------------------ bundle


@dataclass(frozen=True)
class Bundle:
    """Preprocessing pipeline, calibrated model, threshold and metadata."""

    pipeline: PipelineModel
    model: CalibratedModel
    threshold: float
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Probabilities for prepared feature columns; an empty table is an error."""
        if not df.isStreaming and df.isEmpty():
            raise ValueError("features must contain at least one row")
        return self.model.score(self.pipeline.transform(df), name).select(*df.columns, name)

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """id, probability, decision and threshold; the key travels with its row."""
        scored = self.score(df, "churn_probability")
        flag = (F.col("churn_probability") >= F.lit(float(self.threshold))).cast("int")
        return scored.select(
            id_col,
            "churn_probability",
            flag.alias("retention_recommended"),
            F.lit(float(self.threshold)).alias("decision_threshold"),
        )

    def save(self, spark: SparkSession, path: str) -> str:
        """Write a new version below ``path`` and, last of all, the entry that makes it the current one.

        No file of an older version is touched, so a save that fails at any point leaves the version
        before it in force.
        """
        version = uuid.uuid4().hex
        folder = f"{path}/versions/{version}"
        self.pipeline.write().save(f"{folder}/pipeline")
        for i, (model, calibrator) in enumerate(self.model.pairs):
            PipelineModel([model]).write().save(f"{folder}/fold-{i}/model")
            PipelineModel([calibrator]).write().save(f"{folder}/fold-{i}/calibrator")
        note = {
            "kind": "keelson-bundle",
            "folds": len(self.model.pairs),
            "method": self.model.method,
            "threshold": self.threshold,
            "metadata": dict(self.metadata),
        }
        held = bundle_versions(spark, path)
        last = held[0]["number"] if held else 0
        entry = [(last + 1, version, folder_digest(spark, folder), json.dumps(note))]
        spark.createDataFrame(entry, VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/current")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, number: int | None = None) -> Bundle:
        """The current version, or the one with ``number``; its files must have the digest noted for them."""
        held = [r for r in bundle_versions(spark, path) if number is None or r["number"] == number]
        if not held:
            raise FileNotFoundError(f"no model bundle at {path}")
        folder = f"{path}/versions/{held[0]['version']}"
        if folder_digest(spark, folder) != held[0]["digest"]:
            raise ValueError(f"the model files in {folder} are not those that were saved")
        note = json.loads(held[0]["note"])
        if note.get("kind") != "keelson-bundle":
            raise TypeError(f"{path} does not hold a model bundle")
        pairs = tuple(
            (
                PipelineModel.load(f"{folder}/fold-{i}/model").stages[0],
                PipelineModel.load(f"{folder}/fold-{i}/calibrator").stages[0],
            )
            for i in range(note["folds"])
        )
        return cls(
            PipelineModel.load(f"{folder}/pipeline"),
            CalibratedModel(pairs, note["method"]),
            float(note["threshold"]),
            note["metadata"],
        )


VERSION_SCHEMA = "number long, version string, digest string, note string"


def bundle_versions(spark: SparkSession, path: str) -> list[Row]:
    """Complete versions at ``path``, the current one first: one row per save."""
    try:
        found = spark.read.schema(VERSION_SCHEMA).parquet(f"{path}/current").collect()
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(found, key=lambda r: (r["number"], r["version"]), reverse=True)


def folder_digest(spark: SparkSession, folder: str) -> str:
    """One digest of the names and contents of all files below ``folder`` (a model: few files per fold)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/"), -1)
    entry = F.concat_ws(" ", name, F.sha2("content", 256))
    return files.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(entry))), 256)).first()[0]


# ------------------------------------------------------------------ comparison and search


def compare(scored: Mapping[str, DataFrame], threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """One metrics row per named table of (y, p); all of them share one ordered pass."""
    tables = [df.select(F.lit(name).alias("model"), "y", "p") for name, df in scored.items()]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return metrics.report(union, "p", "y", threshold, ["model"], digits)


def grid_points(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def longest_points(points: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Points that must be fitted when shorter boosted fits are prefixes of longer ones, deepest first.

    A tree takes a job per level: fits that take longest do not begin last, when threads run out of work.
    """
    longest: dict[str, dict[str, Any]] = {}
    for p in points:
        key = json.dumps({k: v for k, v in p.items() if k != "trees"})
        if key not in longest or p["trees"] > longest[key]["trees"]:
            longest[key] = dict(p)
    return sorted(longest.values(), key=lambda p: -p["depth"])


def fit_points(train: DataFrame | grown.Binned, fit: Callable[..., Any], points: Sequence[Mapping[str, Any]], threads: int) -> list[Any]:
    """One model per point; boosted points that differ in trees share a fit, and all fits their jobs.

    Boosting adds trees one after the other, and tree m depends on the seed and on the trees before it only:
    the first trees of a fit are what a fit of so many trees with the same settings gives.
    """
    if fit is not boosted_point:
        return run_parallel([lambda p=p: fit(train, **p) for p in points], threads)
    needed = longest_points(points)
    by_key = {json.dumps(_but_trees(p)): m for p, m in zip(needed, boosted_points(train, needed, threads), strict=True)}
    return [by_key[json.dumps(_but_trees(p))].first(p["trees"]) for p in points]


def grid_search(train: DataFrame, validation: DataFrame, fit: Callable[..., Any], grid: Mapping[str, Sequence[Any]], threads: int = 2) -> DataFrame:
    """Fit every grid point on train, score on validation, order by F1 then position.

    Each point is fitted and scored in jobs of its own, several at a time; what is kept of it are its
    distinct validation scores with their counts of either label, written once. A plan holds one
    model, and the driver lets go of a model before the next fit of its thread. One pass over the
    scores of all points, grouped by point, gives the metrics.

    The training rows are checkpointed, as each of the many short jobs of a fit ships the whole
    lineage of its input with its tasks. Forests and boosted trees of the grid grow from rows that are
    binned once. A forest keeps all cores busy, so few are grown at a time; boosted points are fitted
    side by side.
    """
    spark = train.sparkSession
    train = durable(train)
    points = grid_points(grid)
    path = scratch_path(spark, "grid-scores")
    rows = validation.select("y", FEATURES)
    if fit in (forest_point, boosted_point):
        train = grown.binned(train)

    def keep(i: int, model: Any) -> None:
        scored = score(model, rows).groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
        scored.write.mode("overwrite").parquet(f"{path}/point={i}")
        if isinstance(model, grown.GrownModel):
            model.release()

    if fit is boosted_point:
        fitted = fit_points(train, fit, points, threads)
        run_parallel([lambda i=i, m=m: keep(i, m) for i, m in enumerate(fitted)], threads)
    else:
        at_a_time = min(threads, FORESTS_AT_A_TIME) if fit is forest_point else threads
        run_parallel([lambda i=i, p=p: keep(i, fit(train, **p)) for i, p in enumerate(points)], at_a_time)
    if isinstance(train, grown.Binned):
        train.release()
    found = spark.read.schema("p double, pos long, neg long, point int").option("basePath", path).parquet(path)
    table = metrics.report_counts(found, ["point"])
    names = F.create_map(*[F.lit(x) for i, p in enumerate(points) for x in (i, json.dumps(p))])
    return table.select(
        F.lpad(F.col("point").cast("string"), 3, "0").alias("point"), F.element_at(names, F.col("point")).alias("params"),
        "f1", "pr_auc", "roc_auc", "recall", "precision",
    ).orderBy(F.desc("f1"), "point")


def _but_trees(point: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in point.items() if k != "trees"}


def forest_point(train: DataFrame | grown.Binned, *, trees: int, depth: int | None, leaf: int, balanced: bool) -> grown.GrownModel:
    """A forest of the grid; rows that are binned once serve all points."""
    with _binned(train) as rows:
        n = rows.negatives + rows.positives
        weights = (n / (2 * max(rows.negatives, 1)), n / (2 * max(rows.positives, 1))) if balanced else (1.0, 1.0)
        return grown.forest(rows, trees=trees, depth=UNLIMITED_DEPTH if depth is None else depth, leaf=leaf, weights=weights, seed=SEED)


def _binned(train: DataFrame | grown.Binned) -> AbstractContextManager[grown.Binned]:
    """Binned rows: those given, or of a table and released at the end."""
    return nullcontext(train) if isinstance(train, grown.Binned) else grown.binned(train)


def boosted_point(train: DataFrame | grown.Binned, *, trees: int, depth: int, rate: float, subsample: float, columns: float, weight_factor: float) -> grown.GrownModel:
    """``weight_factor`` scales the class ratio; 0 means unweighted."""
    point = {"trees": trees, "depth": depth, "rate": rate, "subsample": subsample, "columns": columns, "weight_factor": weight_factor}
    return boosted_points(train, [point])[0]


def boosted_points(train: DataFrame | grown.Binned, points: Sequence[Mapping[str, Any]], threads: int = 1) -> list[grown.GrownModel]:
    """Fits of boosted points: those of one depth and number of trees take the same jobs."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(points):
        alike.setdefault((p["depth"], p["trees"]), []).append(i)
    with _binned(train) as rows:
        if not rows.positives and any(p["weight_factor"] for p in points):
            raise ValueError("no positive training rows")

        def together(size: tuple[int, int]) -> list[grown.GrownModel]:
            fits = []
            for p in (points[i] for i in alike[size]):
                ratio = rows.negatives / rows.positives * p["weight_factor"] if p["weight_factor"] else 1.0
                fits.append(grown.Boosting(ratio, p["rate"], p["subsample"], p["columns"]))
            return grown.boost(rows, fits, depth=size[0], trees=size[1], seed=SEED)

        found = run_parallel([lambda size=size: together(size) for size in alike], threads)
    by_point = {i: m for size, models in zip(alike, found, strict=True) for i, m in zip(alike[size], models, strict=True)}
    return [by_point[i] for i in range(len(points))]
