"""Training jobs: preprocessing, the calibrated model, comparisons, and the retrain service."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.operators import cleaning, metrics, models, policy, prep, smotenc, split
from keelson.operators.prep import FEATURES
from keelson.roles import RoleSpec
from keelson.session import durable, scratch_path
from keelson.sources.files import write_table

ROW_KEY = "upload_row_id"
#: Candidates of the model comparison: family and strategy.
COMPARED = (
    ("majority", "baseline"),
    ("logistic", "original"),
    ("logistic", "class_weight"),
    ("logistic", "undersample"),
    ("forest", "class_weight"),
    ("boosted", "original"),
    ("boosted", "class_weight"),
    ("boosted", "undersample"),
)
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def preprocess(parted: DataFrame, spec: RoleSpec) -> tuple[prep.Preprocessor, DataFrame, DataFrame]:
    """Fit on train, transform every partition, and check the matrix."""
    fitted = prep.fit_preprocessor(parted, spec)
    encoded = fitted.transform(parted)
    checks = prep.validate_matrix(encoded)
    width = F.col("min_width") == F.col("max_width")
    return fitted, encoded, checks.withColumn("passed", width & (F.col("nan_rows") == 0) & (F.col("inf_rows") == 0))


@dataclass(frozen=True)
class Effort:
    """How long to train; the defaults are the production settings."""

    trees: int = models.BOOSTED["trees"]
    folds: int = models.FOLDS
    forest_trees: int = models.FOREST["trees"]
    forest_depth: int = models.FOREST["depth"]
    iterations: int = models.LOGISTIC_ITERATIONS
    threads: int = 2


def train_final(parted: DataFrame, spec: RoleSpec, threshold: float, effort: Effort = Effort(), method: str = "sigmoid") -> models.Bundle:
    """Class-weighted boosted trees, calibrated by folds; only the train partition is read."""
    fitted = prep.fit_preprocessor(parted, spec)
    train = models.sized(models.labelled(fitted.transform(parted.where("partition = 'train'")), spec))
    ratio = models.scale_pos_weight(train)
    calibrated = models.fit_calibrated(
        models.weighted(train, ratio), spec, partial(models.fit_boosted, trees=effort.trees), (method,), effort.folds, effort.threads
    )[method]
    metadata = {
        "model_family": "gradient boosted trees",
        "calibration_method": method,
        "calibration_folds": effort.folds,
        "scale_pos_weight": ratio,
        "trees": effort.trees,
        "trained_on": "train_only",
        "trained_rows": fitted.rows,
        "numeric": list(spec.numeric),
        "categorical": list(spec.categorical),
    }
    return models.Bundle(fitted.pipeline, calibrated, float(threshold), metadata)


def artifacts_present(spark: SparkSession, path: str) -> bool:
    try:
        models.Bundle.load(spark, path)
    except (FileNotFoundError, TypeError):
        return False
    return True


def run_pipeline(raw: DataFrame, spec: RoleSpec, path: str, threshold: float, effort: Effort = Effort(), *, force: bool = False) -> models.Bundle:
    """clean -> split -> train -> save; an existing result is loaded unless forced."""
    spark = raw.sparkSession
    if not force and artifacts_present(spark, path):
        return models.Bundle.load(spark, path)
    cleaned = spark.read.parquet(write_table(cleaning.clean_charges(raw, spec, strict=True), f"{path}/cleaned"))
    parted = split.stratified_split(cleaning.separate(cleaned, spec), spec)
    write_table(parted.select(spec.id_col, "partition"), f"{path}/manifest")
    bundle = train_final(parted, spec, threshold, effort)
    bundle.save(spark, path)
    return bundle


# ------------------------------------------------------------------ comparisons


def _evaluated(rows: dict[tuple[str, str], DataFrame], digits: int = 4) -> DataFrame:
    """Metrics of (model, strategy) score tables as one small materialised table."""
    table = models.compare({f"{m}|{s}": df for (m, s), df in rows.items()}, digits=digits)
    parts = F.split("model", r"\|")
    out = table.select(
        F.element_at(parts, 1).alias("model"), F.element_at(parts, 2).alias("strategy"), *METRICS, "predicted"
    )
    # one row per candidate
    return out.sparkSession.createDataFrame(out.collect(), out.schema)


@dataclass(frozen=True)
class TrainingFrames:
    """Encoded train and validation rows, kept while several models are fitted."""

    train: DataFrame
    validation: DataFrame
    fitted: prep.Preprocessor
    kept: DataFrame

    @classmethod
    def of(cls, parted: DataFrame, spec: RoleSpec) -> TrainingFrames:
        fitted = prep.fit_preprocessor(parted, spec)
        rows = models.labelled(fitted.transform(parted.where("partition <> 'test'")), spec)
        kept = models.sized(rows).persist(StorageLevel.MEMORY_AND_DISK)
        return cls(kept.where("partition = 'train'"), kept.where("partition = 'validation'"), fitted, kept)

    def release(self) -> None:
        self.kept.unpersist()

    def __enter__(self) -> TrainingFrames:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def _candidate(name: str, effort: Effort) -> Callable[[DataFrame], Any]:
    return {
        "majority": models.fit_majority,
        "logistic": partial(models.fit_logistic, iterations=effort.iterations),
        "forest": partial(models.fit_forest, trees=effort.forest_trees, depth=effort.forest_depth),
        "boosted": partial(models.fit_boosted, trees=effort.trees),
    }[name]


def _weighted_for(name: str, train: DataFrame) -> DataFrame:
    """Logistic and forest use balanced weights, boosting the class ratio."""
    if name == "boosted":
        return models.weighted(train, models.scale_pos_weight(train))
    return models.class_balanced(train)


def imbalance_matrix(parted: DataFrame, spec: RoleSpec, effort: Effort = Effort()) -> DataFrame:
    """Two models x four strategies on validation, ordered by model and average precision."""
    frames = TrainingFrames.of(parted, spec)
    validation = frames.validation
    grown = smotenc.oversample(parted.where("partition = 'train'"), spec).withColumn("partition", F.lit("train"))
    try:
        # resampling happens before encoding, so the encoder is refitted on the grown rows
        grown = durable(grown)
        refit = prep.fit_preprocessor(grown, spec)
        grown_train = models.sized(models.labelled(refit.transform(grown), spec))
        raw_validation = parted.where("partition = 'validation'")
        grown_validation = models.labelled(refit.transform(raw_validation), spec)
        smaller = split.undersample(frames.train, spec)
        jobs, names = [], []
        for name in ("logistic", "boosted"):
            fit = _candidate(name, effort)
            for strategy, train, against in (
                ("original", frames.train, validation),
                ("class_weight", _weighted_for(name, frames.train), validation),
                ("undersample", smaller, validation),
                ("smotenc", grown_train, grown_validation),
            ):
                names.append((name, strategy))
                jobs.append(lambda fit=fit, train=train, against=against: models.score(fit(train), against))
        scored = dict(zip(names, models.run_parallel(jobs, effort.threads), strict=True))
        return _evaluated(scored).orderBy("model", F.desc("pr_auc"))
    finally:
        frames.release()


def model_comparison(parted: DataFrame, spec: RoleSpec, effort: Effort = Effort()) -> DataFrame:
    """Eight candidates on validation, ranked by average precision."""
    frames = TrainingFrames.of(parted, spec)
    try:
        smaller = split.undersample(frames.train, spec)
        rows = {
            "class_weight": lambda name: _weighted_for(name, frames.train),
            "undersample": lambda name: smaller,
        }
        plan = [(m, s, rows.get(s, lambda name: frames.train)(m)) for m, s in COMPARED]
        jobs = [
            lambda m=m, t=t: models.score(_candidate(m, effort)(t), frames.validation) for m, _, t in plan
        ]
        scored = models.run_parallel(jobs, effort.threads)
        table = _evaluated({(m, s): df for (m, s, _), df in zip(plan, scored, strict=True)})
        order = Window.orderBy(F.desc("pr_auc"), "model", "strategy")  # eight rows
        return table.withColumn("rank", F.row_number().over(order))
    finally:
        frames.release()


def calibration_comparison(parted: DataFrame, spec: RoleSpec, effort: Effort = Effort()) -> DataFrame:
    """Uncalibrated, sigmoid and isotonic probabilities of the same model on validation."""
    frames = TrainingFrames.of(parted, spec)
    try:
        fit = partial(models.fit_boosted, trees=effort.trees)
        train = models.weighted(frames.train, models.scale_pos_weight(frames.train))
        plain = models.score(fit(train), frames.validation)
        curves = models.fit_calibrated(train, spec, fit, ("sigmoid", "isotonic"), effort.folds, effort.threads)
        tables = {"uncalibrated": plain, **{m: c.score(frames.validation) for m, c in curves.items()}}
        union = None
        for name, df in tables.items():
            part = df.select(F.lit(name).alias("method"), "y", "p")
            union = part if union is None else union.unionByName(part)
        out = metrics.calibration_error(union, "p", "y", ["method"], 4)
        return out.sparkSession.createDataFrame(out.collect(), out.schema)  # one row per method
    finally:
        frames.release()


# ------------------------------------------------------------------ retrain service


@dataclass(frozen=True)
class TrainingResult:
    bundle: models.Bundle
    results: DataFrame
    validation_metrics: DataFrame
    test_metrics: DataFrame
    spec: RoleSpec


def train_upload(df: DataFrame, target_col: str, id_col: str | None = None, effort: Effort = Effort()) -> TrainingResult:
    """Validate, split, train, choose the threshold on validation, score every row.

    Raw features stay in one struct, so no feature can overwrite a result column.
    """
    failed = cleaning.retrain_checks(df, target_col, id_col).where("failed").orderBy("step").head(1)
    if failed:
        raise ValueError(f"dataset cannot be used for training: {failed[0]['code']} ({failed[0]['value']})")
    key = id_col
    if key is None:
        key = ROW_KEY
        # generated ids must not change between scans
        df = durable(df.withColumn(key, F.concat(F.lit("R"), F.monotonically_increasing_id().cast("string"))))
    spec = replace(RoleSpec.infer(df, target_col, key), target_col="label")
    named = cleaning.normalize_target(df, target_col, "label").select(key, *spec.features, "label")
    parted = split.stratified_split(named, spec)
    draft = train_final(parted, spec, 0.5, effort)
    y = F.when(F.col("label") == "Yes", 1).otherwise(0)
    # written once, read by the sweep, the reports and the result: nothing stays persisted
    path = scratch_path(df.sparkSession, "upload-scores")
    scored = df.sparkSession.read.parquet(write_table(draft.score(parted.withColumn("y", y)), path))
    best = metrics.cheapest(metrics.sweep(scored.where("partition = 'validation'"), "p", "y")).first()
    threshold = float(best["threshold"])
    bundle = replace(draft, threshold=threshold)
    decided = policy.decide(scored, "p", threshold)
    results = decided.orderBy(F.desc("p"), key).select(
        F.col(key).cast("string").alias("primary_key"),
        F.col("p").alias("churn_probability"),
        *policy.RESULT_COLUMNS[2:],
        F.col("label").alias("actual_churn"),
        F.struct(*spec.features).alias("details"),
    )
    reports = {
        part: metrics.report(scored.where(F.col("partition") == part), "p", "y", threshold)
        for part in ("validation", "test")
    }
    return TrainingResult(bundle, results, reports["validation"], reports["test"], spec)


def explain_frames(parted: DataFrame, spec: RoleSpec, effort: Effort = Effort()) -> tuple[Any, DataFrame, list[str]]:
    """An uncalibrated class-weighted model, encoded validation rows, readable names."""
    with TrainingFrames.of(parted, spec) as frames:
        model = models.fit_boosted(
            models.weighted(frames.train, models.scale_pos_weight(frames.train)), trees=effort.trees
        )
        names = [n.replace("num__", "").replace("cat__", "").replace("_", " ") for n in frames.fitted.feature_names()]
        return model, frames.validation.select(spec.id_col, "y", FEATURES), names
