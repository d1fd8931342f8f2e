"""Train-only preprocessing: impute, scale, one-hot; a persistable ML pipeline."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from keelson.functions.ranked import exact_quantiles, unpivot, value_counts
from keelson.roles import RoleSpec

FEATURES = "features"
MAX_LEVELS = 20_000  # of one categorical column


def medians(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Exact median per numeric column."""
    long = unpivot(df, [], spec.numeric, "double")
    return exact_quantiles(long, ["feature"], "value", {"median": 0.5}).select("feature", "median")


def modes(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Most frequent level per categorical column, the smallest on ties."""
    return modes_of(value_counts(unpivot(df, [], spec.categorical, "string"), ["feature"], "value"))


def modes_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def scales(df: DataFrame, spec: RoleSpec, fill: dict[str, float]) -> DataFrame:
    """Mean and population deviation of the imputed column; deviation 0 becomes 1."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in spec.numeric}
    wide = df.agg(
        *[F.avg(v).alias(f"{c}|mean") for c, v in value.items()],
        *[F.stddev_pop(v).alias(f"{c}|std") for c, v in value.items()],
        F.count(F.lit(1)).alias("n"),
    )
    std = {c: F.col(f"`{c}|std`") for c in spec.numeric}
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"`{c}|mean`").alias("mean"),
            F.when(std[c] == 0, 1.0).otherwise(std[c]).alias("std"),
            F.col("n").alias("rows"),
        )
        for c in spec.numeric
    ]
    return wide.select(F.inline(F.array(*rows)))


def levels(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Distinct levels per categorical column (long form)."""
    return (
        unpivot(df, [], spec.categorical, "string", "feature", "level")
        .where(F.col("level").isNotNull())
        .distinct()
    )


def _counted_levels(source: DataFrame, spec: RoleSpec) -> list[Row]:
    """Levels with their counts from one grouped pass, at most ``MAX_LEVELS`` a column.

    The encoder holds its levels on the driver and gives each a place in the vector; a column
    with more of them, such as free text or an id, is an error that names it.
    """
    counts = value_counts(unpivot(source, [], spec.categorical, "string"), ["feature"], "value")
    rows = counts.limit(MAX_LEVELS * len(spec.categorical) + 1).collect()
    sizes = Counter(r["feature"] for r in rows)
    if len(rows) > MAX_LEVELS * len(spec.categorical):
        # the rows fetched may be cut anywhere, so the sizes are counted where the data is
        sizes = {r["feature"]: r["count"] for r in counts.groupBy("feature").count().collect()}
    wide = [f"{c} ({sizes[c]})" for c in spec.categorical if sizes.get(c, 0) > MAX_LEVELS]
    if wide:
        raise ValueError(f"more than {MAX_LEVELS} levels in {', '.join(wide)}: no category for one-hot columns")
    return rows


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Preprocessor:
    """Fitted statistics with the partition and row count they came from."""

    spec: RoleSpec
    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    mode: dict[str, str]
    partition: str
    rows: int
    pipeline: PipelineModel = field(repr=False, compare=False)

    def level_lists(self) -> dict[str, list[str]]:
        indexers = (s for s in self.pipeline.stages if isinstance(s, StringIndexerModel))
        return {c: list(i.labels) for c, i in zip(self.spec.categorical, indexers, strict=True)}

    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.spec.numeric]
        return names + [f"cat__{c}_{v}" for c, vs in self.level_lists().items() for v in vs]

    def transform(self, df: DataFrame, *, vector_only: bool = True) -> DataFrame:
        """Append the feature vector; statistics that saw other partitions are refused."""
        if self.partition != "train":
            raise ValueError(f"statistics were fitted on {self.partition!r}, not on 'train'")
        missing = [c for c in self.spec.features if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns missing: {missing}")
        out = self.pipeline.transform(df)
        return out.select(*df.columns, FEATURES) if vector_only else out

    def onehot(self, df: DataFrame) -> DataFrame:
        """Wide 0/1 columns per level; an unknown level gives zeros in all of them."""
        cols: list[Column] = []
        for name, values in self.level_lists().items():
            filled = F.coalesce(F.col(name).cast("string"), F.lit(self.mode[name]))
            cols += [F.when(filled == v, 1.0).otherwise(0.0).alias(f"cat__{name}_{v}") for v in values]
        return df.select(self.spec.id_col, *cols)

    def scaled(self, df: DataFrame) -> DataFrame:
        cols = [
            ((F.coalesce(F.col(c).cast("double"), F.lit(self.median[c])) - self.mean[c]) / self.std[c]).alias(f"num__{c}")
            for c in self.spec.numeric
        ]
        return df.select(self.spec.id_col, *cols)


def fit_preprocessor(parted: DataFrame, spec: RoleSpec, partition: str = "train", by: str | None = "partition") -> Preprocessor:
    """Fit on one partition only; the filter is applied here, not by the caller."""
    source = parted.where(F.col(by) == partition) if by else parted
    median = {r["feature"]: r["median"] for r in medians(source, spec).collect()} if spec.numeric else {}
    fill = {c: median[c] if median.get(c) is not None else 0.0 for c in spec.numeric}
    mean, std, rows = {}, {}, 0
    if spec.numeric:
        for r in scales(source, spec, fill).collect():
            mean[r["feature"]], std[r["feature"]] = r["mean"], r["std"]
            rows = r["rows"]
    mode, found = {}, {c: [] for c in spec.categorical}
    if spec.categorical:
        counts: dict[str, list[tuple[int, str]]] = {c: [] for c in spec.categorical}
        for r in _counted_levels(source, spec):
            counts[r["feature"]].append((-r["n"], r["value"]))
        found = {c: sorted(v for _, v in pairs) for c, pairs in counts.items()}
        mode = {c: min(pairs)[1] for c, pairs in counts.items() if pairs}
    if not spec.numeric:
        rows = source.count()
    parts = [
        f"(coalesce(cast(`{c}` as double), {fill[c]!r}D) - {mean[c]!r}D) / {std[c]!r}D AS `num__{c}`" for c in spec.numeric
    ] + [f"coalesce(cast(`{c}` as string), {_text(mode[c])}) AS `imp__{c}`" for c in spec.categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    inputs = [f"num__{c}" for c in spec.numeric]
    if spec.categorical:
        # 'keep' gives unknown levels the last index, which dropLast turns into all zeros
        stages += [
            StringIndexerModel.from_labels(found[c], f"imp__{c}", f"idx__{c}", handleInvalid="keep")
            for c in spec.categorical
        ]
        stages.append(
            OneHotEncoder(
                inputCols=[f"idx__{c}" for c in spec.categorical],
                outputCols=[f"hot__{c}" for c in spec.categorical],
                dropLast=True,
            )
        )
        inputs += [f"hot__{c}" for c in spec.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    pipeline = Pipeline(stages=stages).fit(source)
    return Preprocessor(spec, fill, mean, std, mode, partition, rows, pipeline)


def validate_matrix(encoded: DataFrame, by: str = "partition", digits: int = 6) -> DataFrame:
    """Per partition: rows, vector width, non-finite cells, value range."""
    cells = vector_to_array(F.col(FEATURES))
    wide = encoded.select(by, cells.alias("v"))
    return wide.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size("v")).alias("min_width"),
        F.max(F.size("v")).alias("max_width"),
        F.count_if(F.exists("v", lambda x: F.isnan(x))).alias("nan_rows"),
        F.count_if(F.exists("v", lambda x: F.abs(x) == F.lit(float("inf")))).alias("inf_rows"),
        F.round(F.min(F.array_min("v")), digits).alias("min_value"),
        F.round(F.max(F.array_max("v")), digits).alias("max_value"),
    )


def readable(name: Column) -> Column:
    """Feature name without prefixes and underscores."""
    plain = F.regexp_replace(F.regexp_replace(name, "num__", ""), "cat__", "")
    return F.regexp_replace(plain, "_", " ")
