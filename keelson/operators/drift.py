"""Drift of a batch against a baseline, from aggregates only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.ranked import quantiles_of_counts, running_totals, unpivot
from keelson.roles import RoleSpec

# fixed values: bins, floor and alert limits
PSI_BINS = 10
PSI_FLOOR = 1e-6
PSI_ALERT = 0.2
SHARE_ALERT = 0.15


def _edge_names(bins: int) -> dict[str, float]:
    return {f"e{i:02d}": i / bins for i in range(bins + 1)}


def paired_counts(baseline: DataFrame, batch: DataFrame, names: Sequence[str], kind: str = "double") -> DataFrame:
    """(feature, value, base_n, batch_n): both tables counted per distinct value."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    old = unpivot(baseline, [], names, kind).select("feature", "value", one.alias("b"), none.alias("a"))
    new = unpivot(batch, [], names, kind).select("feature", "value", none.alias("b"), one.alias("a"))
    return (
        old.unionByName(new)
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("b").alias("base_n"), F.sum("a").alias("batch_n"))
    )


def _packed_edges(quantiles: DataFrame, bins: int) -> DataFrame:
    names = list(_edge_names(bins))
    return quantiles.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def baseline_stats(df: DataFrame, spec: RoleSpec, digits: int = 4, bins: int = PSI_BINS) -> DataFrame:
    """Long statistics table (kind, feature, name, value): no raw values are kept."""
    counts = unpivot(df, [], spec.numeric, "double").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, ["feature"], "value", ["n"])
    edges = quantiles_of_counts(ranked, ["feature"], "value", _edge_names(bins)).drop("n")
    means = ranked.groupBy("feature").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    wide = edges.join(means, "feature").withColumn("median", F.col("e05"))
    numeric = wide.unpivot(["feature"], ["mean", "median", *_edge_names(bins)], "name", "value").withColumn(
        "kind", F.lit("numeric")
    )
    shares = category_shares(df, spec.categorical).select(
        "feature", F.col("level").alias("name"), F.col("share").alias("value"), F.lit("category").alias("kind")
    )
    out = numeric.select("kind", "feature", "name", "value").unionByName(shares.select("kind", "feature", "name", "value"))
    return out.withColumn("value", F.round("value", digits))


def category_shares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, level, n, share); shares are taken over non-null cells."""
    counts = (
        unpivot(df, [], names, "string", "feature", "level")
        .where(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("all_n"))
    # one total per categorical column
    return counts.join(F.broadcast(totals), "feature").select(
        "feature", "level", "n", (F.col("n") / F.col("all_n")).alias("share")
    )


def exact_psi(baseline: DataFrame, batch: DataFrame, names: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per numeric feature.

    Bins are half open with a closed last one; batch values outside the baseline
    range are left out of the index and reported as ``out_of_range_share``.
    """
    counts = paired_counts(baseline, batch, names)
    known = counts.where("base_n > 0").select("feature", "value", F.col("base_n").alias("n"))
    ranked = running_totals(known, ["feature"], "value", ["n"])
    edges = _packed_edges(quantiles_of_counts(ranked, ["feature"], "value", _edge_names(bins)), bins)
    # one edge list per numeric feature
    placed = counts.join(F.broadcast(edges), "feature").withColumn("bin", _bin(F.col("value"), F.col("edges")))
    return _index(placed.groupBy("feature", "bin").agg(F.sum("base_n").alias("b"), F.sum("batch_n").alias("a"), F.first(F.size("edges")).alias("n_edges")))


def _bin(value: Column, edges: Column) -> Column:
    """Number of the bin from 0, -1 outside the edges; the last bin is closed."""
    index = F.when(value == F.element_at(edges, -1), F.size(edges) - 2).otherwise(F.size(F.filter(edges, lambda e: e <= value)) - 1)
    return F.when((value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1)), index).otherwise(-1)


def _index(binned: DataFrame) -> DataFrame:
    """The stability index of (feature, bin, b, a, n_edges), baseline and batch counts per bin."""
    feature = Window.partitionBy("feature")  # at most bins + 1 rows
    in_range = F.col("bin") >= 0
    base_all = F.sum(F.when(in_range, F.col("b"))).over(feature)
    batch_all = F.sum(F.when(in_range, F.col("a"))).over(feature)
    floor = F.lit(PSI_FLOOR)
    shares = binned.withColumns(
        {
            "bs": F.greatest(F.col("b") / F.greatest(base_all, F.lit(1)), floor),
            "as": F.greatest(F.col("a") / F.greatest(batch_all, F.lit(1)), floor),
        }
    )
    used = in_range & ((F.col("b") > 0) | (F.col("a") > 0))
    term = F.when(used, (F.col("as") - F.col("bs")) * F.log(F.col("as") / F.col("bs"))).otherwise(0.0)
    return shares.groupBy("feature").agg(
        F.when(F.max("n_edges") < 3, 0.0).otherwise(F.greatest(F.sum(term), F.lit(0.0))).alias("psi"),
        F.coalesce(F.try_divide(F.sum(F.when(~in_range, F.col("a")).otherwise(0)), F.sum("a")), F.lit(0.0)).alias("out_of_range_share"),
    )


@dataclass(frozen=True)
class Baseline:
    """What later batches are held against, written once: no row of the baseline table is read again.

    ``numeric`` has (version, feature, edges, counts per bin, mean, n), ``categories`` (version,
    feature, level, n, share): as many rows as there are features and levels.
    """

    numeric: DataFrame
    categories: DataFrame

    @classmethod
    def of(cls, df: DataFrame, spec: RoleSpec, version: str, bins: int = PSI_BINS) -> Baseline:
        counts = unpivot(df, [], spec.numeric, "double").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        ranked = running_totals(counts, ["feature"], "value", ["n"])
        edges = _packed_edges(quantiles_of_counts(ranked, ["feature"], "value", _edge_names(bins)), bins)
        # one edge list per numeric feature
        placed = ranked.join(F.broadcast(edges), "feature").withColumn("bin", _bin(F.col("value"), F.col("edges")))
        filled = placed.groupBy("feature", "edges", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("total"))
        by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # at most one entry per bin
        packed = filled.groupBy("feature", "edges").agg(by_bin.alias("by_bin"), (F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
        places = F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))
        per_bin = F.transform(places, lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0).cast("long")))
        label = F.lit(version).alias("version")
        numeric = packed.select(label, "feature", "edges", per_bin.alias("counts"), "mean", "n")
        return cls(numeric, category_shares(df, spec.categorical).select(label, "feature", "level", "n", "share"))

    def save(self, path: str) -> Baseline:
        self.numeric.coalesce(1).write.parquet(f"{path}/numeric")
        self.categories.coalesce(1).write.parquet(f"{path}/categories")
        return self.load(self.numeric.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Baseline:
        return cls(spark.read.parquet(f"{path}/numeric"), spark.read.parquet(f"{path}/categories"))

    def psi(self, batch: DataFrame, names: Sequence[str]) -> DataFrame:
        """As :func:`exact_psi`; reads the batch only."""
        edges = self.numeric.select("feature", "edges")
        values = unpivot(batch, [], names, "double").where("value IS NOT NULL")
        placed = values.join(F.broadcast(edges), "feature").withColumn("bin", _bin(F.col("value"), F.col("edges")))
        new = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("a"))
        old = self.numeric.where(F.col("feature").isin(*names)).select("feature", F.posexplode("counts").alias("bin", "b"))
        sizes = self.numeric.select("feature", F.size("edges").alias("n_edges"))
        none = F.lit(0).cast("long")
        both = old.join(new, ["feature", "bin"], "full").join(F.broadcast(sizes), "feature")
        return _index(both.select("feature", "bin", F.coalesce("b", none).alias("b"), F.coalesce("a", none).alias("a"), "n_edges"))


def psi(baseline: DataFrame, batch: DataFrame, names: Sequence[str], bins: int = PSI_BINS, digits: int = 4) -> DataFrame:
    """:func:`exact_psi`, rounded."""
    return exact_psi(baseline, batch, names, bins).select(
        "feature", F.round("psi", digits).alias("psi"), F.round("out_of_range_share", digits).alias("out_of_range_share")
    )


def _means(df: DataFrame, names: Sequence[str], alias: str, digits: int) -> DataFrame:
    wide = df.agg(*[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in names])
    return wide.unpivot([], list(names), "feature", alias)


def numeric_drift(baseline: DataFrame | Baseline, batch: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """Index, means and alert per number; ``baseline`` is a table or what :class:`Baseline` stored of it."""
    if isinstance(baseline, Baseline):
        exact, means = baseline.psi(batch, names), baseline.numeric.select("feature", F.round("mean", digits).alias("baseline_mean"))
    else:
        exact, means = exact_psi(baseline, batch, names), _means(baseline, names, "baseline_mean", digits)
    # the alert is taken before rounding
    index = exact.select(
        "feature", F.round("psi", digits).alias("psi"), F.round("out_of_range_share", digits).alias("out_of_range_share"), (F.col("psi") >= PSI_ALERT).alias("alert")
    )
    return (
        index.join(means, "feature")
        .join(_means(batch, names, "batch_mean", digits), "feature")
        .select("feature", "psi", "out_of_range_share", "baseline_mean", "batch_mean", "alert")
    )


def categorical_drift(baseline: DataFrame | Baseline, batch: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """Largest share shift over the baseline levels; ties go to the commoner level.

    Baseline shares are rounded to 4 digits as they are in a stored baseline.
    """
    known = baseline.categories.where(F.col("feature").isin(*names)) if isinstance(baseline, Baseline) else category_shares(baseline, names)
    old = known.select("feature", "level", "n", F.round("share", 4).alias("base_share"))
    new = category_shares(batch, names).select("feature", "level", F.col("share").alias("batch_share"))
    joined = old.join(new, ["feature", "level"], "full").withColumn(
        "shift", F.abs(F.coalesce("batch_share", F.lit(0.0)) - F.col("base_share"))
    )
    unseen = F.sum(F.when(F.col("base_share").isNull(), F.col("batch_share")).otherwise(0.0))
    order = F.struct(-F.col("shift"), -F.col("n"), F.col("level"))
    worst = F.min_by("level", F.when(F.col("shift").isNotNull(), order))
    return (
        joined.groupBy("feature")
        .agg(
            F.round(F.coalesce(F.max("shift"), F.lit(0.0)), digits).alias("max_share_shift"),
            F.when(F.max("shift") > 0, worst).alias("worst_category"),
            F.round(unseen, digits).alias("unseen_share"),
            (F.coalesce(F.max("shift"), F.lit(0.0)) >= SHARE_ALERT).alias("alert"),
        )
    )


def drift_report(baseline: DataFrame | Baseline, batch: DataFrame, spec: RoleSpec, source: str, digits: int = 4) -> DataFrame:
    """(source, kind, feature, metric value, alert) for every feature of the batch."""
    numeric = numeric_drift(baseline, batch, spec.numeric, digits).select(
        F.lit("numeric").alias("kind"), "feature", F.col("psi").alias("value"), "alert"
    )
    category = categorical_drift(baseline, batch, spec.categorical, digits).select(
        F.lit("category").alias("kind"), "feature", F.col("max_share_shift").alias("value"), "alert"
    )
    text = F.when(
        F.col("alert"),
        F.concat(
            F.when(F.col("kind") == "numeric", "Numeric drift on ").otherwise("Categorical shift on "), F.col("feature")
        ),
    )
    return numeric.unionByName(category).withColumns({"alert_text": text, "source": F.lit(source)})


def drift_status(report: DataFrame) -> DataFrame:
    """One row: ok or alert, the number of alerts and their texts (one per feature at most)."""
    texts = F.array_join(F.array_sort(F.collect_list("alert_text")), "; ")
    return report.agg(
        F.when(F.coalesce(F.bool_or("alert"), F.lit(False)), "alert").otherwise("ok").alias("status"),
        F.count("alert_text").alias("alerts"),
        texts.alias("alert_texts"),
    )


def ks(baseline: DataFrame, batch: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per numeric feature."""
    ranked = running_totals(paired_counts(baseline, batch, names), ["feature"], "value", ["base_n", "batch_n"])
    totals = ranked.groupBy("feature").agg(F.max("cum_base_n").alias("B"), F.max("cum_batch_n").alias("A"))
    gap = F.abs(F.col("cum_base_n") / F.col("B") - F.col("cum_batch_n") / F.col("A"))
    # one total per numeric feature
    return ranked.join(F.broadcast(totals), "feature").groupBy("feature").agg(F.round(F.max(gap), digits).alias("ks"))

