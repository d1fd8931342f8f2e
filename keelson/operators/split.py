"""Reproducible stratified split, folds and resampling.

Order is the digest of ``seed|id``.  A fit step finds, per class, the digest at
which a wanted rank is reached: a histogram of 65,536 digest prefixes bounds the
search to one bucket, and only that bucket is sorted.  Assigning rows afterwards
compares two values per row, with no shuffle and no window over the table, and
gives the same answer for a row wherever and whenever it is computed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.scalars import hex_digest
from keelson.roles import RoleSpec

PREFIX = 4  # hex digits of the bucket, hence at most 16**4 buckets per class
MAX_CLASSES = 2
PARTITIONS = ("train", "validation", "test")


@dataclass(frozen=True)
class Cut:
    digest: str
    key: str


@dataclass(frozen=True)
class HashOrder:
    """Class sizes and, per class, the cuts for the wanted ranks."""

    seed: str
    id_col: str
    label_col: str
    sizes: Mapping[str, int]
    cuts: Mapping[str, Sequence[Cut | None]]

    def position(self) -> Column:
        """Number of cuts of its class that lie before a row."""
        digest = hex_digest(self.seed, self.id_col)
        key = F.col(self.id_col).cast("string")
        out = F.lit(None).cast("int")
        for label, cuts in self.cuts.items():
            passed = F.lit(0)
            for cut in cuts:
                # no cut: the wanted rank is 0 (every row is past it)
                after = (
                    F.lit(True)
                    if cut is None
                    else (digest > cut.digest) | ((digest == cut.digest) & (key > cut.key))
                )
                passed = passed + after.cast("int")
            out = F.when(F.col(self.label_col) == label, passed).otherwise(out)
        return out


def fit_order(
    df: DataFrame, id_col: str, label: str, seed: str, ranks_of: Callable[[dict[str, int]], Mapping[str, Sequence[int]]]
) -> HashOrder:
    """Find the digest at each wanted rank; ``ranks_of`` maps class sizes to ranks.

    Two scans: the digest histogram, then a sort of the few buckets that hold a
    wanted rank (about 1/65,536 of a class each).
    """
    hashed = df.select(
        F.col(label).alias("label"), F.col(id_col).cast("string").alias("key"), hex_digest(seed, id_col).alias("digest")
    ).withColumn("bucket", F.substring("digest", 1, PREFIX))
    histogram = hashed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # the histogram has at most 65,536 rows per class; more classes than two are an error
    counts = histogram.limit(MAX_CLASSES * 16**PREFIX + 1).toPandas()
    sizes = {k: int(n) for k, n in counts.groupby("label", dropna=False)["n"].sum().items()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    wanted: dict[tuple[str, str], dict[int, int]] = {}
    cuts: dict[str, list[Cut | None]] = {}
    for name, places in ranks_of(sizes).items():
        mine = counts[counts["label"] == name].sort_values("bucket")
        total = mine["n"].to_numpy().cumsum()
        cuts[name] = [None] * len(places)
        for i, rank in enumerate(places):
            if rank <= 0:
                continue
            at = int(np.searchsorted(total, min(rank, int(total[-1]))))
            before = int(total[at - 1]) if at else 0
            wanted.setdefault((name, mine["bucket"].iloc[at]), {})[i] = min(rank, int(total[-1])) - before
    if wanted:
        keys = [F.lit(f"{n}|{b}") for n, b in wanted]
        row = Window.partitionBy("label", "bucket").orderBy("digest", "key")
        pairs = [(n, b, i, r) for (n, b), places in wanted.items() for i, r in places.items()]
        hit = F.lit(False)
        for name, bucket, _, rank in pairs:
            hit = hit | ((F.col("label") == name) & (F.col("bucket") == bucket) & (F.col("r") == rank))
        found = (
            hashed.where(F.concat_ws("|", "label", "bucket").isin(*keys))
            .withColumn("r", F.row_number().over(row))
            .where(hit)
            .collect()
        )
        by = {(x["label"], x["bucket"], x["r"]): Cut(x["digest"], x["key"]) for x in found}
        for name, bucket, i, rank in pairs:
            cuts[name][i] = by[(name, bucket, rank)]
    return HashOrder(seed, id_col, label, sizes, cuts)


def largest_remainder(total: int, sizes: Mapping[str, int]) -> dict[str, int]:
    """Share ``total`` over classes in proportion to their sizes, exactly."""
    everyone = sum(sizes.values())
    exact = {k: total * n / everyone for k, n in sizes.items()}
    share = {k: math.floor(v) for k, v in exact.items()}
    order = sorted(sizes, key=lambda k: (-(exact[k] - share[k]), k))
    for k in order[: total - sum(share.values())]:
        share[k] += 1
    return share


def fit_split(df: DataFrame, spec: RoleSpec, *, seed: int = 42, holdout: float = 0.30, test_share: float = 0.50) -> HashOrder:
    """Two-stage quotas: hold out ceil(n*holdout), of which ceil(h*test_share) is test."""
    if not (0 < holdout < 1 and 0 < test_share < 1):
        raise ValueError("split proportions must lie between 0 and 1")

    def ranks(sizes: dict[str, int]) -> dict[str, tuple[int, int]]:
        n = sum(sizes.values())
        train = largest_remainder(n - math.ceil(n * holdout), sizes)
        rest = {k: sizes[k] - train[k] for k in sizes}
        held = sum(rest.values())
        validation = largest_remainder(held - math.ceil(held * test_share), rest)
        return {k: (train[k], train[k] + validation[k]) for k in sizes}

    return fit_order(df, spec.id_col, spec.target_col, str(seed), ranks)


def assign_partition(df: DataFrame, order: HashOrder, name: str = "partition") -> DataFrame:
    """Add the partition name; a projection only."""
    place = order.position()
    return df.withColumn(
        name, F.when(place == 0, PARTITIONS[0]).when(place == 1, PARTITIONS[1]).otherwise(PARTITIONS[2])
    )


def stratified_split(df: DataFrame, spec: RoleSpec, **options) -> DataFrame:
    return assign_partition(df, fit_split(df, spec, **options))


def fold_edges(n: int, k: int) -> list[int]:
    """Last rank of each fold but the last; the first ``n % k`` folds get one row more."""
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [int(x) for x in np.cumsum(sizes)[:-1]]


def assign_folds(df: DataFrame, spec: RoleSpec, k: int = 5, seed: str = "cv", name: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1 of equal size within each class."""
    order = fit_order(
        df, spec.id_col, spec.target_col, seed, lambda sizes: {c: fold_edges(n, k) for c, n in sizes.items()}
    )
    return df.withColumn(name, order.position())


def undersample(df: DataFrame, spec: RoleSpec, seed: int = 42) -> DataFrame:
    """Keep the minority class and as many majority rows, the first in hash order."""
    order = fit_order(
        df, spec.id_col, spec.target_col, str(seed), lambda sizes: {c: (min(sizes.values()),) for c in sizes}
    )
    return df.where(order.position() == 0)


def split_summary(df: DataFrame, spec: RoleSpec, by: str = "partition", digits: int = 2) -> DataFrame:
    target = F.col(spec.target_col)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(target == spec.negative).alias("label_no"),
        F.count_if(target == spec.positive).alias("label_yes"),
        F.round(100 * F.count_if(target == spec.positive) / F.count(F.lit(1)), digits).alias("yes_pct"),
    )


def overlaps(df: DataFrame, key: str, by: str = "partition") -> DataFrame:
    """Keys and rows that occur in two partitions; flags per key, no lists."""
    per_key = df.groupBy(key).agg(
        *[F.max((F.col(by) == p).cast("int")).alias(p) for p in PARTITIONS],
        F.count(F.lit(1)).alias("rows"),
    )
    pairs = (("train", "validation"), ("train", "test"), ("validation", "test"))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("rows").alias("rows"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs],
    )


def validate_split(df: DataFrame, spec: RoleSpec, by: str = "partition") -> DataFrame:
    """Sizes, shares, overlaps and label spread in one row."""
    total = F.sum("n")
    wide = split_summary(df, spec, by, 6).agg(
        total.alias("total_rows"),
        *[F.sum(F.when(F.col(by) == p, F.col("n")).otherwise(0)).alias(f"{p}_rows") for p in PARTITIONS],
        F.round(F.max("yes_pct") - F.min("yes_pct"), 6).alias("yes_pct_spread"),
        F.min("n").alias("_least"),
    )
    shared = overlaps(df, spec.id_col, by).select(
        (F.col("train_validation") + F.col("train_test") + F.col("validation_test")).alias("o")
    )
    out = wide.withColumn("id_overlap", shared.scalar())
    for p in PARTITIONS:
        out = out.withColumn(f"{p}_pct", F.round(100 * F.col(f"{p}_rows") / F.col("total_rows"), 6))
    bound = F.greatest(F.lit(0.10), F.lit(100.0) / F.col("_least"))
    return out.withColumn("passed", (F.col("id_overlap") == 0) & (F.col("yes_pct_spread") <= bound)).drop("_least")


def positive_weight(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """negatives, positives and their ratio (null ratio when there are no positives)."""
    target = F.col(spec.target_col)
    counts = df.agg(
        F.count_if(target == spec.negative).alias("negatives"), F.count_if(target == spec.positive).alias("positives")
    )
    return counts.withColumn("scale_pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def balanced_weights(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """n / (classes * class size) per class."""
    per_class = df.groupBy(spec.target_col).agg(F.count(F.lit(1)).alias("n"))
    totals = per_class.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return per_class.withColumn("weight", totals.getField("n") / (totals.getField("k") * F.col("n")))
