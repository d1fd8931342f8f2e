"""Exact order statistics without a single-task sort.

Rows are first counted per distinct value (partial aggregation makes copies
cheap), then range-partitioned on the value.  Sampling balances the ranges for
any distribution, and since values are distinct within a group no range can be
flooded by copies of one value.  The ranges are checkpointed once, so that the
small per-range totals and the rows they are added to come from the same
partitioning even when executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import durable


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    prefix: str = "cum_",
) -> DataFrame:
    """Add inclusive running sums of ``measures`` along ``order`` within ``keys``.

    ``df`` must hold one row per (keys, order); the offsets table has at most
    (number of ranges) x (number of key values met in each range) rows.  The
    number of ranges is left to the session, so adaptive execution merges
    neighbouring ranges of small inputs.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranged = durable(
        df.repartitionByRange(*[F.col(k) for k in keys], direction).withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            "_range",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        )
    )
    within = (
        Window.partitionBy(*keys, "_range")
        .orderBy(direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.join(offsets, [*keys, "_range"]).select(
        *df.columns,
        *[(F.sum(m).over(within) + F.col(f"_before_{m}")).alias(f"{prefix}{m}") for m in measures],
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """One row per key: the linearly interpolated quantiles, plus the row count ``n``."""
    counts = value_counts(df, keys, value)
    return quantiles_of_counts(running_totals(counts, keys, value, ["n"]), keys, value, wanted)


def quantiles_of_counts(
    ranked: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """As :func:`exact_quantiles`, from rows that already carry ``cum_n``."""
    size = ranked.groupBy(*keys).agg(F.max("cum_n").alias("_size"))
    joined = (
        ranked.join(size, list(keys)) if keys else ranked.withColumn("_size", size.scalar())
    )
    last = F.col("_size") - 1
    picks: list[Column] = [F.max("_size").alias("n")]
    for name, q in wanted.items():
        place = last * F.lit(float(q))
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(place), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(place), F.col(value))).alias(f"_hi_{name}"))
    picked = joined.groupBy(*keys).agg(*picks)
    answers = []
    for name, q in wanted.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        answers.append((low + (high - low) * (place - F.floor(place))).cast("double").alias(name))
    return picked.select(*keys, *answers, "n")


def unpivot(df: DataFrame, ids: Sequence[str], names: Sequence[str], kind: str, label: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long with one scan; every column is cast to ``kind`` first."""
    cast = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in names])
    return cast.unpivot(list(ids), list(names), label, value)
