"""Profiles as mergeable sketches: a small row per part and column, kept as a table, combined without a rescan.

A part is a file, a day or whatever a table arrives in. Its rows are read once; after that any choice of parts is
profiled from the stored rows alone, whose size depends on the number of parts and columns only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTINCT_LG = 14  # a distinct sketch has 2 ** 14 registers, at most 16 KB
QUANTILE_K = 800  # a quantile sketch keeps some 3 * 800 values
#: Three standard errors of a distinct count, as a share of it.
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(2**DISTINCT_LG)
#: Error of a quantile's rank, as a share of the values, at 99 % confidence.
RANK_ERROR = 2.296 / QUANTILE_K**0.9021


def _value(df: DataFrame, name: str) -> Column | None:
    """A numeric column as double without NaN, which is no value; other columns have no quantiles."""
    if not isinstance(df.schema[name].dataType, T.NumericType):
        return None
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def build(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by, feature, rows, present, low, high, distinct_sketch, quantile_sketch): one row per part and column.

    One pass; every aggregate is partial before the shuffle, so a hot part costs a row per task. A column of nulls
    has ``present`` 0 and an empty distinct sketch; ``low``, ``high`` and ``quantile_sketch`` are null for columns that
    are no numbers or hold no value. An empty table has no rows.
    """
    names = [c for c in (columns or df.columns) if c not in by]
    aggregates, structs = [F.count(F.lit(1)).alias("_rows")], []
    for i, name in enumerate(names):
        value = _value(df, name)
        aggregates += [F.count(f"`{name}`").alias(f"_n{i}"), F.hll_sketch_agg(F.col(f"`{name}`").cast("string"), DISTINCT_LG).alias(f"_d{i}")]
        low = high = F.lit(None).cast("double")
        quantiles = F.lit(None).cast("binary")
        if value is not None:
            aggregates += [F.min(value).alias(f"_l{i}"), F.max(value).alias(f"_h{i}"), F.kll_sketch_agg_double(value, QUANTILE_K).alias(f"_q{i}")]
            low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
            quantiles = F.when(low.isNotNull(), F.col(f"_q{i}"))
        structs.append(
            F.struct(
                F.lit(name).alias("feature"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("present"), low.alias("low"), high.alias("high"),
                F.col(f"_d{i}").alias("distinct_sketch"), quantiles.alias("quantile_sketch"),
            )
        )
    return df.groupBy(*by).agg(*aggregates).where("_rows > 0").select(*by, F.inline(F.array(*structs)))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all parts together (or per ``by``), in the form that ``build`` gives."""
    return sketches.groupBy(*by, "feature").agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct_sketch", False).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", QUANTILE_K).alias("quantile_sketch"),
    ).withColumn("quantile_sketch", F.when(F.col("low").isNotNull(), F.col("quantile_sketch")))


def read(sketches: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, feature, rows, present, low, high, unique, q25, ...): what the sketches say.

    ``unique`` is within DISTINCT_ERROR, the rank of a quantile within RANK_ERROR; the rest is exact.
    """
    found = [
        F.when(F.col("quantile_sketch").isNotNull(), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))).alias(f"q{round(100 * q)}")
        for q in quantiles
    ]
    return sketches.select(*by, "feature", "rows", "present", "low", "high", F.hll_sketch_estimate("distinct_sketch").alias("unique"), *found)
