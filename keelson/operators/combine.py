"""Joins and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_manifest(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inner equi-join on the key; Spark picks broadcast or sort-merge from sizes."""
    return df.join(manifest, key)


def keep_partitions(df: DataFrame, manifest: DataFrame, key: str, names: list[str], by: str = "partition") -> DataFrame:
    return df.join(manifest.where(F.col(by).isin(*names)), key, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key."""
    return existing.join(new, key, "left_anti").unionByName(new)


def nearest(df: DataFrame, value: str, target: float, key: str) -> DataFrame:
    """The row whose value is closest to ``target`` (smallest key on ties)."""
    distance = F.abs(F.col(value) - F.lit(float(target)))
    return df.agg(F.min_by(F.struct(*df.columns), F.struct(distance, F.col(key))).alias("r")).select("r.*")
