"""Readers for the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def instant(df: DataFrame, column: str, text: str) -> Column:
    """Literal of the column's own timestamp type, so the comparison reaches the scan."""
    kind = df.schema[column].dataType.typeName()
    return F.lit(text).cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp")
