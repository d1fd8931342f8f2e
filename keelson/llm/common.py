"""Session settings, readers and small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import ship_package, shared_dir
from keelson.sources.tables import table

#: Rows of one Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return table(spark, folder, name)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


#: Rows of two or three numbers that may be broadcast: 5 MB at 24 bytes each.
BROADCAST_ROWS = 200_000
#: Rows of a small table that one task writes at most.
SMALL_PART_ROWS = 250_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has so few (narrow) rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder as Parquet and read back: columnar, prunable, survives lost executors.

    ``rows``, where the number is known to be bounded by it, keeps small tables in few tasks and files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keelson-{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // SMALL_PART_ROWS))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
