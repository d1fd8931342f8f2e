"""CSV and JSON readers with declared schemas, and the sinks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.scalars import is_blank
from keelson.operators.compat import rename_headers
from keelson.roles import CUSTOMER, RoleSpec


def text_schema(names: list[str] | tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def raw_schema(spec: RoleSpec = CUSTOMER) -> T.StructType:
    """Types of the raw customer file; the charge column stays text until cleaned."""
    kinds = {
        **{c: T.DoubleType() for c in spec.numeric},
        **{c: T.IntegerType() for c in spec.integral},
        spec.charge_col: T.StringType(),
    }
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in spec.columns])


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw table with an explicit schema; blank cells stay blank text, not null."""
    return (
        spark.read.schema(schema or raw_schema())
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_upload_csv(spark: SparkSession, path: str, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """An uploaded CSV file or a folder of like files: all text, headers normalised."""
    if PurePosixPath(path).suffix not in (".csv", ""):
        raise ValueError("upload must be a CSV file")
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rename_headers(raw, spec)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, key: str, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """Customer records; a missing key falls back to the id, then to a content hash."""
    df = spark.read.schema(schema).json(path)
    named = F.col(key) if key in df.columns else F.lit(None).cast("string")
    own = F.when(~is_blank(spec.id_col), F.col(spec.id_col))
    made = F.concat(F.lit("BATCH-"), F.hex(F.xxhash64(*df.columns)))
    return df.withColumn("primary_key", F.coalesce(named.cast("string"), own, made))


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def pick_report(report: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text column contains ``part`` in any case."""
    return report.where(F.lower(column).contains(part.lower()))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with header; white-space cells are kept as they are."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, **keep).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per line, in column order."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)
    return path


def append_log(df: DataFrame, path: str | None) -> str | None:
    """Append stamped JSON lines; does nothing when no path is configured."""
    if path is None:
        return None
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp")
    df.select(F.to_json(F.struct(stamp, *df.columns)).alias("value")).write.mode("append").text(path)
    return path
