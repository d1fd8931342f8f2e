"""Streaming jobs: score events into a log, and count the log by day.

File sources with a declared schema, the ``availableNow`` trigger, and a
checkpoint below the shared folder; a stopped run goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.functions.scalars import decision_label
from keelson.operators import cleaning, monitor
from keelson.operators.models import Bundle
from keelson.plans import views
from keelson.roles import RoleSpec
from keelson.session import scratch_path, ship_package
from keelson.sources.files import write_table

WATERMARK = "1 hour"  # fixed value
#: Files of one micro-batch: bounds its size however much has arrived.
FILES_PER_TRIGGER = 1000
LOG_SCHEMA = "event_id long, ts timestamp, kind string, count int, p double, y int"


def run_available(writer, out: str, checkpoint: str) -> None:
    """Process what has arrived, then stop."""
    running: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    running.awaitTermination()


def features_hash(names: list[str]) -> Column:
    return F.xxhash64(*names)


def fresh(stream: DataFrame, key: str) -> DataFrame:
    """Rows stamped with ``logged_at``; a stream drops repeated keys inside the watermark.

    A replayed upload is logged once, and the state stays bounded.
    """
    stamped = stream.withColumn("logged_at", F.current_timestamp()) if "logged_at" not in stream.columns else stream
    return stamped.withWatermark("logged_at", WATERMARK).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stamped


def _entries(scored: DataFrame, key: str, features: list[str], probability: str, threshold: float, version: str) -> DataFrame:
    return scored.select(
        "logged_at",
        key,
        features_hash(features).alias("features_hash"),
        F.col(probability).alias("probability"),
        F.lit(float(threshold)).alias("threshold"),
        decision_label(probability, threshold).alias("decision"),
        F.lit(version).alias("model_version"),
    )


def score_log(stream: DataFrame, key: str, features: list[str], probability: str, threshold: float, version: str) -> DataFrame:
    """One log entry per scored row: time, key, feature hash, probability, decision, version."""
    return _entries(fresh(stream, key), key, features, probability, threshold, version)


def model_log(raw: DataFrame, spec: RoleSpec, bundle: Bundle, version: str) -> DataFrame:
    """Log entries of raw rows that ``bundle`` scores where they arrive, in a stream or a batch.

    Charges are cleaned as in a batch; what cannot be read as a number is null and gets the fitted
    median. Repeated keys go before they are scored. A null key is one key like any other.
    """
    scored = bundle.score(cleaning.clean_charges(fresh(raw, spec.id_col), spec), "probability")
    return _entries(scored, spec.id_col, list(spec.features), "probability", bundle.threshold, version)


def stream_model_log(spark: SparkSession, arriving: str, spec: RoleSpec, bundle: Bundle, schema, out: str, version: str = "bundle", files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Score the raw files in ``arriving`` that no earlier run on ``out`` has read; returns the whole log."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arriving)
    log = model_log(stream, spec, bundle, version)
    run_available(log.writeStream.format("parquet").outputMode("append"), out, f"{out}-state")
    return spark.read.schema(log.schema).parquet(out)


def daily(log: DataFrame) -> DataFrame:
    """Requests and rows per day and kind; counts of parts of a log may be summed."""
    return (
        log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind")
        .agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows"))
    )


def stream_scores(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    """Score arriving customer files; returns the log that the stream wrote."""
    arriving = scratch_path(spark, "arriving")
    scored = views.scored(spark, folder)
    write_table(scored, arriving)
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(arriving)
    names = [c for c in scored.columns if c not in ("customerID", "Churn", "p")]
    log = score_log(stream, "customerID", names, "p", threshold, f"scored|threshold={threshold}")
    out = scratch_path(spark, "score-log")
    run_available(log.writeStream.format("parquet").outputMode("append"), out, f"{out}-state")
    return spark.read.schema(log.schema).parquet(out)


def count_stream(stream: DataFrame, out: str) -> DataFrame:
    """Counters of all that a log stream brings, whatever order its days arrive in.

    Every micro-batch writes its own counts (its folder is overwritten when it is replayed), and
    reading adds them up. No state is kept between batches, so nothing is ever too late.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        daily(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    running = (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    spark = stream.sparkSession
    parts = spark.read.schema("day string, kind string, requests long, rows long").option("basePath", out).parquet(out)
    return parts.groupBy("day", "kind").agg(F.sum("requests").alias("requests"), F.sum("rows").alias("rows"))


def stream_daily_counters(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """The prediction log, written to a folder and counted from there as a stream."""
    arriving = scratch_path(spark, "log")
    log = views.prediction_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    write_table(log, arriving)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arriving)
    return count_stream(stream, scratch_path(spark, "counters"))


# ------------------------------------------------------------------ recent batches as state

#: Keys of the counters' state; a log of any size is spread over so many groups.
STATE_BUCKETS = 64
_RING = "at array<long>, id array<long>, size array<long>"
_TOTALS = "predictions long, batches long, errors long, last long"
_NEVER = -(2**63)  # stands for a missing time or id: before all others


def _newest(entries: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return sorted(entries, reverse=True)[: monitor.RECENT_BATCHES]


def _advance(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a bucket's new entries to its totals and to its ring of the newest batches."""
    predictions, batches, errors, last, at, ids, sizes = state.get if state.exists else (0, 0, 0, _NEVER, [], [], [])
    ring = list(zip(at, ids, sizes, strict=True))
    for frame in frames:
        predictions += int(frame["scored"].sum())
        errors += int(frame["failed"].sum())
        used = frame[frame["scored"] > 0]
        if len(used):
            last = max(last, int(used["at"].max()))
        rows = used[used["batch"]]
        batches += len(rows)
        ring = _newest(ring + list(zip(rows["at"].tolist(), rows["id"].tolist(), rows["scored"].tolist(), strict=True)))
    at, ids, sizes = ([int(r[i]) for r in ring] for i in range(3))
    state.update((predictions, batches, errors, last, at, ids, sizes))
    yield pd.DataFrame({
        "bucket": [key[0]], "predictions": [predictions], "batches": [batches], "errors": [errors], "last": [last],
        "at": [at], "id": [ids], "size": [sizes],
    })


def recent_counters(stream: DataFrame, out: str) -> DataFrame:
    """``monitor.service_counters`` of all that a log stream has brought, in whatever order it came.

    Per bucket of event ids the state holds four totals and a ring of the newest batches by (ts, event_id),
    which no later entry can need more of; the newest of all buckets' rings are the newest of the log. So the
    state is bounded however long the log is, and a late row takes the place that its time gives it.
    Every micro-batch writes the buckets it changed to a folder of its own, which a replay overwrites.
    """
    spark = stream.sparkSession
    ship_package(spark)
    scored = F.coalesce((F.col("kind") != "error") & (F.col("count") > 0), F.lit(False))
    never = F.lit(_NEVER).cast("long")
    entries = stream.select(
        F.pmod(F.xxhash64("event_id", "ts"), F.lit(STATE_BUCKETS)).alias("bucket"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), never).alias("at"),
        F.coalesce(F.col("event_id").cast("long"), never).alias("id"),
        F.when(scored, F.col("count")).otherwise(0).cast("long").alias("scored"),
        F.coalesce(F.col("kind") == "batch", F.lit(False)).alias("batch"),
        F.coalesce(F.col("kind") == "error", F.lit(False)).alias("failed"),
    )
    schema = f"bucket long, {_TOTALS}, {_RING}"
    states = entries.groupBy("bucket").applyInPandasWithState(_advance, schema, f"{_TOTALS}, {_RING}", "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    running = (
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    parts = spark.read.schema(f"{schema}, epoch long").option("basePath", out).parquet(out)
    names = [c for c in parts.columns if c != "epoch"]
    newest = parts.groupBy("bucket").agg(F.max_by(F.struct(*names), "epoch").alias("s")).select("s.*")
    recent = (
        newest.select(F.inline(F.arrays_zip("at", "id", "size")))
        .orderBy(F.desc("at"), F.desc("id"))
        .limit(monitor.RECENT_BATCHES)
        .agg(F.round(F.avg("size"), 2).alias("m"))
    )
    return newest.agg(
        F.coalesce(F.sum("predictions"), F.lit(0)).alias("predictions_total"),
        F.coalesce(F.sum("batches"), F.lit(0)).alias("batch_requests_total"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors_total"),
        F.timestamp_micros(F.max(F.when(F.col("last") != never, F.col("last")))).cast("timestamp_ntz").alias("last_prediction_at"),
    ).withColumn("avg_recent_batch_size", recent.scalar())


def stream_recent_counters(spark: SparkSession, folder: str, files: int = 8, files_per_trigger: int = 3) -> DataFrame:
    """The prediction log in files of mixed days, counted as a stream of several micro-batches."""
    arriving = scratch_path(spark, "mixed-log")
    log = views.prediction_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    write_table(log.repartition(files, F.xxhash64("event_id")), arriving)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(arriving)
    return recent_counters(stream, scratch_path(spark, "recent"))


def log_source(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines prediction log as a stream."""
    return spark.readStream.schema(LOG_SCHEMA).json(path)

