"""Proportional stratified interleaving: every shard holds the sources in the corpus's mixture.

Rows of a source get a seeded random rank; rank over size of the source is a fraction in
(0, 1), and the order of all fractions deals the sources proportionally. Cutting that order
into equal counts gives the shards. Neither step sorts a source or the corpus in one task:
ranks come from counts per bucket of the (uniform) sort value plus a rank inside the bucket.
DataFrame functions only; texts are read once, for their size and checksum, and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import text_bytes

#: Rows that one bucket should hold about; bounds what a task sorts.
BUCKET_ROWS = 4_000
#: Buckets at most; beyond, a bucket holds more rows.
MOST_BUCKETS = 65_536


def _offset_ranks(rows: DataFrame, group: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """1-based rank by (bucket, order) inside ``group``: counts before the bucket plus the rank inside it."""
    keys = [*group, bucket]
    counts = rows.groupBy(keys).agg(F.count("*").alias("_here"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*group)
    places = counts.select(
        *keys, F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"), F.sum("_here").over(total).alias("_total")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.withColumn("_inside", inside)
    return ranked.join(places, keys).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def interleave(
    docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``shard``, ``slot``.

    Row counts of shards differ by one at most; inside a shard ``slot`` runs from 0. A null
    text has size 16 and the checksum of no bytes; a null source is a source of its own, a
    null id is a value like any other. Repeated rows stay separate rows: equal ones are told
    apart by nothing and take neighbouring places. An empty table gives an empty result; other
    columns are not read.
    """
    n_rows = docs.count()
    buckets = min(max(1, -(-n_rows // BUCKET_ROWS)), MOST_BUCKETS)
    text = text_bytes(text_col)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_source"),
        digest.alias("_digest"),
        # four hex digits of the digest are uniform over 65,536 values
        F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * buckets / 65_536).alias("_bucket"),
    )
    ties = [F.col("_id"), F.col("size"), F.col("text_crc32")]
    ranked = _offset_ranks(rows, ["_source"], "_bucket", [F.col("_digest"), *ties], "_rank")
    # (2 rank - 1) / (2 total): the middle of the row's share of its source
    dealt = ranked.withColumn("_fraction", (2 * F.col("_rank") - 1) / (2 * F.col("_total"))).drop("_total", "_bucket")
    dealt = dealt.withColumn("_bucket", F.floor(F.col("_fraction") * buckets)).withColumn("_all", F.lit(0))
    placed = _offset_ranks(dealt, ["_all"], "_bucket", [F.col("_fraction"), F.col("_source"), F.col("_digest"), *ties], "_place")
    place = F.col("_place") - 1
    # shard k takes the places from ceil(k n / shards) up to ceil((k + 1) n / shards)
    shard = F.expr(f"((_place - 1) * {shards}L) div {max(n_rows, 1)}L")
    start = F.expr(f"(shard * {n_rows}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (place - start).cast("long").alias("slot")
    )
