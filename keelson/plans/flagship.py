"""Batch scoring jobs: from scored customers to a ranked retention list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.cleaning import clean_charges
from keelson.operators.policy import RESULT_COLUMNS, batch_kpis, decide, normalize_services, rank_scores
from keelson.roles import RoleSpec


def retention_list(scored: DataFrame, spec: RoleSpec, threshold: float) -> DataFrame:
    """Narrow stages up to one range-partitioned sort."""
    ready = normalize_services(clean_charges(scored, spec), spec)
    return rank_scores(ready, spec, threshold)


def batch_response(scored: DataFrame, spec: RoleSpec, threshold: float) -> DataFrame:
    """Decision columns with the batch totals, which are read as one scalar subquery."""
    totals = (
        batch_kpis(decide(scored, "p", threshold))
        .select(F.struct(F.col("scored").alias("a"), F.col("flagged").alias("b")).alias("s"))
        .scalar()
    )
    ranked = rank_scores(scored, spec, threshold, details=()).select(*RESULT_COLUMNS)
    return ranked.withColumns(
        {"customers_scored": totals.getField("a"), "outreach_flagged": totals.getField("b")}
    )
