"""Scalar column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: accepted spelling of a decimal number, white space, policy texts
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITE_SPACE = " \t\n\r\x0b\x0c"
HIGH_RISK = 0.50
ACTION_OUTREACH = "Recommend retention outreach — offer proactive save campaign."
ACTION_ROUTINE = "Routine monitoring — no immediate retention outreach."
FLAG_OUTREACH = "Yes — outreach"
FLAG_ROUTINE = "No — monitor"
TARGET_SPELLINGS = {
    "yes": "Yes",
    "no": "No",
    "true": "Yes",
    "false": "No",
    "1": "Yes",
    "0": "No",
    "churn": "Yes",
    "no churn": "No",
    "not churn": "No",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text of ``c`` without white space at either end."""
    return F.trim(col(c).cast("string"), F.lit(WHITE_SPACE))


def is_blank(c: Column | str) -> Column:
    """True for empty or white-space text; false (not null) for null."""
    return F.coalesce(strip(c) == "", F.lit(False))


def parse_number(c: Column | str) -> Column:
    """Double value of a decimal text, null for anything else (``nan``, ``1d``, text)."""
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def encode_label(c: Column | str, positive: str = "Yes") -> Column:
    return F.when(col(c) == positive, 1).otherwise(0)


def spelled_target(c: Column | str) -> Column:
    """Yes/No for the accepted spellings of a text label, null for unknown ones."""
    key = F.lower(strip(c))
    mapping = F.create_map(*[F.lit(x) for pair in TARGET_SPELLINGS.items() for x in pair])
    return F.try_element_at(mapping, key)


def hex_digest(salt: str, c: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), col(c).cast("string")))


def hex_number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def decision_flag(p: Column | str, threshold: float) -> Column:
    return (col(p) >= F.lit(float(threshold))).cast("int")


def decision_label(p: Column | str, threshold: float) -> Column:
    return F.when(col(p) >= F.lit(float(threshold)), "Churn").otherwise("No Churn")


def risk_band(p: Column | str, threshold: float, high: float = HIGH_RISK) -> Column:
    return (
        F.when(col(p) < F.lit(float(threshold)), "Low")
        .when(col(p) < F.lit(float(high)), "Elevated")
        .otherwise("High")
    )


def recommended_action(flag: Column | str) -> Column:
    return F.when(col(flag) == 1, ACTION_OUTREACH).otherwise(ACTION_ROUTINE)


def right_closed_band(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge[i], edge[i+1]]`` that holds the value, else null."""
    value = col(c)
    band = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        band = F.when((value > low) & (value <= high), label).otherwise(band)
    return band


def value_of(df: DataFrame, name: str) -> Column:
    """Double value of a column: a plain cast for numbers, parsing only for text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return parse_number(name)


def blank_of(df: DataFrame, name: str) -> Column:
    """:func:`is_blank`, which no number can be."""
    return F.lit(False) if isinstance(df.schema[name].dataType, T.NumericType) else is_blank(name)
