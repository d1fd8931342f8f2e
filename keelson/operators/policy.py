"""Service-field rules, request constraints, and the retention decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalars import (
    FLAG_OUTREACH,
    FLAG_ROUTINE,
    decision_flag,
    decision_label,
    is_blank,
    recommended_action,
    risk_band,
    value_of,
)
from keelson.operators.cleaning import ChargeRules
from keelson.roles import Dependency, RoleSpec

RESULT_COLUMNS = (
    "primary_key",
    "churn_probability",
    "prediction",
    "risk_level",
    "retention_recommended",
    "recommended_action",
    "decision_threshold",
)


def breaks(rule: Dependency) -> Column:
    return (F.col(rule.parent) == rule.value) & ~F.col(rule.child).eqNullSafe(F.lit(rule.sentinel))


def normalize_services(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Set each dependent field to its sentinel where the parent service is absent."""
    return df.withColumns(
        {r.child: F.when(breaks(r), r.sentinel).otherwise(F.col(r.child)) for r in spec.dependencies}
    )


def service_notes(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """One row per field that :func:`normalize_services` changes."""
    notes = F.array_compact(F.array(*[F.when(breaks(r), _note(r)) for r in spec.dependencies]))
    return df.select(spec.id_col, F.inline(notes))


def _note(rule: Dependency) -> Column:
    # fixed value: the wording of a repair note
    shown = "Multiple Lines" if rule.child == "MultipleLines" else rule.child
    text = f"{shown} was set to '{rule.sentinel}' because {rule.parent_label} is {rule.value}."
    return F.struct(F.lit(rule.child).alias("field"), F.lit(text).alias("note"))


def prepare_features(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Typed feature columns plus ``problem``: the first rule a row breaks, or null.

    Integral columns must hold whole numbers; nothing is truncated silently.
    """
    spec_missing = [c for c in spec.features if c not in df.columns]
    if spec_missing:
        raise ValueError(f"missing required feature columns: {spec_missing}")
    rules = ChargeRules.of(df, spec)
    problem = F.when(F.col(spec.charge_col).isNull(), f"{spec.charge_col}:missing")
    problem = problem.when(rules.blank_with_tenure, f"{spec.charge_col}:blank")
    problem = problem.when(rules.not_numeric, f"{spec.charge_col}:number")
    typed: dict[str, Column] = {}
    for name in spec.numeric:
        value = value_of(df, name)
        if name == spec.charge_col:
            typed[name] = rules.cleaned()
        elif name in spec.integral:
            problem = problem.when(value.isNull() | (value != F.floor(value)), f"{name}:integer")
            typed[name] = F.when(value == F.floor(value), value.cast("int"))
        else:
            problem = problem.when(value.isNull(), f"{name}:number")
            typed[name] = value
    return df.withColumn("problem", problem).withColumns(typed)


def prepare_batch(
    df: DataFrame, spec: RoleSpec, key: str, mapping: Mapping[str, str] | None = None
) -> DataFrame:
    """Mapped upload -> primary_key, typed features, and the raw cells in ``raw``."""
    mapping = dict(mapping or {})
    renamed = df.withColumnsRenamed(mapping)
    resolved = mapping.get(key, key)
    if resolved not in renamed.columns:
        raise ValueError(f"primary key column {key!r} not found after mapping")
    missing = [c for c in spec.features if c not in renamed.columns]
    if missing:
        raise ValueError(f"missing required feature columns: {missing}")
    keyed = renamed.withColumn("primary_key", F.col(resolved).cast("string")).withColumn(
        "raw", F.struct(*spec.features)
    )
    ready = prepare_features(normalize_services(keyed, spec), spec)
    kept = ["primary_key", *spec.features, "problem", "raw"]
    if spec.target_col in ready.columns:
        kept.append(spec.target_col)
    return ready.select(*kept)


def violations(df: DataFrame, spec: RoleSpec, *, mode: str = "reject") -> DataFrame:
    """Add ``violations``: the broken request rules of each row, joined by ';'.

    ``mode='fix'`` leaves the service rules out, as those are repaired instead.
    """
    found: list[Column] = []
    charges = ChargeRules.of(df, spec)
    for name in spec.numeric:
        value, raw = value_of(df, name), F.col(name).cast("string")
        if name == spec.charge_col:
            found.append(F.when(raw.isNull(), f"{name}:missing"))
            found.append(F.when(raw.isNotNull() & charges.not_numeric, f"{name}:number"))
            found.append(F.when(charges.blank_with_tenure, f"{name}:blank"))
        elif name in spec.integral:
            found.append(F.when(value.isNull() | (value != F.floor(value)), f"{name}:integer"))
        else:
            found.append(F.when(value.isNull(), f"{name}:number"))
        low, high = spec.ranges.get(name, (None, None))
        outside = F.lit(False)
        if low is not None:
            outside = outside | (value < low)
        if high is not None:
            outside = outside | (value > high)
        found.append(F.when(outside, f"{name}:range"))
    for name, levels in spec.levels.items():
        found.append(F.when(F.col(name).isNull() | ~F.col(name).isin(*levels), f"{name}:level"))
    if mode == "reject":
        found.extend(F.when(breaks(r), f"{r.child}:dependency") for r in spec.dependencies)
    return df.withColumn("violations", F.concat_ws(";", *found))


def decide(df: DataFrame, probability: str, threshold: float) -> DataFrame:
    """Policy columns; every decision uses the unrounded probability."""
    return df.withColumns(
        {
            "retention_recommended": decision_flag(probability, threshold),
            "prediction": decision_label(probability, threshold),
            "risk_level": risk_band(probability, threshold),
            "recommended_action": recommended_action(decision_flag(probability, threshold)),
            "decision_threshold": F.lit(float(threshold)),
        }
    )


def rank_scores(
    df: DataFrame,
    spec: RoleSpec,
    threshold: float,
    *,
    probability: str = "p",
    digits: int = 4,
    details: tuple[str, ...] | None = None,
) -> DataFrame:
    """Ranked decisions: a range-partitioned sort on the unrounded score, then the key."""
    decided = decide(df, probability, threshold)
    extra = [F.col(c) for c in (details if details is not None else spec.features) if c in df.columns]
    if spec.target_col in df.columns:
        extra.append(F.col(spec.target_col).alias("actual_churn"))
    return decided.orderBy(F.col(probability).desc(), F.col(spec.id_col)).select(
        F.col(spec.id_col).cast("string").alias("primary_key"),
        F.round(probability, digits).alias("churn_probability"),
        "prediction",
        "risk_level",
        "retention_recommended",
        "recommended_action",
        "decision_threshold",
        *extra,
    )


def batch_kpis(decided: DataFrame) -> DataFrame:
    flagged = F.col("retention_recommended") == 1
    return decided.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(~flagged).alias("routine"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk"),
    )


def action_table(ranked: DataFrame) -> DataFrame:
    """Display form of the decision columns (percent with one decimal, half up)."""
    tenths = F.floor(F.col("churn_probability") * 1000 + 0.5)
    whole, rest = F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")
    shown = [
        "primary_key",
        F.concat(whole, F.lit("."), rest, F.lit("%")).alias("churn_probability"),
        "risk_level",
        "prediction",
        F.when(F.col("retention_recommended") == 1, FLAG_OUTREACH).otherwise(FLAG_ROUTINE).alias("retention_recommended"),
        "recommended_action",
    ]
    if "actual_churn" in ranked.columns:
        shown.append("actual_churn")
    return ranked.select(*shown)


def priority_list(decided: DataFrame, spec: RoleSpec, probability: str = "p", k: int = 10) -> DataFrame:
    """The k flagged customers at highest risk, with the count of the others."""
    flagged = decided.where(F.col("retention_recommended") == 1)
    total = flagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = flagged.orderBy(F.col(probability).desc(), F.col(spec.id_col)).limit(k)
    return top.select(
        F.col(spec.id_col).alias("primary_key"),
        F.round(probability, 4).alias("churn_probability"),
        "risk_level",
        "recommended_action",
        F.greatest(total - k, F.lit(0)).alias("remaining"),
    )


def level_options(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Distinct non-null levels per column in long form, sorted; no list is collected."""
    from keelson.functions.ranked import unpivot

    return (
        unpivot(df, [], names, "string", "feature", "level")
        .where(F.col("level").isNotNull())
        .distinct()
        .orderBy("feature", "level")
    )


def blank_or_null(name: str) -> Column:
    return F.col(name).isNull() | is_blank(name)

