"""Cleaning of the dirty charge column, guards around it, and role separation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.scalars import TARGET_SPELLINGS, blank_of, spelled_target, strip, value_of
from keelson.roles import RoleSpec

AUDIT_ACTION = "imputed_zero_for_new_customer"  # fixed value
MIN_TRAIN_ROWS = 100  # fixed value
MIN_CLASS_ROWS = 5  # fixed value


@dataclass(frozen=True)
class ChargeRules:
    """The charge column as expressions: text, number, and what is wrong with it."""

    blank: Column
    number: Column
    imputed: Column
    not_numeric: Column
    blank_with_tenure: Column

    @classmethod
    def of(cls, df: DataFrame, spec: RoleSpec) -> ChargeRules:
        blank = blank_of(df, spec.charge_col)
        number = value_of(df, spec.charge_col)
        at_zero = F.coalesce(value_of(df, spec.tenure_col) == 0, F.lit(False))
        return cls(
            blank=blank,
            number=number,
            imputed=blank & at_zero,
            not_numeric=~blank & number.isNull(),
            blank_with_tenure=blank & ~at_zero,
        )

    def code(self) -> Column:
        return F.when(self.not_numeric, "not_numeric").when(self.blank_with_tenure, "blank_with_tenure")

    def cleaned(self) -> Column:
        return F.when(self.imputed, F.lit(0.0)).otherwise(self.number)


def charge_violations(df: DataFrame, spec: RoleSpec) -> DataFrame:
    return df.select(
        spec.id_col, spec.tenure_col, spec.charge_col, ChargeRules.of(df, spec).code().alias("code")
    ).where(F.col("code").isNotNull())


def clean_charges(df: DataFrame, spec: RoleSpec, *, strict: bool = False) -> DataFrame:
    """Blank charges of new customers become 0, everything else becomes a double.

    ``strict`` fails on the first violating row instead of leaving a null.
    """
    if strict:
        first = charge_violations(df, spec).head(1)
        if first:
            raise ValueError(f"{spec.charge_col} cannot be cleaned, for example {first[0].asDict()}")
    return df.withColumn(spec.charge_col, ChargeRules.of(df, spec).cleaned())


def cleaning_audit(df: DataFrame, spec: RoleSpec, carried: str = "MonthlyCharges") -> DataFrame:
    """One row per imputed record."""
    return df.where(ChargeRules.of(df, spec).imputed).select(
        spec.id_col,
        spec.tenure_col,
        carried,
        F.lit("").alias(f"{spec.charge_col}_before"),
        F.lit(0.0).alias(f"{spec.charge_col}_after"),
        F.lit(AUDIT_ACTION).alias("action"),
    )


def duplicate_guard(df: DataFrame, id_col: str) -> DataFrame:
    """Copies of whole rows, and whether the key is unique, from one grouped pass.

    Copies collapse in the map-side partial aggregate, so a row that makes up a
    third of the table reaches the shuffle once per task.
    """
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(id_col)
        .agg(F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_copies"))
        .agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("duplicate_rows"),
            F.count(id_col).alias("distinct_ids"),
        )
        .withColumn("id_unique", F.col("distinct_ids") == F.col("rows"))
    )


def cleaning_invariants(raw: DataFrame, cleaned: DataFrame, spec: RoleSpec) -> DataFrame:
    """Label counts before and after, with the nulls left after cleaning."""
    before = raw.groupBy(spec.target_col).agg(F.count(F.lit(1)).alias("rows_before"))
    missing = F.sum(F.col(spec.charge_col).isNull().cast("long"))
    after = (
        cleaned.groupBy(spec.target_col)
        .agg(F.count(F.lit(1)).alias("rows_after"), missing.alias("missing_after"))
        .withColumnRenamed(spec.target_col, "_label")
    )
    joined = before.join(after, F.col(spec.target_col).eqNullSafe(F.col("_label")), "full")
    return joined.select(
        F.coalesce(spec.target_col, "_label").alias(spec.target_col),
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        F.coalesce("missing_after", F.lit(0)).alias("missing_after"),
    ).withColumn(
        "unchanged", (F.col("rows_before") == F.col("rows_after")) & (F.col("missing_after") == 0)
    )


def cleaning_summary(df: DataFrame, spec: RoleSpec) -> DataFrame:
    width = len(df.columns)
    rules = ChargeRules.of(df, spec)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(rules.code().isNull(), 1)).alias("rows_after"),
        F.lit(width).alias("columns_before"),
        F.lit(width).alias("columns_after"),
        F.count_if(rules.imputed).alias("imputed_rows"),
    )


def _nulls(names: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for name in names:
        total = total + F.col(name).isNull().cast("long")
    return total


def validate_cleaned(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """All post-cleaning checks in one row; two shuffles whatever the column count."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_id = grouped.groupBy(spec.id_col).agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.col("_n") - 1).alias("_copies"),
        F.sum(F.col("_n") * _nulls(df.columns)).alias("_nulls"),
        F.sum(F.col("_n") * F.col(spec.charge_col).isNull().cast("long")).alias("_charge_nulls"),
        F.sum(F.when(F.col(spec.target_col) == spec.negative, F.col("_n")).otherwise(0)).alias("_no"),
        F.sum(F.when(F.col(spec.target_col) == spec.positive, F.col("_n")).otherwise(0)).alias("_yes"),
    )
    checks = per_id.agg(
        F.sum("_rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.sum("_copies").alias("duplicate_rows"),
        F.sum(F.col("_rows") - 1).alias("duplicate_ids"),
        F.sum("_nulls").alias("missing_values_total"),
        F.sum("_charge_nulls").alias("charges_missing"),
        F.sum("_no").alias("label_no"),
        F.sum("_yes").alias("label_yes"),
    )
    return checks.withColumn(
        "passed",
        (F.col("duplicate_rows") == 0)
        & (F.col("duplicate_ids") == 0)
        & (F.col("missing_values_total") == 0)
        & F.lit(dict(df.dtypes)[spec.charge_col] == "double"),
    )


def separate(df: DataFrame, spec: RoleSpec, *, check: bool = True) -> DataFrame:
    """Project id, features and target; the key column keeps them aligned."""
    spec.check_columns(df)
    if check:
        repeated = df.groupBy(spec.id_col).count().where("count > 1").head(1)
        if repeated:
            raise ValueError(f"{spec.id_col} must be unique, {repeated[0][0]!r} is not")
    return df.select(*spec.columns)


def validate_separation(df: DataFrame, spec: RoleSpec) -> DataFrame:
    target = F.col(spec.target_col)
    per_id = df.groupBy(spec.id_col).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(target == spec.negative).alias("_no"),
        F.count_if(target == spec.positive).alias("_yes"),
        F.count_if(~target.isin(spec.negative, spec.positive) | target.isNull()).alias("_other"),
    )
    return per_id.agg(
        F.sum("_n").alias("row_count"),
        F.lit(len(spec.features)).alias("feature_count"),
        F.lit(len(spec.numeric)).alias("numeric_feature_count"),
        F.lit(len(spec.categorical)).alias("categorical_feature_count"),
        F.lit(spec.id_col in spec.features).alias("identifier_in_features"),
        F.lit(spec.target_col in spec.features).alias("target_in_features"),
        (F.count(spec.id_col) == F.sum("_n")).alias("id_unique"),
        F.sum("_no").alias("label_no"),
        F.sum("_yes").alias("label_yes"),
        F.sum("_other").alias("label_other"),
    ).withColumn(
        "passed",
        F.col("id_unique")
        & (F.col("label_other") == 0)
        & (F.col("label_no") > 0)
        & (F.col("label_yes") > 0)
        & ~F.col("identifier_in_features")
        & ~F.col("target_in_features"),
    )


def normalize_target(df: DataFrame, column: str, output: str = "label") -> DataFrame:
    """Add a Yes/No label; unknown spellings become null.

    A numeric column with exactly two values maps low to No and high to Yes; the
    two values come from one aggregate, read as a scalar subquery.
    """
    kind = dict(df.dtypes)[column]
    if kind == "boolean":
        return df.withColumn(output, F.when(F.col(column), "Yes").when(~F.col(column), "No"))
    if kind == "string":
        return df.withColumn(output, spelled_target(column))
    low_high = (
        df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count_distinct(column).alias("d"))
        .select(F.struct("low", "high", "d").alias("s"))
        .scalar()
    )
    two = low_high.getField("d") == 2
    value = F.col(column)
    label = F.when(
        two,
        F.when(value == low_high.getField("low"), "No").when(value == low_high.getField("high"), "Yes"),
    ).otherwise(spelled_target(F.regexp_replace(value.cast("string"), r"\.0$", "")))
    return df.withColumn(output, label)


def target_spellings(df: DataFrame, column: str) -> DataFrame:
    """How often each spelling occurs, and what it means; null label = unsupported."""
    counted = df.groupBy(F.lower(strip(column)).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("label", spelled_target("spelling"))


def known_spellings() -> list[str]:
    return list(TARGET_SPELLINGS)


def retrain_checks(df: DataFrame, target_col: str, id_col: str | None) -> DataFrame:
    """The ordered checks for a labelled upload as rows (step, code, value, failed)."""
    features = [c for c in df.columns if c not in (target_col, id_col)]
    codes = [
        ("target_missing", int(target_col not in df.columns)),
        ("id_missing", int(id_col is not None and id_col not in df.columns)),
        ("no_features", int(not features)),
    ]
    if any(v for _, v in codes[:2]):
        found = [(i + 1, code, value, value > 0) for i, (code, value) in enumerate(codes)]
        return df.sparkSession.createDataFrame(found, "step int, code string, value long, failed boolean")
    labelled = normalize_target(df, target_col, "_label")
    wide = labelled.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_label") == "No").alias("no"),
        F.count_if(F.col("_label") == "Yes").alias("yes"),
        F.count_if(F.col("_label").isNull()).alias("unknown"),
        *[
            # constant including null: one distinct value at most, nulls counted as a value
            F.when(
                F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))), 1
            )
            .otherwise(0)
            .alias(f"_const_{i}")
            for i, c in enumerate(features)
        ],
    )
    constant = sum((F.col(f"_const_{i}") for i in range(len(features))), F.lit(0)).cast("long")
    repeated = F.lit(0).cast("long")
    if id_col is not None:
        repeated = (
            df.groupBy(id_col).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))
        ).scalar()
    small = F.when(F.least("no", "yes") > 0, F.least("no", "yes")).otherwise(F.greatest("no", "yes"))
    present = F.when(F.col("no") > 0, 1).otherwise(0) + F.when(F.col("yes") > 0, 1).otherwise(0)
    steps = [
        ("too_few_rows", F.col("rows"), F.col("rows") < MIN_TRAIN_ROWS),
        ("unknown_target", F.col("unknown"), F.col("unknown") > 0),
        ("not_two_classes", present.cast("long"), present != 2),
        ("small_class", small, small < MIN_CLASS_ROWS),
        ("id_repeated", repeated, repeated > 0),
        ("no_features", F.lit(len(features)).cast("long"), F.lit(not features)),
        ("constant_feature", constant, constant > 0),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"), F.lit(code).alias("code"), value.alias("value"), failed.alias("failed")
            )
            for i, (code, value, failed) in enumerate(steps)
        ]
    )
    return wide.select(F.inline(rows))
