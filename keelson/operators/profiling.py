"""Profiles and exploratory aggregates.

Long forms come from one ``unpivot`` per scan.  Quantiles are exact and never
gathered in one task (see :mod:`keelson.functions.ranked`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.ranked import (
    exact_quantiles,
    quantiles_of_counts,
    running_totals,
    unpivot,
    value_counts,
)
from keelson.functions.scalars import blank_of, right_closed_band, value_of
from keelson.roles import RoleSpec

# fixed values: tenure bands and their names
TENURE_EDGES = (-1, 12, 24, 48, 72)
TENURE_LABELS = ("0-12 mo", "13-24 mo", "25-48 mo", "49-72 mo")


def inline(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide row -> one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return inline(
        rows,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.lit(kind).alias("dtype"),
                F.col("rows"),
                F.lit(len(df.columns)).alias("columns"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ],
    )


def numeric_profile(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max per feature (and group)."""
    long = unpivot(df, by, names, "double")
    keys = ["feature", *by]
    spread = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, keys, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    rounded = quartiles.select(*keys, *[F.round(q, digits).alias(q) for q in ("q25", "q50", "q75")])
    return spread.join(rounded, keys)


def categorical_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """count, distinct levels, most frequent level (smallest on ties) and its frequency."""
    counts = value_counts(unpivot(df, [], names, "string"), ["feature"], "value")
    return counts.groupBy("feature").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def missing_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """Nulls and blanks per column, only for columns that have any."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(blank_of(df, c)).alias(f"b_{i}") for i, c in enumerate(df.columns)],
    )
    long = inline(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{i}").alias("nulls"),
                F.col(f"b_{i}").alias("blanks"),
                F.round(100 * (F.col(f"n_{i}") + F.col(f"b_{i}")) / F.col("rows"), digits).alias("missing_pct"),
            )
            for i, c in enumerate(df.columns)
        ],
    )
    return long.where("nulls + blanks > 0")


def distinct_counts(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, fewest first."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(df.columns)])
        structs = [
            F.struct(F.lit(c).alias("feature"), F.col(f"d_{i}").alias("unique")) for i, c in enumerate(df.columns)
        ]
        return inline(wide, structs).orderBy("unique", "feature")
    # every column is present in the answer, also those that hold only nulls
    per_value = unpivot(df, [], df.columns, "string").groupBy("feature", "value").agg(F.lit(1).alias("one"))
    return per_value.groupBy("feature").agg(F.count("value").alias("unique")).orderBy("unique", "feature")


def level_counts(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column).alias("n")).scalar()
    return counts.withColumn("pct", F.round(100 * F.col("n") / total, digits)).orderBy(F.desc("n"), column)


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _literal_lookup(pairs: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def role_profile(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Kind and role of each column, from the schema and the distinct counts."""
    kinds = {c: "numeric" if _is_numeric(df, c) else "object" for c in df.columns}
    fixed = {spec.id_col: "identifier", spec.target_col: "target"}
    kind = _literal_lookup(kinds, F.col("feature"))
    role = F.coalesce(
        _literal_lookup(fixed, F.col("feature")),
        F.when(F.col("unique") == 2, "binary"),
        F.when((kind == "object") & (F.col("unique") > 2), "multi_class"),
        kind,
    )
    return distinct_counts(df).select("feature", kind.alias("kind"), "unique", role.alias("role"))


def suspicious(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Notes on columns that need care, each with the number of rows behind it."""
    charge = spec.charge_col
    rules = [(r.child, r.sentinel) for r in spec.dependencies]
    flags = [c for c in spec.numeric if spec.ranges.get(c) == (0, 1)]
    repeated = (
        df.groupBy(spec.id_col).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)))
    ).scalar()
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value_of(df, charge).isNull()).alias("bad"),
        *[F.count_if(F.col(c) == s).alias(f"s_{i}") for i, (c, s) in enumerate(rules)],
    ).withColumn("repeated", repeated)

    def note(column: str, code: str, n: Column) -> Column:
        return F.struct(F.lit(column).alias("column"), F.lit(code).alias("note"), n.cast("long").alias("n"))

    text_charge = F.lit(int(not _is_numeric(df, charge)))
    notes = [
        note(charge, "number stored as text", F.col("rows") * text_charge),
        note(charge, "blank or non-numeric values", F.col("bad")),
        note(spec.id_col, "key not unique", F.col("repeated")),
        *[note(c, "0/1 stored as a number", F.col("rows") * int(_is_numeric(df, c))) for c in flags],
        *[note(c, "has a sentinel level", F.col(f"s_{i}")) for i, (c, _) in enumerate(rules)],
    ]
    return inline(wide, notes).where("n > 0")


def data_dictionary(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """column, dtype, distinct values, missing (with blanks), role note."""
    kinds = dict(df.dtypes)
    missing = df.agg(
        *[F.count_if(F.col(c).isNull() | blank_of(df, c)).alias(f"m_{i}") for i, c in enumerate(df.columns)]
    )
    missing_rows = inline(
        missing,
        [
            F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"), F.col(f"m_{i}").alias("missing"))
            for i, c in enumerate(df.columns)
        ],
    )
    numeric = [c for c in spec.numeric if c != spec.charge_col and spec.ranges.get(c) != (0, 1)]
    fixed = {
        spec.id_col: "identifier",
        spec.target_col: "target",
        spec.charge_col: "numeric, needs cleaning",
        **{c: "binary number" for c in spec.numeric if spec.ranges.get(c) == (0, 1)},
        **{c: "numeric" for c in numeric},
    }
    note = F.coalesce(
        _literal_lookup(fixed, F.col("feature")),
        F.when(F.col("unique") == 2, "binary category"),
        F.when(F.col("unique") == 3, "category with 3 levels"),
        F.lit("review"),
    )
    # one row per column on both sides
    return missing_rows.join(distinct_counts(df), "feature").select(
        F.col("feature").alias("column"), "dtype", "unique", "missing", note.alias("note")
    )


def numeric_by_label(df: DataFrame, spec: RoleSpec, digits: int = 2) -> DataFrame:
    profile = numeric_profile(df, spec.numeric, [spec.target_col], 6)
    return profile.select(
        "feature",
        spec.target_col,
        F.round("mean", digits).alias("mean"),
        F.round("q50", digits).alias("median"),
        F.round("std", digits).alias("std"),
    )


def histogram(df: DataFrame, by: str, value: str, bins: int = 30, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width counts per group; the last bin is closed on the right."""
    if bounds is None:
        edge = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        low, high = edge.getField("lo"), edge.getField("hi")
    else:
        low, high = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    width = (high - low) / F.lit(float(bins))
    index = F.when(width == 0, 0).otherwise(
        F.least(F.floor((F.col(value) - low) / F.when(width != 0, width)), F.lit(bins - 1))
    )
    return (
        df.where(F.col(value).isNotNull())
        .select(by, index.cast("int").alias("bin"))
        .groupBy(by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def boxplot(df: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outliers per group, from counted distinct values."""
    ranked = running_totals(value_counts(df, [by], value), [by], value, ["n"])
    box = quantiles_of_counts(ranked, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        ranked.join(box, by)
        .groupBy(by)
        .agg(
            *[F.round(F.first(c), digits).alias(c) for c in ("q1", "median", "q3")],
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def correlations(df: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """Pearson coefficients of all pairs in one aggregate, in long form."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(
                    F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.round(f"c_{i}", digits).alias("corr")
                )
            )
    return inline(wide, cells)


def rate_by(df: DataFrame, group: Column | str, spec: RoleSpec, name: str = "category", digits: int = 6) -> DataFrame:
    """Customers and positive rate (percent) per level, highest rate first."""
    key = F.col(group) if isinstance(group, str) else group
    return (
        df.groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias("customers"), _rate(spec, digits).alias("rate_pct"))
        .where(F.col(name).isNotNull())
        .orderBy(F.desc("rate_pct"), name)
    )


def _rate(spec: RoleSpec, digits: int) -> Column:
    hits = F.count_if(F.col(spec.target_col) == spec.positive)
    return F.round(100 * hits / F.count(F.lit(1)), digits)


def tenure_band(column: str) -> Column:
    return right_closed_band(column, TENURE_EDGES, TENURE_LABELS)


def rate_overview(df: DataFrame, spec: RoleSpec, digits: int = 6) -> DataFrame:
    """:func:`rate_by` for every categorical column in one grouped pass."""
    long = unpivot(df, [spec.target_col], spec.categorical, "string", "feature", "category")
    return (
        long.where(F.col("category").isNotNull())
        .groupBy("feature", "category")
        .agg(F.count(F.lit(1)).alias("customers"), _rate(spec, digits).alias("rate_pct"))
    )


def extremes(rates: DataFrame, top: int = 15, bottom: int = 5) -> DataFrame:
    """Highest and lowest rates; both are top-k sorts."""
    highest = rates.orderBy(F.desc("rate_pct"), "feature", "category").limit(top)
    lowest = rates.orderBy("rate_pct", "feature", "category").limit(bottom)
    return highest.withColumn("part", F.lit("top")).unionByName(lowest.withColumn("part", F.lit("bottom")))


def before_after(raw: DataFrame, cleaned: DataFrame, spec: RoleSpec) -> DataFrame:
    from keelson.operators.cleaning import validate_cleaned

    kinds = dict(raw.dtypes), dict(cleaned.dtypes)
    bad = raw.agg(F.count_if(value_of(raw, spec.charge_col).isNull())).scalar()
    checks = validate_cleaned(cleaned, spec).withColumn("bad", bad)
    metrics = {
        "Rows": F.col("row_count"),
        "Columns": F.col("column_count"),
        f"{spec.charge_col} dtype (raw)": F.lit(kinds[0][spec.charge_col]),
        f"{spec.charge_col} dtype (cleaned)": F.lit(kinds[1][spec.charge_col]),
        f"Blank/non-numeric {spec.charge_col} (raw)": F.col("bad"),
        "Missing values (cleaned)": F.col("missing_values_total"),
        "Duplicate rows (cleaned)": F.col("duplicate_rows"),
    }
    return inline(
        checks,
        [F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in metrics.items()],
    )


def probability_summary(df: DataFrame, model: str, p: str, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    return df.groupBy(model).agg(
        F.min(p).alias("p_min"),
        F.round(F.avg(p), digits).alias("p_mean"),
        F.max(p).alias("p_max"),
        F.count_if(F.col(p) >= threshold).alias("predicted"),
    )
