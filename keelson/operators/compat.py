"""Upload compatibility: header matching, key detection, data-quality reports.

Header jobs run over a catalogue with one row per (file, column), so thousands
of uploads are matched in one job.  The expected names are a fixed short list
and are carried as literals, never joined.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.functions.ranked import unpivot
from keelson.functions.scalars import blank_of, strip, value_of
from keelson.operators.policy import blank_or_null
from keelson.roles import CUSTOMER, RoleSpec
from keelson.session import ship_package

# ---------------------------------------------------------------- fixed values
# Accepted header aliases, key names, match cut-off and give-away name parts.
HEADER_ALIASES = {
    "customer_id": "customerID",
    "customerid": "customerID",
    "id": "customerID",
    "cust_id": "customerID",
    "senior_citizen": "SeniorCitizen",
    "seniorcitizen": "SeniorCitizen",
    "monthly_charges": "MonthlyCharges",
    "monthlycharges": "MonthlyCharges",
    "total_charges": "TotalCharges",
    "totalcharges": "TotalCharges",
    "phone_service": "PhoneService",
    "phoneservice": "PhoneService",
    "multiple_lines": "MultipleLines",
    "multiplelines": "MultipleLines",
    "internet_service": "InternetService",
    "internetservice": "InternetService",
    "online_security": "OnlineSecurity",
    "onlinesecurity": "OnlineSecurity",
    "online_backup": "OnlineBackup",
    "onlinebackup": "OnlineBackup",
    "device_protection": "DeviceProtection",
    "deviceprotection": "DeviceProtection",
    "tech_support": "TechSupport",
    "techsupport": "TechSupport",
    "streaming_tv": "StreamingTV",
    "streamingtv": "StreamingTV",
    "streaming_movies": "StreamingMovies",
    "streamingmovies": "StreamingMovies",
    "paperless_billing": "PaperlessBilling",
    "paperlessbilling": "PaperlessBilling",
    "payment_method": "PaymentMethod",
    "paymentmethod": "PaymentMethod",
    "churn": "Churn",
}
KEY_ALIASES = ("customerID", "customer_id", "customerid", "id", "cust_id")
MATCH_CUTOFF = 0.85
FORBIDDEN_PARTS = (
    "cancel",
    "termination",
    "final invoice",
    "post-churn",
    "exit",
    "departure",
    "closed date",
    "end date",
)
HEADER_GAPS = r"[\s_-]+"
# ------------------------------------------------------------ end fixed values


def normal_header(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(c)), HEADER_GAPS, "_")


def forbidden_headers(catalog: DataFrame) -> DataFrame:
    lowered = F.lower("header")
    hits = F.concat_ws(", ", *[F.when(lowered.contains(p), p) for p in FORBIDDEN_PARTS])
    # one search per header; the parts are listed for the few that hold one
    found = catalog.where(lowered.rlike("|".join(map(re.escape, FORBIDDEN_PARTS))))
    return found.select("file", "header", hits.alias("patterns"))


def _lookup(mapping: Mapping[str, tuple[str, int]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, found in mapping.items() for x in (F.lit(k), _found(*found))]), key)


def _found(target: str | Column, priority: int) -> Column:
    return F.struct((F.lit(target) if isinstance(target, str) else target).alias("target"), F.lit(priority).alias("priority"))


def resolve_headers(catalog: DataFrame, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """Add ``target`` and how it was found: 0 exact, 1 alias, 2 other case, else null."""
    known = {a: (t, 1) for a, t in HEADER_ALIASES.items() if t in spec.columns}
    lower = {c.lower(): (c, 2) for c in spec.columns}
    found = F.coalesce(
        F.when(strip("header").isin(*spec.columns), _found(strip("header"), 0)),
        _lookup(lower | known, normal_header("header")),
        _lookup(lower, F.lower(strip("header"))),
    )
    # generated columns are computed once per row, however many filters refer to them
    return catalog.drop("target", "priority").select("*", F.inline(F.array(found)))


def claim_headers(resolved: DataFrame) -> DataFrame:
    """One header per (file, target): the best kind of match, then the first position."""
    # limited before the shuffle too; a minimum of structs with text would sort through interpreted code
    order = Window.partitionBy("file", "target").orderBy("priority", "position", "header")
    claims = resolved.where(F.col("target").isNotNull()).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1)
    return claims.select("file", "position", "header", "target", "priority")


def nearest(columns: Iterable[str]) -> Callable[[Column], Column]:
    """The closest of ``columns`` by sequence similarity, or null below the cut-off."""
    known = list(columns)

    @arrow_udf("string")
    def closest(texts: pa.Array) -> pa.Array:
        found = (difflib.get_close_matches(t or "", known, n=1, cutoff=MATCH_CUTOFF) for t in texts.to_pylist())
        return pa.array([f[0] if f else None for f in found], pa.string())

    # else the null filter on its result moves below the distinct, and it runs for every row
    return closest.asNondeterministic()


def suggest_headers(catalog: DataFrame, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """Renames for headers that are no exact match; every target is used at most once.

    Known spellings are resolved where they stand. Similarity is computed once per distinct text
    of the others, a small table next to the catalogue, and joined to those rows only.
    """
    ship_package(catalog.sparkSession)
    resolved = resolve_headers(catalog, spec)
    open_ = resolved.where(F.col("target").isNull()).select("file", "position", "header")
    texts = open_.select(F.col("header").alias("k")).distinct()
    matched = texts.select("k", nearest(spec.columns)(strip("k")).alias("target")).where(F.col("target").isNotNull())
    near = open_.join(matched, F.col("header") == F.col("k")).select("file", "position", "header", "target", F.lit(3).alias("priority"))
    found = resolved.where(F.col("target").isNotNull()).select("file", "position", "header", "target", "priority")
    return claim_headers(found.unionByName(near)).where("priority > 0")


def suggest_for(columns: Iterable[str], spec: RoleSpec = CUSTOMER) -> dict[str, str]:
    """Suggestions for one schema (names only), using sequence similarity for near misses."""
    names = list(columns)
    taken = {c for c in names if c in spec.columns}
    lower = {c.lower(): c for c in spec.columns}
    found: dict[str, str] = {}
    for name in (n for n in names if n not in taken):
        plain = re.sub(HEADER_GAPS, "_", name.strip().lower())
        near = difflib.get_close_matches(name, spec.columns, n=1, cutoff=MATCH_CUTOFF)
        for target in (HEADER_ALIASES.get(plain), lower.get(plain), *near):
            if target in spec.columns and target not in taken:
                found[name] = target
                taken.add(target)
                break
    return found


def rename_headers(df: DataFrame, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """Rename to expected names; exact names win, and two claims on one name raise."""
    lower = {c.lower(): c for c in spec.columns}
    claims: dict[str, list[str]] = {}
    for name in df.columns:
        stripped = name.strip()
        plain = re.sub(HEADER_GAPS, "_", stripped.lower())
        target = stripped if stripped in spec.columns else HEADER_ALIASES.get(plain) or lower.get(plain)
        claims.setdefault(target or stripped, []).append(name)
    doubled = {t: c for t, c in claims.items() if len(c) > 1}
    if doubled:
        raise ValueError(f"several headers for one column: {doubled}")
    target_of = {sources[0]: target for target, sources in claims.items()}
    return df.toDF(*[target_of[c] for c in df.columns])


def readiness(catalog: DataFrame, spec: RoleSpec = CUSTOMER) -> DataFrame:
    """Per file: matched, missing and extra columns (lists bounded by the file's width)."""
    resolved = resolve_headers(catalog, spec)
    feature = F.when(F.col("target").isin(*spec.features), F.col("target"))
    expected = F.array(*[F.lit(c) for c in spec.features])
    return (
        resolved.groupBy("file")
        .agg(
            F.collect_set(feature).alias("got"),
            F.collect_set(F.when(F.col("target").isNull(), strip("header"))).alias("extra"),
        )
        .select(
            "file",
            F.size("got").cast("long").alias("matched_count"),
            F.lit(len(spec.features)).alias("required_count"),
            F.array_join(F.array_except(expected, "got"), ",").alias("missing_columns"),
            F.array_join(F.array_sort("extra"), ",").alias("extra_columns"),
            (F.size("got") == len(spec.features)).alias("ready_to_score"),
        )
    )


def detect_key(df: DataFrame) -> DataFrame:
    """Per column: nulls, blanks, uniqueness, and which one is the key.

    One pass finds the columns without nulls and blanks; the values of all of those are counted
    exactly, together, in one grouped count.
    """
    names = df.columns
    stats = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(names)],
        *[F.count_if(blank_of(df, c)).alias(f"blanks_{i}") for i, c in enumerate(names)],
    ).first()
    rows, unique = [], dict.fromkeys(names, False)
    filled = [c for i, c in enumerate(names) if stats[f"nulls_{i}"] == 0 and stats[f"blanks_{i}"] == 0]
    if filled:
        counts = unpivot(df, [], filled, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        # one row per column; a table without rows has no column that repeats a value
        most = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.max("n").alias("n")).collect()}
        unique |= {c: most.get(c, 1) == 1 for c in filled}
    order = [c for c in KEY_ALIASES if c in names] + [c for c in names if c not in KEY_ALIASES]
    chosen = next((c for c in order if unique[c]), None)
    for i, name in enumerate(names):
        rows.append((i, name, stats[f"nulls_{i}"], stats[f"blanks_{i}"], bool(unique[name]), name == chosen))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, nulls long, blanks long, is_unique boolean, chosen boolean"
    )


def key_quality(df: DataFrame, key: str) -> DataFrame:
    """Blank keys, and every member of a repeated (trimmed) key."""
    groups = df.groupBy(strip(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("k").isNull() | (F.col("k") == ""), F.col("n"))), F.lit(0)).alias("blank_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_members"),
    )


def _numeric_issues(df: DataFrame, spec: RoleSpec, strict: bool) -> dict[str, dict[str, Column]]:
    issues = {}
    for name in spec.numeric:
        value = value_of(df, name)
        bad = value.isNull()
        if name == spec.charge_col and not strict:
            bad = bad & ~(blank_of(df, name) & F.coalesce(value_of(df, spec.tenure_col) == 0, F.lit(False)))
        low, high = spec.ranges.get(name, (None, None))
        flag = (low, high) == (0, 1)
        issues[name] = {
            "non_numeric": bad,
            "not_binary": ~value.isin(0.0, 1.0) if flag else F.lit(False),
            "negative": F.lit(False) if flag else value < 0,
        }
    return issues


def numeric_quality(df: DataFrame, spec: RoleSpec, *, strict: bool = False) -> DataFrame:
    """Per numeric column: unparsable, outside 0/1, negative; one aggregate pass."""
    issues = _numeric_issues(df, spec, strict)
    wide = df.agg(*[F.count_if(c).alias(f"{n}|{k}") for n, by in issues.items() for k, c in by.items()])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column"), *[F.col(f"`{n}|{k}`").alias(k) for k in by])
            for n, by in issues.items()
        ]
    )
    return wide.select(F.inline(rows))


def _blank_charge(df: DataFrame, spec: RoleSpec) -> Column:
    return blank_or_null(spec.charge_col) & ~F.coalesce(value_of(df, spec.tenure_col) == 0, F.lit(False))


def blank_charge_quality(df: DataFrame, spec: RoleSpec) -> DataFrame:
    return df.agg(F.count_if(_blank_charge(df, spec)).alias("blank_with_tenure"))


def _invalid_level(spec: RoleSpec, name: str) -> Column:
    return ~blank_or_null(name) & ~strip(name).isin(*spec.levels[name])


def categorical_quality(df: DataFrame, spec: RoleSpec, shown: int = 10) -> DataFrame:
    """Per categorical column: blank cells, invalid cells, and the first invalid levels.

    Only distinct invalid levels are ranked, and the row_number limit is applied
    before the shuffle, so no task sees more than a few levels per column.
    """
    wide = df.agg(
        *[F.count_if(blank_or_null(c)).alias(f"b_{i}") for i, c in enumerate(spec.categorical)],
        *[F.count_if(_invalid_level(spec, c)).alias(f"i_{i}") for i, c in enumerate(spec.categorical)],
    )
    counts = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"b_{i}").alias("blank_cells"),
                        F.col(f"i_{i}").alias("invalid_cells"),
                    )
                    for i, c in enumerate(spec.categorical)
                ]
            )
        )
    )
    marked = df.select(*[F.when(_invalid_level(spec, c), strip(c)).alias(c) for c in spec.categorical])
    first = Window.partitionBy("column").orderBy("level")
    levels = (
        unpivot(marked, [], spec.categorical, "string", "column", "level")
        .where(F.col("level").isNotNull())
        .distinct()
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= shown)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("level")), "|").alias("invalid_levels"))
    )
    return counts.join(levels, "column", "left").withColumn(
        "invalid_levels", F.coalesce("invalid_levels", F.lit(""))
    )


def service_issues(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """One row per field that contradicts its parent service and will be repaired."""
    found = [
        F.when(_service_issue(r), F.struct(F.lit(r.child).alias("field"), F.lit(r.parent).alias("parent")))
        for r in spec.dependencies
    ]
    return df.select(spec.id_col, F.inline(F.array_compact(F.array(*found))))


def _service_issue(rule) -> Column:
    child = strip(rule.child)
    return (strip(rule.parent) == rule.value) & (child != "") & (child != rule.sentinel)


def compatibility(df: DataFrame, spec: RoleSpec, key: str, *, strict: bool = False) -> DataFrame:
    """The whole report in one row: one pass for the cells, one grouped pass for the key."""
    missing = [c for c in spec.features if c not in df.columns]
    extra = [c for c in df.columns if c not in spec.columns]
    if missing or key not in df.columns:
        cells = df.agg(F.count(F.lit(1)).alias("row_count"))
        for name in ("numeric_issues", "range_issues", "blank_charges", "blank_categories", "invalid_columns", "service_issues"):
            cells = cells.withColumn(name, F.lit(0).cast("long"))
    else:
        issues = _numeric_issues(df, spec, strict)
        invalid = sum(
            (F.max(_invalid_level(spec, c).cast("long")) for c in spec.categorical), F.lit(0).cast("long")
        )
        cells = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            sum((F.count_if(by["non_numeric"]) for by in issues.values()), F.lit(0)).alias("numeric_issues"),
            sum(
                (F.count_if(by["not_binary"] | by["negative"]) for by in issues.values()), F.lit(0)
            ).alias("range_issues"),
            F.count_if(_blank_charge(df, spec)).alias("blank_charges"),
            sum((F.count_if(blank_or_null(c)) for c in spec.categorical), F.lit(0)).alias("blank_categories"),
            F.coalesce(invalid, F.lit(0)).cast("long").alias("invalid_columns"),
            sum((F.count_if(_service_issue(r)) for r in spec.dependencies), F.lit(0)).alias("service_issues"),
        )
    if key in df.columns:
        keys = key_quality(df, key).select(F.struct("blank_keys", "duplicate_members").alias("s")).scalar()
        blank_keys, repeated = keys.getField("blank_keys"), keys.getField("duplicate_members")
    else:
        blank_keys = repeated = F.lit(0).cast("long")
    report = cells.withColumns(
        {
            "key_found": F.lit(key in df.columns),
            "blank_keys": blank_keys,
            "duplicate_keys": repeated,
            "matched_count": F.lit(len(spec.features) - len(missing)),
            "missing_columns": F.lit(",".join(missing)),
            "extra_columns": F.lit(",".join(extra)),
        }
    )
    clean = F.col("key_found") & (F.col("missing_columns") == "")
    for name in ("numeric_issues", "range_issues", "blank_charges", "blank_categories", "blank_keys", "duplicate_keys"):
        clean = clean & (F.col(name) == 0)
    return report.withColumn("is_compatible", clean)


MESSAGES = (
    ("missing_columns", "Required columns are missing; map or add them."),
    ("key_found", "The chosen key column is not in the file; choose another one."),
    ("duplicate_keys", "Rows share a key; every row needs its own."),
    ("blank_keys", "Rows have a blank key; fill it in."),
    ("blank_charges", "Charges are blank although tenure is above 0; fill them in."),
    ("numeric_issues", "Numeric columns hold text; correct those cells."),
    ("range_issues", "Numeric columns hold values outside their range; correct those cells."),
    ("blank_categories", "Categorical columns have blank cells; fill them in."),
    ("invalid_columns", "Some levels were not seen in training; those rows are less reliable."),
    ("service_issues", "Service fields contradict their parent service and are repaired."),
)
WARNINGS = ("invalid_columns", "service_issues")


def messages(report: DataFrame) -> DataFrame:
    """One row per issue code of a report; a compatible file gets no blocking message."""

    def size(code: str) -> Column:
        if code == "missing_columns":
            return F.when(F.col(code) == "", 0).otherwise(F.size(F.split(code, ","))).cast("long")
        if code == "key_found":
            return (~F.col(code)).cast("long")
        return F.col(code)

    listed = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("rank"),
                F.lit(code).alias("code"),
                size(code).alias("n"),
                F.lit(code not in WARNINGS).alias("blocking"),
                F.lit(text).alias("message"),
            )
            for i, (code, text) in enumerate(MESSAGES)
        ]
    )
    return report.select(F.inline(listed)).where("n > 0")


# ------------------------------------------------------------------ report with mapping, per column, and actions

#: Issue codes in the order they are shown: does it block scoring, and what is said of the column.
COLUMN_RULES = {
    "missing_column": (True, "Column {column} is missing; map a column of the file to it."),
    "key_not_found": (True, "Key column {column} is not in the mapped file; choose another one."),
    "duplicate_keys": (True, "{n} rows share a key in {column}; every row needs its own."),
    "blank_keys": (True, "{column} is blank in {n} rows; fill in a key."),
    "blank_with_tenure": (True, "{column} is blank in {n} rows of customers who are not new; fill it in."),
    "non_numeric": (True, "{column} holds no number in {n} cells; correct them."),
    "not_binary": (True, "{column} is neither 0 nor 1 in {n} cells; correct them."),
    "negative": (True, "{column} is negative in {n} cells; correct them."),
    "blank_cells": (True, "{column} is blank in {n} cells; fill them in."),
    "invalid_cells": (False, "{column} has {n} cells with levels not seen in training: {detail}"),
}


def mapped(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Columns renamed by ``mapping``; names it does not hold stay, two claims on one name raise."""
    names = [mapping.get(c, c) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"several columns mapped to one: {doubled}")
    return df.toDF(*names)


def column_issues(df: DataFrame, spec: RoleSpec, key: str, mapping: Mapping[str, str] | None = None, *, strict: bool = False) -> DataFrame:
    """(rank, code, column, n, blocking, message): what is wrong with each column of the mapped file.

    Cells are checked when no required column is missing. A file without a fault has no rows.
    """
    mapping = mapping or {}
    working, key = mapped(df, mapping), mapping.get(key, key)
    missing = [c for c in spec.features if c not in working.columns]
    absent = [("missing_column", c) for c in missing] + ([] if key in working.columns else [("key_not_found", key)])
    schema = "code string, column string, n long, detail string"
    found = df.sparkSession.createDataFrame([(code, name, 1, "") for code, name in absent], schema)

    def listed(quality: DataFrame, column: Column, counts: Mapping[str, str], detail: Mapping[str, str] | None = None) -> DataFrame:
        rows = [
            F.struct(F.lit(code).alias("code"), column.alias("column"), F.col(source).cast("long").alias("n"), (F.col(detail[code]) if detail and code in detail else F.lit("")).alias("detail"))
            for code, source in counts.items()
        ]
        return quality.select(F.inline(F.array(*rows)))

    if key in working.columns:
        found = found.unionByName(listed(key_quality(working, key), F.lit(key), {"duplicate_keys": "duplicate_members", "blank_keys": "blank_keys"}))
    if not missing:
        numbers = numeric_quality(working, spec, strict=strict)
        levels = categorical_quality(working, spec)
        found = found.unionByName(listed(numbers, F.col("column"), {c: c for c in ("non_numeric", "not_binary", "negative")}))
        found = found.unionByName(listed(blank_charge_quality(working, spec), F.lit(spec.charge_col), {"blank_with_tenure": "blank_with_tenure"}))
        found = found.unionByName(listed(levels, F.col("column"), {c: c for c in ("blank_cells", "invalid_cells")}, {"invalid_cells": "invalid_levels"}))
    rules = F.create_map(
        *[x for i, (code, (blocking, text)) in enumerate(COLUMN_RULES.items())
          for x in (F.lit(code), F.struct(F.lit(i + 1).alias("rank"), F.lit(blocking).alias("blocking"), F.lit(text).alias("text")))]
    )
    rule = F.element_at(rules, F.col("code"))
    text = rule["text"]
    for name in ("column", "n", "detail"):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    return found.where("n > 0").select(rule["rank"].alias("rank"), "code", "column", "n", rule["blocking"].alias("blocking"), text.alias("message"))


def actions(issues: DataFrame, suggestions: Mapping[str, str], key: str, required: int, *, is_mapped: bool = False) -> DataFrame:
    """(rank, action): what to do next about ``issues``; nothing for a file without a blocking one or a suggestion."""
    codes = issues.agg(F.collect_set("code").alias("codes"), F.coalesce(F.max(F.col("blocking") & ~F.col("code").isin("missing_column", "duplicate_keys")), F.lit(False)).alias("blocked"))
    pairs = "; ".join(f"'{source}' -> '{target}'" for source, target in suggestions.items())
    missing = F.array_contains("codes", "missing_column")
    steps = [
        (missing, f"Map columns of the file to the {required} required ones."),
        (missing, "Look up the required columns in the data dictionary."),
        (F.lit(bool(pairs) and not is_mapped), f"Apply the suggested mapping: {pairs}"),
        (F.array_contains("codes", "duplicate_keys"), f"Remove or correct repeated keys in '{key}'."),
        (F.col("blocked"), "Correct the blocking issues, then check the file again."),
    ]
    listed = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(i + 1).alias("rank"), F.lit(text).alias("action"))) for i, (when, text) in enumerate(steps)]))
    return codes.select(F.inline(listed))


def mapped_report(df: DataFrame, spec: RoleSpec, key: str, mapping: Mapping[str, str] | None = None, *, strict: bool = False) -> DataFrame:
    """``compatibility`` of the mapped file in one row, with the mapping, the renames still to make, messages and actions."""
    mapping = dict(mapping or {})
    working, target = mapped(df, mapping), mapping.get(key, key)
    suggested = {s: t for s, t in suggest_for(df.columns, spec).items() if s not in mapping}
    issues = column_issues(df, spec, key, mapping, strict=strict)
    steps = actions(issues, suggested, target, len(spec.features), is_mapped=bool(mapping))

    def texts(rows: DataFrame, *order: str) -> Column:
        packed = F.array_sort(F.collect_list(F.struct(*order)))
        return rows.agg(F.transform(packed, lambda r: r[order[-1]]).alias("texts")).scalar()

    return compatibility(working, spec, target, strict=strict).withColumns(
        {
            "column_mapping": F.lit(json.dumps(mapping, sort_keys=True)),
            "rename_suggestions": F.lit(json.dumps(suggested, sort_keys=True)),
            "messages": texts(issues, "rank", "column", "message"),
            "actions": texts(steps, "rank", "action"),
        }
    )
