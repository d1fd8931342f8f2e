"""Synthetic minority rows for mixed columns, with exact nearest neighbours.

Distance: Euclidean over the numbers, plus the squared mismatch penalty for each
differing category (the median of the minority deviations).  That is a metric, so
the distances of two rows to any third one bound their own distance from below.

Pivot index: equal rows collapse to one spot; the exact distances of a spot to a few
pivots, far from each other, are its coordinates, cut into cells of one width.  Rows
within that width of a spot lie in its cell or in those next to it.  The k-th
distance inside its part of its cell bounds that of a spot; where the bound is within
the width, the cells it reaches hold all k neighbours.  The others go on with wider
cells; a round that would finish less than half of them is left out.  Full cells are dealt in parts, so no task holds more than two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from keelson.functions.scalars import hex_digest, hex_number
from keelson.roles import RoleSpec
from keelson.session import durable, ship_package

NEIGHBOURS = 5  # fixed value
BLOCK = 256  # spots that share a cell in the first round, by half
PART = 8  # blocks in a part of a cell, on average: what meets costs more than its distances do
PIVOTS = 3
GROWTH = 4  # of the width from round to round
HALVINGS = 12
SLACK = 1e-6  # of the width, for rounding


def minority(df: DataFrame, spec: RoleSpec) -> tuple[str, dict[str, int]]:
    sizes = {r[0]: r[1] for r in df.groupBy(spec.target_col).count().collect()}
    return min(sizes, key=lambda c: (sizes[c], c)), sizes


def mismatch_penalty(points: DataFrame, spec: RoleSpec) -> tuple[float, str]:
    """Median of the numeric deviations, and the column with the largest one."""
    row = points.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in spec.numeric]).first()
    spreads = sorted((row[c] or 0.0, c) for c in spec.numeric)
    half = len(spreads) // 2
    median = spreads[half][0] if len(spreads) % 2 else (spreads[half - 1][0] + spreads[half][0]) / 2
    return float(median), spreads[-1][1]


def _spots(points: DataFrame, spec: RoleSpec, k: int) -> DataFrame:
    """Distinct feature rows: ``_spot`` (the smallest id) and ``_ids`` (the k + 1 smallest)."""
    nth = F.row_number().over(Window.partitionBy(*spec.features).orderBy(spec.id_col))
    few = points.withColumn("_nth", nth).where(F.col("_nth") <= k + 1)
    return few.groupBy(*spec.features).agg(
        F.min(spec.id_col).alias("_spot"), F.sort_array(F.collect_list(spec.id_col)).alias("_ids")
    )


def _distance_to(pivot: Row, spec: RoleSpec, penalty: float) -> Column:
    total = F.lit(0.0)
    for c in spec.numeric:
        total = total + F.pow(F.col(c) - F.lit(pivot[c]), F.lit(2.0))
    for c in spec.categorical:
        total = total + F.when(F.col(c).eqNullSafe(F.lit(pivot[c])), 0.0).otherwise(penalty * penalty)
    return F.sqrt(total)


def _placed(spots: DataFrame, spec: RoleSpec, penalty: float) -> DataFrame:
    """Spots with their distances to the pivots, each pivot the spot farthest from those before it."""
    row = F.struct(*spec.features)
    pivot = spots.agg(F.min_by(row, "_spot")).first()[0]
    distances: list[Column] = []
    while pivot is not None and len(distances) < PIVOTS:
        distances.append(_distance_to(pivot, spec, penalty))
        nearest = F.least(*distances) if len(distances) > 1 else distances[0]
        pivot = spots.agg(F.max_by(row, F.struct(nearest, F.col("_spot")))).first()[0]
    return durable(spots.withColumn("_at", F.array(*distances)))


def _cell(width: float) -> Column:
    return F.transform("_at", lambda d: F.floor(d / width).cast("long"))


def _moves(j: int, width: float) -> Column:
    """Steps along coordinate j to cells that hold a point within ``far``."""
    inside = F.col("_at")[j] - F.col("a")[j] * F.lit(width)
    reach = F.col("far") + F.lit(SLACK * width)
    near = F.when(inside <= reach, F.lit(-1)), F.lit(0), F.when(F.lit(width) - inside <= reach, F.lit(1))
    return F.array_compact(F.array(*near))


def _first_width(placed: DataFrame, spots: int, widest: float) -> float:
    """Width at which a spot shares its cell with a few blocks of others, on average."""
    width = widest / max(1.0, (spots / BLOCK) ** (1 / PIVOTS))
    for _ in range(HALVINGS):
        counts = placed.groupBy(_cell(width).alias("cell")).count()
        if counts.agg(F.sum(F.col("count") * F.col("count"))).first()[0] <= 2 * BLOCK * spots:
            break
        width /= 2
    return width


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; nulls equal each other."""
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _near_pairs(
    left: np.ndarray, right: np.ndarray, spot: np.ndarray, numbers: list, categories: list, penalty: float, far2: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that hold the k nearest, by distances from the count of differing categories."""
    rough = np.zeros((len(left), len(right)))
    for v in numbers:
        gap = v[left, None] - v[None, right]
        gap *= gap
        rough += gap
    misses = np.zeros(rough.shape, np.int16)
    for v in categories:
        misses += v[left, None] != v[None, right]
    rough += misses * (penalty * penalty)
    rough[(spot[left, None] == spot[None, right]) | ~np.isfinite(rough)] = np.inf
    bound = far2[left]
    if len(right) > k and np.isinf(bound).any():
        bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((rough <= bound[:, None] * (1 + SLACK)) & np.isfinite(rough))
    return left[i], right[j]


def _nearest(both: pa.Table, left: np.ndarray, right: np.ndarray, spec: RoleSpec, penalty: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, squared distance): the k nearest rows of right for every row of left, none beyond ``far``.

    Rows lie in the order of their spots. The few pairs that can be among the nearest get their
    distance column by column, as every group adds it.
    """
    spot = _codes(both["_spot"])
    numbers = [both[c].to_numpy() for c in spec.numeric]
    categories = [_codes(both[c]) for c in spec.categorical]
    far2 = both["far"].to_numpy() ** 2
    found = [_near_pairs(left[at : at + BLOCK], right, spot, numbers, categories, penalty, far2, k) for at in range(0, len(left), BLOCK)]
    i, j = (np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*found)) if found else (left, left)
    distance2 = np.zeros(len(i))
    for v in numbers:
        gap = v[i] - v[j]
        distance2 += gap * gap
    for v in categories:
        distance2 += (v[i] != v[j]) * (penalty * penalty)
    order = np.lexsort((j, distance2, i))
    i, j, distance2 = i[order], j[order], distance2[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], distance2[kept]


def _closest(both: pa.Table, spec: RoleSpec, penalty: float, k: int) -> pa.Table:
    """The k nearest spots of one set, none beyond ``far``, for every spot of another that asks."""
    both = both.sort_by("_spot")
    asks = both["asks"].to_numpy()
    i, j, distance2 = _nearest(both, np.flatnonzero(asks), np.flatnonzero(~asks), spec, penalty, k)
    spots = both["_spot"].combine_chunks()
    return pa.table({"_spot": spots.take(pa.array(i)), "_other": spots.take(pa.array(j)), "distance2": distance2})


def _bounds(part: pa.Table, spec: RoleSpec, penalty: float, k: int) -> pa.Table:
    """For every spot that asks the k-th distance inside its part, which the k-th of all cannot exceed."""
    part = part.sort_by("_spot")
    asks = np.flatnonzero(part["asks"].to_numpy())
    i, _, distance2 = _nearest(part, asks, np.arange(len(part)), spec, penalty, k)
    far = part["far"].to_numpy().copy()
    full = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
    far[i[full]] = np.minimum(far[i[full]], np.sqrt(distance2[full]))
    return pa.table({"_spot": part["_spot"].combine_chunks().take(pa.array(asks)), "far": far[asks]})


def _near_spots(placed: DataFrame, spec: RoleSpec, penalty: float, k: int) -> DataFrame:
    """(_spot, _other, distance2): the k nearest other spots of every spot with at most k copies."""
    spots, widest = placed.agg(F.count(F.lit(1)), F.max(F.array_max("_at"))).first()
    width = _first_width(placed, spots, widest) if widest else 1.0
    tasks = 2 * placed.sparkSession.sparkContext.defaultParallelism
    kind = placed.schema["_spot"].dataType.simpleString()
    todo = placed.where(F.size("_ids") <= k).select("_spot", F.lit(float("inf")).alias("far"))
    answer = placed.select("_spot", F.col("_spot").alias("_other"), F.lit(0.0).alias("distance2")).limit(0)

    def bounds(part: pa.Table) -> pa.Table:
        return _bounds(part, spec, penalty, k)

    def closest(both: pa.Table) -> pa.Table:
        return _closest(both, spec, penalty, k)

    while not todo.isEmpty():
        last = width > widest  # every spot is in the first cell
        celled = placed.select("_spot", "_at", *spec.features, _cell(width).alias("cell"))
        parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (PART * BLOCK)).alias("parts"))
        dealt = celled.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("_spot"), "parts"))
        if not last:
            own = dealt.join(todo, "_spot", "left").withColumn("asks", F.col("far").isNotNull())
            own = own.select("cell", "part", "_spot", *spec.features, F.coalesce("far", F.lit(0.0)).alias("far"), "asks")
            todo = durable(own.groupBy("cell", "part").applyInArrow(bounds, f"_spot {kind}, far double"))
        ready = F.lit(last) | (F.col("far") <= F.lit(width * (1 - SLACK)))
        few, everyone = todo.agg(F.count_if(ready), F.count(F.lit(1))).first()
        if 2 * few < everyone:  # the cells of a few spots would bring nearly as many others as those of all
            width *= GROWTH
            continue
        # cells next to the own one that a row within ``far`` can be in
        asking = dealt.join(todo.where(ready), "_spot").withColumnsRenamed({"cell": "a", "part": "a_part"}).drop("parts")
        for j in range(PIVOTS):
            asking = asking.withColumn(f"_m{j}", F.explode(_moves(j, width)))
        beside = F.array(*[F.col("a")[j] + F.col(f"_m{j}") for j in range(PIVOTS)])
        asking = (
            asking.withColumn("b", beside)
            .join(parts.withColumnRenamed("cell", "b"), "b")
            .withColumn("b_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        )
        keys = ["a", "a_part", "b", "b_part"]
        # few rows that each bring a whole part with them: dealt to all cores, however small they are
        met = asking.select(*keys).distinct().repartition(tasks, *keys)
        others = dealt.withColumnsRenamed({"cell": "b", "part": "b_part"}).join(met, ["b", "b_part"])
        pairs = (
            asking.select(*keys, "_spot", *spec.features, "far", F.lit(True).alias("asks"))
            .unionByName(others.select(*keys, "_spot", *spec.features, F.lit(0.0).alias("far"), F.lit(False).alias("asks")))
            .groupBy(*keys)  # at most two parts of cells per group
            .applyInArrow(closest, f"_spot {kind}, _other {kind}, distance2 double")
        )
        order = Window.partitionBy("_spot").orderBy("distance2", "_other")
        found = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        round_ = durable(found.select("_spot", "_other", "distance2"))
        answer = answer.unionByName(round_)
        if last:
            break
        todo = todo.where(~ready)
        width *= GROWTH
    return answer


def nearest_neighbours(points: DataFrame, spec: RoleSpec, k: int = NEIGHBOURS) -> DataFrame:
    """(id, neighbour, distance2, nearest): the k nearest other rows, exactly; of equally near ones the smallest ids.

    Ids are unique. Null categories equal each other; a null number is an error.
    """
    ship_package(points.sparkSession)
    penalty, _ = mismatch_penalty(points, spec)
    rows = points.select(
        spec.id_col, *[F.col(c).cast("double").alias(c) for c in spec.numeric], *spec.categorical
    )
    holes = F.lit(False)
    for c in spec.numeric:
        holes = holes | F.col(c).isNull()
    if not rows.where(holes).isEmpty():
        raise ValueError("neighbours need numbers without nulls")
    placed = _placed(_spots(rows, spec, k), spec, penalty)
    # a spot's own ids are at distance 0; every other spot in reach gives at most k + 1 ids
    other = placed.select(F.col("_spot").alias("_other"), F.explode("_ids").alias("id"))
    around = _near_spots(placed, spec, penalty, k).join(other, "_other").select("_spot", "distance2", "id")
    own = placed.select("_spot", F.lit(0.0).alias("distance2"), F.explode("_ids").alias("id"))
    near = own.unionByName(around).groupBy("_spot").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("distance2", "id"))), 1, k + 1).alias("near")
    )
    # one struct as the key: nulls inside it equal each other, and the plan carries one condition
    row = F.struct(*spec.features)
    listed = placed.select("_spot", row.alias("_row")).join(near, "_spot")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col(spec.id_col)), 1, k)
    return (
        rows.select(spec.id_col, row.alias("_row"))
        .join(listed, "_row")
        .select(spec.id_col, F.posexplode(others).alias("place", "at"))
        .select(spec.id_col, F.col("at.id").alias("neighbour"), F.col("at.distance2").alias("distance2"), (F.col("place") + 1).alias("nearest"))
    )


def _mode_of_neighbours(values: DataFrame, spec: RoleSpec) -> DataFrame:
    """Most frequent category among the neighbours, the smallest on ties."""
    long = values.unpivot([spec.id_col], list(spec.categorical), "feature", "value")
    counts = long.groupBy(spec.id_col, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(spec.id_col, "feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v"))
    return best.groupBy(spec.id_col).pivot("feature", list(spec.categorical)).agg(F.first("v"))


def synthesize(df: DataFrame, spec: RoleSpec, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """New minority rows until the classes are equal; ids are marked ``S<i>-<base id>``.

    Base rows take turns in hash order, so every minority row serves either
    floor or ceil of (wanted / minority) times; the neighbour and the gap come
    from a digest, which makes the result repeatable.
    """
    label, sizes = minority(df, spec)
    if sizes[label] <= k:
        raise ValueError(f"the minority class has {sizes[label]} rows; {k} neighbours need more than {k}")
    wanted = max(sizes.values()) - sizes[label]
    points = df.where(F.col(spec.target_col) == label)
    near = nearest_neighbours(points, spec, k)
    each, rest = divmod(wanted, sizes[label])
    from keelson.operators.split import fit_order

    order = fit_order(points, spec.id_col, spec.target_col, f"smote{seed}", lambda s: {label: (rest,)})
    turns = F.when(order.position() == 0, each + 1).otherwise(each)
    draws = (
        points.select(*df.columns, F.explode(F.sequence(F.lit(1), F.greatest(turns, F.lit(1)))).alias("i"), turns.alias("turns"))
        .where("i <= turns")
        .withColumn("draw", hex_digest(f"smote{seed}", F.concat_ws("|", spec.id_col, F.col("i").cast("string"))))
        .withColumn("nearest", (hex_number(F.col("draw"), 1, 6) % k + 1).cast("int"))
        .withColumn("gap", hex_number(F.col("draw"), 9, 8) / F.lit(float(16**8)))
    )
    other = points.select(
        F.col(spec.id_col).alias("neighbour"),
        *[F.col(c).cast("double").alias(f"_o_{c}") for c in spec.numeric],
        *[F.col(c).alias(f"_c_{c}") for c in spec.categorical],
    )
    around = near.join(other, "neighbour")
    numbers = around.select(spec.id_col, "nearest", *[f"_o_{c}" for c in spec.numeric])
    categories = _mode_of_neighbours(
        around.select(spec.id_col, *[F.col(f"_c_{c}").alias(c) for c in spec.categorical]), spec
    )
    bases = draws.select(spec.id_col, spec.target_col, *spec.numeric, "i", "gap", "nearest")
    mixed = bases.join(numbers, [spec.id_col, "nearest"]).join(categories, spec.id_col)
    fresh = {
        c: F.col(c).cast("double") + F.col("gap") * (F.col(f"_o_{c}") - F.col(c).cast("double")) for c in spec.numeric
    }
    return mixed.select(
        F.concat(F.lit("S"), F.col("i").cast("string"), F.lit("-"), F.col(spec.id_col)).alias(spec.id_col),
        *[v.alias(c) for c, v in fresh.items()],
        *spec.categorical,
        spec.target_col,
    )


def oversample(df: DataFrame, spec: RoleSpec, k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """Original rows (numbers as doubles) with the synthetic ones below."""
    real = df.select(
        spec.id_col, *[F.col(c).cast("double").alias(c) for c in spec.numeric], *spec.categorical, spec.target_col
    )
    return real.unionByName(synthesize(df, spec, k, seed))
