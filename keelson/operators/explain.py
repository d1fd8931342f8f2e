"""Contributions of features to the output of boosted trees or a forest, exact for tree paths."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.prep import FEATURES
from keelson.session import scratch_path, ship_package


Trees = GBTClassificationModel | RandomForestClassificationModel


def tree_table(spark: SparkSession, model: Trees, path: str | None = None) -> DataFrame:
    """Nodes of a saved model as a table, with tree weights.

    A boosted node predicts a margin; a forest node predicts the weighted share of the positive class,
    and every tree counts the same, so the sum over trees is the forest's probability.
    """
    folder = path or scratch_path(spark, "trees")
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    # columns in the order tree id, tree metadata, weight; their names vary by release
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    prediction, weight = F.col("prediction"), F.col("weights")
    if isinstance(model, RandomForestClassificationModel):
        prediction = F.get("impurityStats", F.lit(1)) / F.aggregate("impurityStats", F.lit(0.0), lambda total, v: total + v)
        weight = F.lit(1.0 / model.getNumTrees)
    # one row per tree
    return nodes.join(F.broadcast(weights), "treeID").select(
        "treeID",
        "id",
        prediction.alias("prediction"),
        "rawCount",
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"),
        F.col("split.numCategories").alias("arity"),
        weight.alias("weight"),
    )


@dataclass(frozen=True)
class Step:
    """One split on the way to a leaf."""

    feature: int
    cut: tuple[float, ...]
    categorical: bool
    left: bool
    share: float  # cover of the child taken / cover of the parent

    def taken(self, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature]
        goes_left = np.isin(column, self.cut) if self.categorical else column <= self.cut[0]
        return goes_left if self.left else ~goes_left


def leaf_paths(nodes: pd.DataFrame) -> list[tuple[float, list[Step]]]:
    """(weighted leaf value, steps) of every leaf of every tree."""
    found = []
    for _, tree in nodes.groupby("treeID"):
        by_id = {int(r.id): r for r in tree.itertuples()}
        stack = [(0, [])]
        while stack:
            at, steps = stack.pop()
            node = by_id[at]
            if node.leftChild < 0:
                found.append((float(node.prediction * node.weight), steps))
                continue
            for child, left in ((int(node.leftChild), True), (int(node.rightChild), False)):
                share = float(by_id[child].rawCount) / float(node.rawCount)
                step = Step(int(node.feature), tuple(float(v) for v in node.cut), node.arity > 0, left, share)
                stack.append((child, [*steps, step]))
    return found


#: Rows of a task, at least, and rows explained at a time, at most: bounds its arrays to this times features and nodes of a path.
CHUNK = 1024
MOST_ROWS = 65_536
#: Features of a path and splits below its end whose outcomes are tabulated together: a column of a table stays in cache.
TABLE_BITS = 11


@cache
def _nodes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on 0 to 1."""
    at, weight = np.polynomial.legendre.leggauss(count)
    return (at + 1) / 2, weight / 2


def _leaf_weights(known: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Per feature and row: the Shapley-weighted sum over the subsets of a path's other features.

    A subset of size k of the m - 1 others weighs k! (m - 1 - k)! / m!, which is the integral of
    u^k (1 - u)^(m - 1 - k) over 0 to 1. So the sum over all subsets is the integral of one product,
    of known u + unknown (1 - u) over the others: a polynomial of degree m - 1, for which ceil(m / 2)
    Gauss-Legendre nodes are exact. Work is m^2 instead of 2^m, and all terms are of one sign.
    """
    m = len(known)
    u, shares = _nodes((m + 1) // 2)
    factors = known[:, :, None] * u + unknown[:, None, None] * (1 - u)
    before, after = np.ones_like(factors), np.ones_like(factors)
    np.cumprod(factors[:-1], axis=0, out=before[1:])
    after[:-1] = np.cumprod(factors[:0:-1], axis=0)[::-1]
    return (before * after) @ shares


def contributions(x: np.ndarray, paths: Sequence[tuple[float, list[Step]]]) -> tuple[np.ndarray, float]:
    """Shapley values of the path-dependent game, summed over leaves.

    For a leaf, a feature is either known (the row follows all its splits or not)
    or unknown (weight: product of the cover shares of its splits).
    """
    out = np.zeros_like(x, dtype=float)
    base = 0.0
    for value, steps in paths:
        hits: dict[int, np.ndarray] = {}
        shares: dict[int, float] = {}
        for step in steps:
            hit = step.taken(x).astype(float)
            hits[step.feature] = hits.get(step.feature, 1.0) * hit
            shares[step.feature] = shares.get(step.feature, 1.0) * step.share
        base += value * math.prod(shares.values())
        if not hits:  # a tree of one leaf
            continue
        features = sorted(hits)
        known = np.stack([hits[f] for f in features])
        unknown = np.array([shares[f] for f in features])
        out[:, features] += (value * _leaf_weights(known, unknown) * (known - unknown[:, None])).T
    return out, base


@dataclass(frozen=True)
class Tree:
    """Nodes of one tree by their position; the root is the first."""

    left: np.ndarray  # positions of the children, below 0 at a leaf
    right: np.ndarray
    feature: np.ndarray
    cut: list[np.ndarray]
    categorical: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # weighted prediction
    splits: np.ndarray  # splits at a node and below


def trees_of(nodes: pd.DataFrame) -> list[Tree]:
    found = []
    for _, tree in nodes.groupby("treeID"):
        tree = tree.sort_values("id")
        place = {int(i): at for at, i in enumerate(tree["id"])}
        left, right = (np.array([place.get(int(c), -1) for c in tree[name]]) for name in ("leftChild", "rightChild"))
        cuts = [np.asarray(c, dtype=float) for c in tree["cut"]]
        value = (tree["prediction"] * tree["weight"]).to_numpy(float)
        splits = np.zeros(len(left), dtype=int)
        for at in range(len(left) - 1, -1, -1):  # children have larger ids
            if left[at] >= 0:
                splits[at] = 1 + splits[left[at]] + splits[right[at]]
        found.append(Tree(left, right, tree["feature"].to_numpy(int), cuts, tree["arity"].to_numpy() > 0, tree["rawCount"].to_numpy(float), value, splits))
    return found


@cache
def _members(count: int) -> np.ndarray:
    """Which of ``count`` features each of their subsets holds."""
    return (np.arange(1 << count)[:, None] >> np.arange(count) & 1).astype(bool)


def _leaf_terms(pattern: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Per feature of a path and row: its contribution at a leaf of value 1.

    ``pattern`` has a bit per feature, set where the row follows its splits, and rows of one pattern
    have the same terms. So all patterns are computed when they are fewer than the rows, else the
    pattern of each row. At a node u of the integral in :func:`_leaf_weights` a known feature's
    factor is u + share (1 - u) and another's share (1 - u); a term is the product of all factors
    over the own one, times 1 - share or -share.
    """
    m = len(shares)
    u, weights = _nodes((m + 1) // 2)
    miss = shares[:, None] * (1 - u)
    hit = miss + u
    if few := (1 << m) <= len(pattern):
        member = _members(m)
        product = np.ones((1, len(u)))
        for i in range(m):
            product = np.concatenate([product * miss[i], product * hit[i]])
    else:
        member = (pattern[:, None] >> np.arange(m) & 1).astype(bool)
        product = np.ones((len(pattern), len(u)))
        for i in range(m):
            product *= np.where(member[:, i, None], hit[i], miss[i])
    known = product @ (weights * (1 - shares[:, None]) / hit).T
    unknown = product @ (-weights / (1 - u))
    terms = np.where(member, known, unknown[:, None]).T
    return terms[:, pattern] if few else terms


def _goes_left(tree: Tree, at: int, columns: np.ndarray) -> np.ndarray:
    column, cut = columns[tree.feature[at]], tree.cut[at]
    return np.isin(column, cut) if tree.categorical[at] else column <= cut[0]


def _subtree_terms(tree: Tree, at: int, features: list[int], shares: list[float]) -> tuple[list[int], list[int], np.ndarray, float]:
    """What the leaves below a node contribute, for any row: its splits, their features after those of the path,
    contributions by feature and outcome, and the part of the base.

    An outcome has a bit per feature of the path, set where the row follows its splits, and above them one per split,
    set where the row goes left there. Path features that no split below tries are factors common to all
    leaves, so the leaves are added up at each node of the integral in :func:`_leaf_weights` before those come in.
    """
    splits: list[int] = []
    leaves: list[tuple[int, list[tuple[int, int, bool, float]]]] = []
    stack: list[tuple[int, list[tuple[int, int, bool, float]]]] = [(at, [])]
    while stack:
        here, steps = stack.pop()
        if tree.left[here] < 0:
            leaves.append((here, steps))
            continue
        for child, left in ((int(tree.left[here]), True), (int(tree.right[here]), False)):
            stack.append((child, [*steps, (len(splits), int(tree.feature[here]), left, float(tree.cover[child] / tree.cover[here]))]))
        splits.append(here)
    below = {f for _, steps in leaves for _, f, _, _ in steps}
    inner = [f for f in features if f in below]
    outer = [f for f in features if f not in below]
    new = sorted(below - set(inner))
    most = len(features) + max(len({f for _, f, _, _ in steps} - set(inner)) for _, steps in leaves)
    u, weights = _nodes((max(most, 1) + 1) // 2)
    missed = -1 / (1 - u)
    tried = _members(len(inner) + len(splits))
    path_share = dict(zip(features, shares, strict=True))
    total, base = np.zeros((len(tried), len(u))), 0.0
    own = {f: np.zeros_like(total) for f in (*inner, *new)}
    for leaf, steps in leaves:
        share = {f: path_share[f] for f in inner}
        follows = {f: tried[:, i] for i, f in enumerate(inner)}
        for split, f, left, part in steps:
            taken = tried[:, len(inner) + split] == left
            follows[f] = follows[f] & taken if f in follows else taken
            share[f] = share.get(f, 1.0) * part
        product, value = np.full_like(total, tree.value[leaf]), float(tree.value[leaf])
        for f, on in follows.items():
            product *= np.where(on[:, None], share[f] * (1 - u) + u, share[f] * (1 - u))
            value *= share[f]
        total += product
        base += value
        for f, on in follows.items():
            own[f] += product * np.where(on[:, None], (1 - share[f]) / (share[f] * (1 - u) + u), missed)
    factors = np.array([path_share[f] for f in outer])[:, None] * (1 - u)
    known = _members(len(outer))
    product = np.ones((1, len(u)))
    for miss in factors:
        product = np.concatenate([product * miss, product * (miss + u)])
    terms = {f: (own[f] * weights) @ product.T for f in own}
    for i, (f, miss) in enumerate(zip(outer, factors, strict=True)):
        gain = (1 - path_share[f]) / (miss + u)
        terms[f] = total @ (product * np.where(known[:, i, None], gain, missed) * weights).T
    table = np.stack([terms[f] for f in (*features, *new)]) if terms else np.zeros((0, len(tried), 1))
    if inner:
        # from path features apart, those tried again below first, to the order of the path
        bits = _members(len(features) + len(splits))
        place = lambda chosen: sum((bits[:, i].astype(np.intp) << at for at, i in enumerate(chosen)), np.zeros(len(bits), np.intp))
        again = [features.index(f) for f in inner] + [len(features) + i for i in range(len(splits))]
        table = table[:, place(again), place([features.index(f) for f in outer])]
    else:
        table = np.ascontiguousarray(table.reshape(len(table), -1))
    return splits, new, table, base * float(np.prod([path_share[f] for f in outer]))


def forest_contributions(x: np.ndarray, trees: Sequence[Tree]) -> tuple[np.ndarray, float]:
    """What :func:`contributions` gives, walking down each tree once: a split is tried once for all leaves below it.

    Where few features and splits are left, the outcomes of all of them have their contributions tabulated
    once, and rows look theirs up.
    """
    out = np.zeros(x.shape[::-1])
    base = 0.0
    columns = np.ascontiguousarray(x.T)
    bits = min(TABLE_BITS, len(x).bit_length() - 1)
    held = np.empty(len(x))
    for tree in trees:
        stack: list[tuple[int, list[int], list[float], np.ndarray]] = [(0, [], [], np.zeros(len(x), dtype=np.intp))]
        while stack:
            at, features, shares, pattern = stack.pop()
            if len(features) + tree.splits[at] <= bits:
                splits, new, table, part = _subtree_terms(tree, at, features, shares)
                base += part
                for i, split in enumerate(splits, len(features)):
                    pattern = pattern | _goes_left(tree, split, columns).astype(np.intp) << i
                for f, terms in zip((*features, *new), table, strict=True):
                    np.take(terms, pattern, out=held, mode="clip")
                    out[f] += held
                continue
            if tree.left[at] < 0:
                base += tree.value[at] * math.prod(shares)
                out[features] += tree.value[at] * _leaf_terms(pattern, np.array(shares))
                continue
            feature, goes_left = int(tree.feature[at]), _goes_left(tree, at, columns)
            for child, taken in ((int(tree.left[at]), goes_left), (int(tree.right[at]), ~goes_left)):
                share = float(tree.cover[child] / tree.cover[at])
                if feature in features:
                    i = features.index(feature)
                    longer, follows = features, pattern & ~((~taken).astype(np.intp) << i)
                    covered = [*shares[:i], shares[i] * share, *shares[i + 1 :]]
                else:
                    longer, covered = [*features, feature], [*shares, share]
                    follows = pattern | taken.astype(np.intp) << len(features)
                stack.append((child, longer, covered, follows))
    return out.T, base


def _dealt(df: DataFrame) -> DataFrame:
    """Rows in even partitions of ``CHUNK`` or more, as many to a core: what does not depend on rows is done once a task."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-rows // CHUNK), cores * -(-rows // (cores * MOST_ROWS)))
    return df.repartition(tasks) if tasks > 1 else df.coalesce(1)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to ``MOST_ROWS`` rows or what there is."""
    held, rows = [], 0
    for batch in batches:
        for start in range(0, len(batch), MOST_ROWS):
            part = batch.iloc[start : start + MOST_ROWS]
            if rows + len(part) > MOST_ROWS:
                yield pd.concat(held)
                held, rows = [], 0
            held.append(part)
            rows += len(part)
    if held:
        yield pd.concat(held)


def tree_contributions(df: DataFrame, model: Trees, id_col: str) -> DataFrame:
    """(id, contributions, base): one array per row, in feature order.

    Contributions add up to the margin of boosted trees and to the probability of a forest, less the
    base. The node table is bounded by trees x 2^(depth + 1) rows, so it is sent to the tasks as
    arrays in a broadcast variable. Rows are dealt evenly: small tables lie in one partition, and a row
    costs a walk through all trees.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees_of(tree_table(spark, model).toPandas()))
    slim = _dealt(df.select(id_col, vector_to_array(FEATURES).alias("x")))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for part in _gathered(batches):
            values, base = forest_contributions(np.vstack(part["x"].to_numpy()).astype(float), trees)
            yield pd.DataFrame({id_col: part[id_col], "contributions": list(values), "base": base})

    kind = dict(df.dtypes)[id_col]
    return slim.mapInPandas(explain, f"`{id_col}` {kind}, contributions array<double>, base double")


def global_importance(df: DataFrame, names: Sequence[str], column: str = "contributions", digits: int = 6) -> DataFrame:
    """Mean absolute contribution per feature with rank, from one wide aggregate."""
    wide = df.agg(*[F.avg(F.abs(F.get(column, F.lit(i)))).alias(f"m_{i}") for i in range(len(names))])
    rows = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.round(f"m_{i}", digits).alias("mean_abs")) for i, n in enumerate(names)]
    )
    ordered = F.array_sort(rows, _by_size)
    return wide.select(F.posexplode(ordered).alias("pos", "s")).select(
        "s.feature", "s.mean_abs", (F.col("pos") + 1).cast("int").alias("rank")
    )


def _by_size(a: Column, b: Column) -> Column:
    x, y = a["mean_abs"], b["mean_abs"]
    by_name = F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    return F.when(x > y, -1).when(x < y, 1).otherwise(by_name)


def local_top(df: DataFrame, id_col: str, names: Sequence[str], column: str = "contributions", k: int = 5, digits: int = 4) -> DataFrame:
    """k strongest contributions in either direction per row, within the row."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.zip_with(F.col(column), labels, lambda v, n: F.struct(v.alias("value"), n.alias("feature")))
    down = F.slice(F.array_sort(pairs), 1, k)
    negated = F.transform(pairs, lambda s: F.struct((-s["value"]).alias("value"), s["feature"].alias("feature")))
    up = F.transform(
        F.slice(F.array_sort(negated), 1, k),
        lambda s: F.struct((-s["value"]).alias("value"), s["feature"].alias("feature")),
    )
    both = F.concat(
        F.transform(up, lambda s, i: F.struct(F.lit("increasing").alias("direction"), (i + 1).alias("rank"), s["feature"].alias("feature"), F.round(s["value"], digits).alias("value"))),
        F.transform(down, lambda s, i: F.struct(F.lit("decreasing").alias("direction"), (i + 1).alias("rank"), s["feature"].alias("feature"), F.round(s["value"], digits).alias("value"))),
    )
    return df.select(id_col, F.inline(both))


def cases(df: DataFrame, id_col: str, p: str, threshold: float) -> DataFrame:
    """Highest, lowest and nearest-to-threshold rows (smallest key on ties)."""
    row, key = F.struct(*df.columns), F.col(id_col)
    picked = df.agg(
        F.min_by(row, F.struct(-F.col(p), key)).alias("high_risk"),
        F.min_by(row, F.struct(F.col(p), key)).alias("low_risk"),
        F.min_by(row, F.struct(F.abs(F.col(p) - F.lit(float(threshold))), key)).alias("near_threshold"),
    )
    listed = [F.struct(F.lit(n).alias("case"), F.col(n).alias("r")) for n in ("high_risk", "low_risk", "near_threshold")]
    return picked.select(F.inline(F.array(*listed))).select("case", "r.*")
