"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import small, stored


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b``), and a bound on its rows; the
    component is its smallest node.

    Each step hooks neighbours to the smallest one around (a minimum per node, then a join on
    the node), and is written out, so a step never grows the lineage. The minima are broadcast
    while their number, which is known, allows it; beyond that adaptive execution splits hot
    nodes. Ends when a step changes nothing; the number of steps grows with the logarithm of the
    longest chain.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(links)
    while before[0]:
        n = 2 * before[0]
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(small(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "links", n)
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small(least, n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(hooked.union(least.select("u", F.col("m").alias("v"))).distinct(), "links", n)
        now = _digest(links)
        if now == before:
            break
        before = now
    roots = links.select("v").distinct()
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
    return stored(found, "components", 2 * before[0]), 2 * before[0]


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
