"""Mixing sources to target weights: fixed-length blocks, multinomial counts, pseudorandom block order.

The words of a source, document after document in a seeded order, are cut into blocks of a fixed
length. The mix is a row of output shards of equally many slots. Each slot of a shard draws its
source, so a shard's counts are multinomial; where a source has drawn more slots than its target
has blocks, the last of them go to sources that drew fewer, so the whole mix meets every target.
A source's slots are numbered through all shards, the number is mapped through a pseudorandom
permutation of the source's block numbers (another one for each pass over the source), and the
blocks are joined by their number. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.ranked import running_totals
from keelson.llm.common import stored

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket of the document order should hold about, and buckets of a source at most.
BUCKET_ROWS = 4_000
MOST_BUCKETS = 65_536
#: Equal rows that one row is unfolded to at a time.
COPIES = 10_000
#: Modulus of the hash that decides a swap: a prime below 2^31, so products stay within a long.
PRIME = 2_147_483_647


@dataclass(frozen=True)
class Settings:
    """Words of a block, slots of an output shard, passes over a source at most, seed, swap rounds.

    Sources, in the order of their code points, weigh ``weights`` over and over.
    """

    block_words: int = 128
    shard_slots: int = 4_096
    most: int = 3
    seed: int = 29
    rounds: int = 12
    weights: tuple[int, ...] = (1, 2, 3)


def hex_long(digest: Column, start: int, digits: int) -> Column:
    """Hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _swaps(key: Column, epoch: int, n: Column, s: Settings) -> Column:
    """Rounds of a swap-or-not permutation of 0..n-1: partner sum, factor and shift of the deciding hash."""

    def one(r: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(s.seed), F.lit("swap"), key, F.lit(epoch), r))
        return F.struct(
            (hex_long(digest, 1, 15) % n).alias("sum"), (hex_long(digest, 16, 7) + 1).alias("factor"), hex_long(digest, 23, 7).alias("shift")
        )

    return F.transform(F.sequence(F.lit(1), F.lit(s.rounds)), one)


def _permuted(x: Column, n: Column, swaps: Column) -> Column:
    """Where the permutation sends x: in each round x and its partner change places, or neither does."""

    def one(at: Column, r: Column) -> Column:
        partner = F.pmod(r["sum"] - at, n)
        hashed = ((F.greatest(at, partner) % PRIME) * r["factor"] + r["shift"]) % PRIME
        return F.when(hashed < PRIME // 2, partner).otherwise(at)

    return F.aggregate(swaps, x.cast("long"), one)


def _before(rows: DataFrame, group: list[str], at: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group with a smaller ``at``, by sums of 1,024 neighbours and sums inside them."""
    rows = rows.withColumn("_bin", F.expr(f"{at} div 1024"))
    ahead = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*group, "_bin").agg(F.sum(value).alias("_n"))
    bins = bins.select(*group, "_bin", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*group, "_bin").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bins, [*group, "_bin"]).withColumn(
        name, F.col("_ahead") + F.col("_inside")
    ).drop("_bin", "_ahead", "_inside")


@dataclass(frozen=True)
class Mix:
    """What :func:`mix` made, as tables.

    ``documents``: id, ``size``, ``source``, ``sid`` (number of the source), ``start`` (words of the source before it);
    ``sources``: ``sid``, ``source``, ``source_size``, ``weight``, ``target``, ``goal`` (whole words), ``blocks``;
    ``spans``: ``shard``, ``slot``, ``place`` (word in the slot), ``sid``, id, ``start`` (of the document), ``first`` (word in the
    document), ``length``.
    """

    documents: DataFrame
    sources: DataFrame
    spans: DataFrame
    id_col: str

    def taken(self) -> DataFrame:
        """Per document: id, ``size``, ``source_size``, ``target``, ``taken``."""
        # a document with words is alone at its start in its source
        used = self.spans.groupBy("sid", "start").agg(F.sum("length").alias("_taken"))
        docs = self.documents.withColumn("_start", F.when(F.col("size") > 0, F.col("start")))
        used = used.withColumnRenamed("start", "_start")
        totals = self.sources.select("sid", "source_size", "target")
        return docs.join(used, ["sid", "_start"], "left").join(totals, "sid").select(
            self.id_col, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
        )


def _sources(groups: DataFrame, s: Settings) -> DataFrame:
    """Sources with their number, weight, and target: shares by weight, none above ``most`` times its size."""
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    # nulls come last; running_totals wants one order column, so they get a letter of their own
    keyed = sizes.select("source", "source_size", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("key"), F.lit(1).alias("one"))
    numbered = running_totals(keyed, [], "key", ["one"]).select("source", "key", "source_size", (F.col("cum_one") - 1).cast("long").alias("sid"))
    weights = F.array(*[F.lit(w) for w in s.weights])
    rows = stored(numbered.withColumn("weight", F.element_at(weights, (F.col("sid") % len(s.weights) + 1).cast("int")).cast("long")), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rest, shares, bounded = total, 0, F.lit(False)
    while True:  # each turn adds sources to the bounded ones, and two sums come back
        left, sized = rows.agg(F.sum(F.when(~bounded, F.col("weight"))), F.sum(F.when(bounded, F.col("source_size")))).first()
        now = (total - s.most * (sized or 0), left or 0)
        if now == (rest, shares) or not now[1]:
            break
        rest, shares = now
        bounded = s.most * F.col("source_size").cast("double") * shares < F.lit(rest).cast("double") * F.col("weight")
    cap = (s.most * F.col("source_size")).cast("double")
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(shares, 1)))
    rows = rows.withColumn("target", F.when(bounded, cap).otherwise(F.least(share, cap)))
    return rows.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", F.expr(f"(source_size + {s.block_words - 1}L) div {s.block_words}L"))


def _planned(sources: DataFrame, s: Settings) -> DataFrame:
    """Per source with words to give: swaps of each pass, ``slots``, and ``cut``, the words its last slot leaves out."""
    b = s.block_words
    n, size = F.col("blocks"), F.col("source_size")
    rows = sources.where("goal > 0").select("sid", "source_size", "blocks", "goal", F.array(*[_swaps(F.col("key"), e, n, s) for e in range(s.most + 1)]).alias("swaps"))
    rows = rows.withColumn("epoch", F.expr("goal div source_size")).withColumn("rest", F.expr("goal % source_size"))
    last = F.col("swaps")[F.col("epoch")]
    # undone, the rounds are the same in reverse: where the source's last and shorter block comes in the last pass
    rows = rows.withColumn("short_at", _permuted(n - 1, n, F.reverse(last))).withColumn("lack", n * b - size)
    rows = rows.withColumn("more", F.when(F.col("rest") <= F.col("short_at") * b, F.expr(f"(rest + {b - 1}L) div {b}L")).otherwise(F.expr(f"(rest + lack + {b - 1}L) div {b}L")))
    given = F.col("more") * b - F.when(F.col("more") > F.col("short_at"), F.col("lack")).otherwise(0)
    return rows.select("sid", "blocks", "swaps", (F.col("epoch") * n + F.col("more")).alias("slots"), (given - F.col("rest")).alias("cut"))


def _drawn(planned: DataFrame, s: Settings) -> DataFrame:
    """(``sid``, ``shard``, ``n``): slots of each output shard by source."""
    spark = planned.sparkSession
    total, kinds = planned.agg(F.sum("slots"), F.count("*")).first()
    # a slot draws a number below the sum of all slots, which lies in the interval of one source; intervals are
    # found through equal cells, of which a slot has one and a source those that its interval meets
    cell = max(1, int(total or 0) // (4 * max(kinds, 1)))
    ends = _before(planned.withColumn("_all", F.lit(0)), ["_all"], "sid", "slots", "low").select("sid", "slots", "low")
    cells = ends.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}L"), F.expr(f"(low + slots - 1) div {cell}L"))))
    digest = F.md5(F.concat_ws("|", F.lit(s.seed), F.lit("draw"), F.col("id").cast("string")))
    slots = spark.range(total or 0).select(F.expr(f"id div {s.shard_slots}L").alias("shard"), (hex_long(digest, 1, 15) % max(total or 0, 1)).alias("u"))
    slots = slots.withColumn("cell", F.expr(f"u div {cell}L"))
    met = slots.join(cells, "cell").where("u >= low AND u < low + slots")
    drawn = met.groupBy("sid", "shard").agg(F.count("*").alias("drawn"))
    counts = stored(_before(drawn, ["sid"], "shard", "drawn", "before").join(planned.select("sid", "slots"), "sid").select(
        "sid", "shard", "drawn", F.greatest(F.least("drawn", F.col("slots") - F.col("before")), F.lit(0)).alias("held"),
    ), "mix-draws")
    # slots beyond their source's number, in the order of the shards, meet the numbers that are missing, in that of the sources
    over = counts.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("held")).alias("n")).where("n > 0").withColumn("_all", F.lit(0))
    free = _before(over, ["_all"], "shard", "n", "_at").select("shard", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1)).alias("at"))
    short = planned.join(counts.groupBy("sid").agg(F.sum("held").alias("held")), "sid", "left")
    short = short.select("sid", (F.col("slots") - F.coalesce("held", F.lit(0))).alias("n"), F.lit(0).alias("_all")).where("n > 0")
    missing = _before(short, ["_all"], "sid", "n", "_at").select("sid", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("n") - 1)).alias("at"))
    moved = free.join(missing, "at").groupBy("sid", "shard").agg(F.count("*").alias("n"))
    held = counts.where("held > 0").select("sid", "shard", F.col("held").alias("n"))
    return held.unionByName(moved).groupBy("sid", "shard").agg(F.sum("n").alias("n"))


def _slots(planned: DataFrame, s: Settings) -> DataFrame:
    """One row per slot of the mix: ``shard``, ``slot``, ``sid``, ``block``, ``cut``."""
    counts = stored(_drawn(planned, s), "mix-counts")
    placed = _before(counts, ["sid"], "shard", "n", "number")
    placed = _before(placed, ["shard"], "sid", "n", "seat")
    # at most as many slots as a shard has; few narrow rows become many, so they are dealt out first
    tasks = max(planned.sparkSession.sparkContext.defaultParallelism, counts.count() // 1024)
    dealt = placed.join(planned, "sid").repartition(tasks, "sid", "shard")
    rows = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("k", F.col("number") + F.col("i")).withColumn("epoch", F.expr("k div blocks"))
    block = _permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("swaps")[F.col("epoch")])
    cut = F.when(F.col("k") == F.col("slots") - 1, F.col("cut")).otherwise(0)
    return rows.select("shard", (F.col("seat") + F.col("i")).alias("seat"), "sid", block.alias("block"), cut.cast("long").alias("cut"))


def mix(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of the rows of ``docs`` as shards of slots, each a block of a source's words; see :class:`Mix`.

    The mix has as many words as ``docs``. A source gives its target to the word: blocks, its last
    one shorter, and one slot that is cut where the target ends. No block, and so no word, is
    taken more than ``most`` times. The plan depends on ids, sources and sizes only and is the
    same on every run. A null text has no words and is never taken; a null source is a source of
    its own, a null id a value like any other; repeated rows stay separate, and equal ones share
    what is taken of them in some order. Very long documents span many blocks. An empty table,
    or one without words, gives an empty mix. Other columns are not read.
    """
    s = settings
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"))
    # rows that are equal here are equal for the mix: the hot ones become one row
    groups = stored(rows.groupBy("_id", "source", "size").agg(F.count("*").alias("copies")), "mix-groups")
    sources = stored(_sources(groups, s), "mix-plan")
    buckets = min(max(1, -(-groups.count() // BUCKET_ROWS)), MOST_BUCKETS)
    digest = F.md5(F.concat_ws("|", F.lit(s.seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("size")))
    keyed = groups.join(sources.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).select(
        "sid", "source", "_id", "size", "copies", (F.col("size") * F.col("copies")).alias("words"), digest.alias("digest"),
        F.floor(hex_long(digest, 1, 4) * buckets / 65_536).alias("bucket"),
    )
    # words before a document in its source: those of earlier buckets, and those before it in its bucket
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("words").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("digest", "size", "_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    laid = stored(laid.select("sid", "source", "_id", "size", "copies", (F.col("ahead") + F.col("inside")).alias("start")), "mix-order")
    hot = laid.where(F.col("copies") > COPIES)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    # pieces of a hot row are dealt out before they unfold
    dealt = hot.withColumn("piece", parts).repartition("sid", "start", "piece")
    pieces = laid.where(F.col("copies") <= COPIES).withColumn("piece", F.lit(0).cast("long")).unionByName(dealt)
    each = pieces.withColumn("copy", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + COPIES, "copies") - 1)))
    documents = each.select("sid", "source", F.col("_id").alias(id_col), "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    b = s.block_words
    planned = stored(_planned(sources, s), "mix-slots")
    slots = _slots(planned, s)
    # which words of which block belong to which document
    laid_out = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}L"), F.expr(f"(start + size - 1) div {b}L"))))
    met = laid_out.join(slots, ["sid", "block"]).join(sources.select("sid", "source_size"), "sid")
    begin = F.greatest(F.col("start"), F.col("block") * b)
    full = F.least((F.col("block") + 1) * b, F.col("source_size"))
    end = F.least(F.col("start") + F.col("size"), full - F.col("cut"))
    spans = met.select(
        "shard", F.col("seat").alias("slot"), (begin - F.col("block") * b).alias("place"), "sid", id_col, "start",
        (begin - F.col("start")).alias("first"), (end - begin).alias("length"),
    ).where("length > 0")
    return Mix(documents, sources, spans, id_col)
