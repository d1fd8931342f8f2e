"""Near-duplicate documents: MinHash bands find candidates, odd sketches estimate them, full sets decide.

Documents with the same shingle set are one class from the start. Bands of MinHash values
put classes into buckets. A class is first compared with one member of each bucket (its
leader), so a large group of near copies joins up in linear work; of what is then still apart
inside a bucket, only pairs that can share enough shingles are compared. A candidate is
estimated by the odd sketch, a bitmap in which every MinHash sample flips one bit, and
confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import small, stored, text_bytes
from keelson.llm.graph import components
from keelson.llm.shingles import batch_words, mix, randoms, shingle_set
from keelson.llm.vocab import release


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, similarity in percent, bands and rows of the signature.

    46 bands of 7 miss a pair at a similarity of 0.8 twice in a hundred thousand
    ((1 - 0.8^7)^46) and bring one at 0.4 together in 7 of a hundred cases; ``most_flips``
    lets through a sketch estimate almost five deviations low.
    """

    words: int = 5
    percent: int = 80
    bands: int = 46
    rows: int = 7
    most_flips: int = 150

    @property
    def samples(self) -> int:
        return self.bands * self.rows


SKETCH_LONGS = 8
#: Classes at most that have a rare shingle.
RARE = 8
SIGNATURES = "id long, key long, n_shingles long, set_id binary, bands array<long>, sketch array<long>"


class Signer:
    """MinHash bands and odd sketch of shingle sets."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        self.factors = randoms(s.samples, 11) | np.uint64(1)
        self.shifts = randoms(s.samples, 12)
        self.salts = randoms(s.samples, 13)
        self.band_salts = randoms(s.bands, 14)

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(self.s.samples, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(values), 2048):
            part = values[at : at + 2048, None] * self.factors + self.shifts
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def sign(self, values: np.ndarray) -> tuple[list[int], list[int]]:
        best = self.minima(values)
        bands = self.band_salts.copy()
        for row in best.reshape(self.s.bands, self.s.rows).T:
            bands = mix(bands ^ row)
        flips = np.bincount((mix(best ^ self.salts) & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
        sketch = np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")
        return bands.view(np.int64).tolist(), sketch.tolist()


def _signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row: id, key, set size, set digest; bands and sketch where there is a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # no vocabulary is needed here
        signer = Signer(s)
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for words in batch_words(batch.column(2).to_pylist()):
                values = shingle_set(words, s.words)
                sizes.append(len(values))
                if len(values):
                    digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    band, sketch = signer.sign(values)
                else:
                    digests.append(None)
                    band = sketch = None
                bands.append(band)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                ["id", "key", "n_shingles", "set_id", "bands", "sketch"],
            )

    return docs.select("id", "key", "text").mapInArrow(run, SIGNATURES)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(``set_id``, ``shingles``) of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for hashes in batch_words(batch.column(1).to_pylist()):
                values = shingle_set(hashes, words)
                if len(values):
                    found[hashlib.blake2b(values.tobytes(), digest_size=16).digest()] = values.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["set_id", "shingles"]
            )

    return docs.select("id", "text").mapInArrow(run, "set_id binary, shingles array<long>").dropDuplicates(["set_id"])


def _flips(a: str, b: str) -> Column:
    """Bits in which two odd sketches differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_LONGS)))


def _alike(a: str, b: str, s: Settings) -> Column:
    """Sizes that allow the similarity, and sketches that make it likely."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(na, nb) >= s.percent * F.greatest(na, nb)) & (_flips(a, b) <= s.most_flips)


class _Search:
    """Links between classes; ``classes`` has node, set_id, id, n_shingles, bands, sketch."""

    def __init__(self, docs: DataFrame, classes: DataFrame, s: Settings) -> None:
        self.docs, self.classes, self.s = docs, classes, s
        self.sketches = classes.select("node", "n_shingles", "sketch")

    def postings(self) -> DataFrame:
        """(key, node, n) of the buckets with n > 1 classes."""
        all_keys = self.classes.select(F.explode("bands").alias("key"), "node")
        shared = all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return stored(all_keys.join(shared, "key"), "postings")

    def leaders(self, postings: DataFrame) -> DataFrame:
        """(key, leader): of each bucket the member that shares buckets with most others.

        In a group of near copies the text they were made from agrees with most of them in most
        bands, so it leads, and its copies, which may be too far from each other, all meet it.
        """
        known = postings.groupBy("node").agg(F.sum("n").alias("met"))
        most = F.max(F.struct("met", "node")).alias("l")
        return postings.join(known, "node").groupBy("key").agg(most).select("key", F.col("l.node").alias("leader"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(``node``, ``shingles``) of the classes in ``nodes``, from a text of each."""
        wanted = stored(self.classes.select("node", "set_id", "id").join(nodes, "node", "left_semi"), "candidates")
        texts = self.docs.join(wanted.where("id IS NOT NULL").select("id"), "id", "left_semi").union(self.docs.where("id IS NULL"))
        return stored(_sets(texts, self.s.words).join(wanted.select("set_id", "node"), "set_id").select("node", "shingles"), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full sets reach the similarity."""
        pairs = stored(pairs.select("a", "b"), "pairs")
        if sets is None:
            ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
            sets = self.sets(ends.distinct())
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        total = F.size("x") + F.size("y") - shared
        both = left.join(pairs, "a").join(right, "b")
        return stored(both.where(100 * shared >= self.s.percent * total).select("a", "b"), "links")

    def led(self, members: DataFrame) -> DataFrame:
        """Pairs of each member (key, node, leader) with its best leader, by the sketches."""
        a, b = self.sketches.alias("a"), self.sketches.alias("b")
        tried = members.where("node <> leader").select("node", "leader").distinct().alias("t")
        near = tried.join(a, F.col("a.node") == F.col("t.node")).join(b, F.col("b.node") == F.col("t.leader")).where(_alike("a", "b", self.s))
        best = near.groupBy(F.col("t.node").alias("a")).agg(F.min(F.struct(_flips("a", "b").alias("flips"), F.col("t.leader").alias("leader"))).alias("best"))
        return best.select("a", F.col("best.leader").alias("b"))

    def apart(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, flips): pairs inside buckets that can still link, one side outside the bucket's largest component.

        ``members`` has key, node, component, major. Shingles that few of the members' classes have
        are rare, the others common. Two classes share at most the smaller of their numbers of common
        shingles and as many rare ones as an index of the rare shingles says, so copies of one text,
        each with changes of its own, are told apart without comparing their sets. What this bound
        and the sketches leave is a pair, in the first bucket that both are in.
        """
        each = sets.select("node", F.explode("shingles").alias("shingle"))
        rare = each.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE).select("shingle")
        held = stored(each.join(rare, "shingle").select("shingle", "node"), "rare-shingles")
        own = held.groupBy("node").agg(F.count("*").alias("rare"))
        buckets = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
        known = self.sketches.join(buckets, "node").join(own, "node", "left").withColumn("common", F.col("n_shingles") - F.coalesce("rare", F.lit(0)))
        known = stored(known.drop("rare"), "open-classes")
        full = stored(members.join(known, "node"), "open-postings")
        a, b = full.where("component <> major").alias("a"), full.alias("b")
        once = (F.col("b.component") == F.col("b.major")) | (F.col("a.node") < F.col("b.node"))
        sizes = F.col("a.n_shingles") + F.col("b.n_shingles")
        # a similarity of s percent needs s / (100 + s) of both sizes in common
        reach = lambda shared: (100 + self.s.percent) * shared >= self.s.percent * sizes
        fewer = F.least("a.common", "b.common")
        first = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once
        ends = (F.col("a.node").alias("a"), F.col("b.node").alias("b"), _flips("a", "b").alias("flips"))
        plain = a.join(b, on & reach(fewer) & _alike("a", "b", self.s) & first).select(*ends)
        # rare shingles by the classes that have them: runs of one passage make one list
        lists = held.groupBy("shingle").agg(F.array_sort(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
        lists = stored(lists.groupBy("nodes").agg(F.count("*").alias("n")), "rare-lists")
        one = lists.select("nodes", "n", F.posexplode("nodes").alias("i", "a"))
        two = one.select("a", "n", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(RARE))).alias("b"))
        share = two.groupBy("a", "b").agg(F.sum("n").alias("n")).alias("r")
        part = members.select("node", "component").distinct()
        x, y = known.join(part, "node").alias("a"), known.join(part, "node").alias("b")
        met = share.join(x, F.col("a.node") == F.col("r.a")).join(y, F.col("b.node") == F.col("r.b")).where(
            (F.col("a.component") != F.col("b.component")) & reach(F.col("r.n") + fewer) & _alike("a", "b", self.s)
        )
        return stored(plain.union(met.select(*ends)).distinct(), "apart")

    def links(self) -> DataFrame:
        """Pairs (a, b) that connect what the similarity connects.

        First every class meets the best leader of its buckets. Buckets that then still hold more
        than one component are searched for all pairs that can link, and these are compared.
        """
        postings = self.postings()
        if postings.isEmpty():
            return postings.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
        confirmed = [self.confirm(self.led(postings.join(self.leaders(postings), "key")))]
        found, n = components(confirmed[0])
        placed = postings.join(small(found.withColumnRenamed("component", "of"), n), "node", "left")
        placed = placed.select("key", "node", F.coalesce("of", "node").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        keys = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"))
        open_keys = stored(keys.where("parts > 1").select("key", F.col("most.component").alias("major")), "open")
        members = stored(placed.join(open_keys, "key"), "members")
        if members.isEmpty():
            return confirmed[0]
        sets = self.sets(members.select("node").distinct())
        confirmed.append(self.confirm(self.apart(members, sets), sets))
        return reduce(DataFrame.union, confirmed)


def _classified(plain: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Of ``plain`` (id, text, key): its rows (id, key, n_shingles, set_id), and the classes of equal
    sets (set_id, id, first, component); ``first`` is the row with the smallest id, nulls last, then key."""
    signed = stored(_signatures(plain, settings), "signatures")
    some = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("first")
    merged = some.groupBy("set_id").agg(F.min("id").alias("id"), first, *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    classes = stored(merged.withColumn("node", F.monotonically_increasing_id()), "classes")
    found, n = components(_Search(plain, classes, settings).links())
    joined = classes.select("set_id", "id", "first", "node").join(small(found, n), "node", "left")
    return signed.select("id", "key", "n_shingles", "set_id"), joined.select("set_id", "id", "first", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of other than ASCII white space, A-Z lower-cased; the set of a document holds
    its distinct shingles, or its whole sequence where it has fewer words. A null, empty or blank
    text has no set and is linked with nothing: its component is its own id. ``component_id`` is
    the smallest id reachable; ``kept`` marks the row with that id (of repeated rows with one id,
    each). A null id is never smallest; rows linked only among null ids have a null component and
    are kept. An empty table gives an empty result; other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), F.lit(0).cast("long").alias("key"))
    rows, joined = _classified(plain, settings)
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = joined.join(smallest, "component").select("set_id", "component_id")
    out = rows.drop("key").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col(id_col).isNull() & F.col("component_id").isNull())
    )


def keep_first(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", repeats: bool = True
) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns unchanged.

    The first row is the one with the smallest id, nulls last. Every row is judged by its own text,
    whatever its id, and of rows with null ids one stays as well. With ``repeats`` the rows of the
    component that have the same id as the first one stay with it; without, exactly one row of each
    component does. Rows without a set are linked with nothing and stay.
    """
    key = "_key"
    while key in docs.columns:
        key = f"_{key}"
    # written once with its key, which holds for all that follows
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    plain = keyed.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), F.col(key).alias("key"))
    rows, classes = _classified(plain, settings)
    best = classes.groupBy("component").agg(F.min("first").alias("best"))
    some = rows.where("n_shingles > 0")
    stay = best.select("best.key")
    if repeats:
        named = classes.join(best, "component").select("set_id", F.col("best.id").alias("least"))
        stay = stay.union(some.join(named, "set_id").where("id = least").select("key"))
    gone = stored(some.select("key").join(stay, "key", "left_anti").withColumnRenamed("key", key), "dropped")
    return keyed.join(small(gone, gone.count()), key, "left_anti").select(*docs.columns)
