"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A passage counts as leaked when it is within a fifth of the item's words in edit distance. The CGK walk copies a sequence symbol by symbol and at each step moves
on or stays by a random bit of the symbol; sequences at a small edit distance end up at a small
Hamming distance, so keys made of a few sampled places collide. Several walks and samples bring
the recall to the target, and the edit distance itself decides.

Windows are of an item's size. A passage of n words within k edits shares n - 2 - 3k runs of three
words with the item, so only windows that line up with a shared run, and hold so many of them, are
embedded; this loses none. Items of one or two words allow no edit and are looked up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import small, stored, text_bytes
from keelson.llm.shingles import FOLD, Members, mix, randoms, shingle_hashes, word_hashes

RUN = 3
ITEM_END, WINDOW_END = 0, 1


@dataclass(frozen=True)
class Settings:
    """Edits allowed per word of an item; walks, samples per walk and places per sample of the LSH."""

    edits: float = 0.2
    walks: int = 8
    samples: int = 12
    places: int = 2
    #: words of the shortest item that is searched
    shortest: int = 1
    #: bytes of item texts that one pass holds; more items are searched in several passes
    block_bytes: int = 16_000_000

    def steps(self, n: int) -> int:
        """Steps of a walk over n words; few walks have ended by then, as one passes a word in two steps."""
        return 3 * n // 2

    def allowed(self, n: int) -> int:
        """Edits for n words, at most so many that a run of three words must stay whole."""
        return max(0, min(int(self.edits * n), (n - RUN) // RUN))


def closest(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the substring of ``text`` closest to ``item``, if within ``most`` edits.

    Levenshtein distance with free ends in the text; of equally close ones the first to end, the shortest.
    """
    m = len(text)
    steps = np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), steps.copy()
    for i, word in enumerate(item.tolist()):
        skip, swap = row[1:] + 1, row[:-1] + (text != np.uint64(word))
        change = np.concatenate(([i + 1], np.minimum(skip, swap)))
        source = np.concatenate(([0], np.where(swap <= skip, origin[:-1], origin[1:])))
        # insertions run along the row: the best so far of value minus place
        level = change - steps
        best = np.minimum.accumulate(level)
        fresh = np.flatnonzero(np.concatenate(([True], level[1:] < best[:-1])))
        origin = source[fresh[np.searchsorted(fresh, steps, "right") - 1]]
        row = best + steps
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(origin[end]), end) if row[end] <= most else None


class Index:
    """Items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[object, bytes]], s: Settings) -> None:
        self.s = s
        read = [(name, word_hashes(text, FOLD)[0]) for name, text in items]
        read = [(name, words) for name, words in read if len(words) >= max(1, s.shortest)]
        read.sort(key=lambda item: len(item[1]) < RUN)  # short items last: they have no runs
        self.ids = [name for name, _ in read]
        self.sizes = [len(words) for _, words in read]
        self.words = [words for _, words in read if len(words) >= RUN]
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in range(len(self.words), len(read)):
            whole = int(shingle_hashes(read[i][1], self.sizes[i])[0])
            self.short.setdefault(self.sizes[i], {}).setdefault(whole, []).append(i)
        self.short_members = {n: Members(np.array(list(wholes), np.uint64)) for n, wholes in self.short.items()}
        runs = [shingle_hashes(w, RUN) for w in self.words]
        sizes = [len(r) for r in runs]
        self.members = Members(np.concatenate(runs) if runs else np.zeros(0, np.uint64))
        flat = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.run_hash = flat[order]
        self.run_item = np.repeat(np.arange(len(runs)), sizes)[order]
        self.run_at = np.concatenate([np.arange(n) for n in sizes])[order] if runs else np.zeros(0, np.int64)
        self.length = max((len(w) for w in self.words), default=0)
        self.bits = randoms(s.walks * max(1, s.steps(self.length)), 41).reshape(s.walks, -1)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([len(w) - RUN + 1 - RUN * s.allowed(len(w)) for w in self.words], np.int64)
        self.keys: dict[int, list[int]] = {}
        if self.words:
            for i, own in enumerate(self.lsh(self.words, ITEM_END)):
                for key in own.tolist():
                    self.keys.setdefault(key, []).append(i)

    def embed(self, windows: list[np.ndarray], end: int) -> np.ndarray:
        """CGK walks: (window, walk, step) symbols over ``s.steps`` of the longest window; ``end`` follows the last word."""
        longest = max(len(w) for w in windows)
        padded = np.full((len(windows), longest + 1), np.uint64(end))
        for k, w in enumerate(windows):
            padded[k, : len(w)] = w
        ends = np.array([len(w) for w in windows])[:, None]
        at = np.zeros((len(windows), self.s.walks), np.int64)
        out = np.zeros((len(windows), self.s.walks, self.s.steps(longest)), np.uint64)
        rows = np.arange(len(windows))[:, None]
        for step in range(out.shape[2]):
            symbol = padded[rows, np.minimum(at, ends)]
            out[:, :, step] = symbol
            move = mix(symbol ^ self.bits[:, step][None, :]) & np.uint64(1)
            at = np.minimum(at + move.astype(np.int64), ends)
        return out

    def lsh(self, windows: list[np.ndarray], end: int) -> list[np.ndarray]:
        """Keys of each window; places are sampled for its own length, so only equal lengths meet.

        Items and windows have different ``end`` symbols: a place behind the end of a walk agrees with nothing.
        """
        s = self.s
        walked = self.embed(windows, end)
        keys = []
        for k, w in enumerate(windows):
            n = s.steps(len(w))
            places = (randoms(s.walks * s.samples * s.places, 100 + len(w)) % np.uint64(n)).astype(np.int64).reshape(s.walks, s.samples, s.places)
            own = np.full((s.walks, s.samples), np.uint64(len(w)))
            own += (np.arange(s.walks * s.samples, dtype=np.uint64) << np.uint64(20)).reshape(own.shape)
            for j in range(s.places):
                own = mix(own ^ walked[k, np.arange(s.walks)[:, None], places[:, :, j]])
            keys.append(own.reshape(-1))
        return keys

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, first byte, end byte, edits) of each leaked passage: the closest window of each item and place."""
        words, starts, ends = word_hashes(text, FOLD)
        kept = self.search_short(words, starts, ends) + self.search_long(words, starts, ends)
        return sorted(kept, key=lambda m: (m[1], m[0]))

    def search_short(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The places of items below the length of a run, overlapping ones of an item once."""
        kept = []
        for n, wholes in self.short.items():
            grams, free = shingle_hashes(words, n), {}
            for at in self.short_members[n].positions(grams).tolist():
                for i in wholes[int(grams[at])]:
                    if at >= free.get(i, 0):
                        free[i] = at + n
                        kept.append((i, int(starts[at]), int(ends[at + n - 1]), 0))
        return kept

    def search_long(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The passages near an item that has runs."""
        runs = shingle_hashes(words, RUN)
        near = self.members.positions(runs)
        if not len(near):
            return []
        low = np.searchsorted(self.run_hash, runs[near], "left")
        many = np.searchsorted(self.run_hash, runs[near], "right") - low
        # every meeting of a run of the text with a run of an item
        meets = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        items, spots = self.run_item[meets], np.repeat(near, many)
        enough = np.bincount(items, minlength=len(self.need)) >= self.need
        found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        pick = enough[items]
        windows: list[tuple[int, int]] = []
        for i in np.unique(items[pick]).tolist():
            own = pick & (items == i)
            n, spare, at = int(self.lengths[i]), self.s.allowed(int(self.lengths[i])), spots[own]
            firsts = np.unique(np.clip(at - self.run_at[meets[own]], 0, max(0, len(words) - n)))
            held = np.searchsorted(at, firsts + n + spare, "right") - np.searchsorted(at, firsts - spare, "left")
            windows += [(first, n) for first in firsts[held >= self.need[i]].tolist()]
        windows = sorted(set(windows))
        for at in range(0, len(windows), 512):
            part = windows[at : at + 512]
            cut = [np.resize(words[first : first + n], n) for first, n in part]
            for (first, n), keys in zip(part, self.lsh(cut, WINDOW_END)):
                for i in {i for key in keys.tolist() for i in self.keys.get(key, ()) if enough[i]}:
                    most = self.s.allowed(n)
                    begin = max(0, first - 2 * most)
                    match = closest(self.words[i], words[begin : first + n + 2 * most], most)
                    if match and match[2] > match[1]:
                        edits, a, b = match[0], begin + match[1], begin + match[2]
                        found[i, a] = min(found.get((i, a), (i, 0, 0, most + 1)), (i, int(starts[a]), int(ends[b - 1]), edits), key=lambda m: m[3])
        kept: list[tuple[int, int, int, int]] = []
        for match in sorted(found.values(), key=lambda m: (m[0], m[3], m[1])):
            if not any(m[0] == match[0] and m[1] < match[2] and match[1] < m[2] for m in kept):
                kept.append(match)
        return kept


def _blocks(spark: SparkSession, items: DataFrame, s: Settings, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size, each text once under its smallest id."""
    texts = items.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).groupBy("text").agg(F.min("id").alias("id"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // s.block_bytes) or 1
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    if blocks > 1:
        numbered = stored(numbered, "items")
    for block in range(blocks):
        yield [(r["id"], bytes(r["text"])) for r in numbered.where(F.col("block") == block).select("id", "text").collect()]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per leaked passage: id, ``item_id``, ``start``, ``end`` (bytes in the UTF-8 text), ``edits``, ``similarity``.

    Words are folded to lower case and ASCII punctuation separates them. Items of one or two words must
    be in the text as they are, items of fewer than ``settings.shortest`` words and those without a word
    are not searched; of equal items each id gets its row. Documents without a leak,
    null and empty texts give no row; repeated rows give theirs each; null ids stay null; an empty
    table on either side gives an empty result; other columns are not read. The items reach the
    tasks in blocks of bounded size, one pass over the documents per block.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = f"id {kind}, item_id {item_kind}, start long, end long, edits int, similarity double"
    found = None
    for block in _blocks(spark, items, settings, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, settings)
            item_type = pa.array([name for name, _ in shared.value]).type
            for batch in batches:
                out = []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    out += [(row, index.ids[i], a, b, e, 1 - e / index.sizes[i]) for i, a, b, e in index.search(text)]
                if not out:
                    continue
                at, *rest = zip(*out)
                kinds = [item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))],
                    ["id", "item_id", "start", "end", "edits", "similarity"],
                )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return _every_name(found, items, item_id, item_text).withColumnRenamed("id", id_col)


def _every_name(found: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each id of an item text that is there under several ids; they are found under the smallest."""
    pairs = items.select(F.col(id_col).alias("_name"), text_bytes(text_col).alias("_text")).where("_name IS NOT NULL AND octet_length(_text) > 0").distinct()
    shared = pairs.groupBy("_text").agg(F.min("_name").alias("_first"), F.count(F.lit(1)).alias("_ids")).where("_ids > 1")
    names = stored(pairs.join(shared, "_text").select("_first", "_name"), "item-names")
    count = names.count()
    if not count:
        return found
    named = found.join(small(names, count), found["item_id"] == names["_first"], "left")
    return named.select("id", F.coalesce("_name", "item_id").alias("item_id"), "start", "end", "edits", "similarity")


def drop_leaked(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id holds no leaked passage, all columns unchanged; rows with a null id stay."""
    leaks = find_leaks(docs, items, settings, id_col, text_col).select(F.col(id_col).alias("_gone")).where("_gone IS NOT NULL").distinct()
    leaks = stored(leaks, "leaks")
    leaks = small(leaks, leaks.count())
    return docs.join(leaks, docs[id_col] == leaks["_gone"], "left_anti")


def _clean(shared: Broadcast, settings: Settings, text: Column) -> Column:
    """Whether the text holds no passage of the items."""

    @arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, settings)
        for texts in batches:
            yield pa.array([not index.search(text) for text in texts.to_pylist()], pa.bool_())

    return clean(text)


def keep_clean(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose text holds no leaked passage, all columns unchanged; each row is judged by its own text, whatever its id.

    Null and empty texts and repeated rows stay as they are; an empty table on either side drops nothing.
    A word or two say nothing about a leak, so items below the length of a run are left out here.
    """
    spark = docs.sparkSession
    settings = replace(settings, shortest=max(RUN, settings.shortest))
    for block in _blocks(spark, items, settings, item_id, item_text):
        docs = docs.where(_clean(spark.sparkContext.broadcast(block), settings, text_bytes(text_col)))
    return docs
