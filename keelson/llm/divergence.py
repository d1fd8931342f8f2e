"""Source divergence audit: how far the term frequencies of sources lie apart, language by language.

One pass of ``bytes.translate`` lowers letters and blanks separators, ``bytes.split`` cuts the
terms, and a ``Counter`` per document gives its frequencies; counters are added up inside a task
up to a bound, so what is shuffled are sparse counts. Terms kept by document frequency become
smoothed integer shares, and shares are compared in exact integer arithmetic.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import stored, text_bytes

#: ASCII bytes other than letters separate terms; A-Z are lowered; bytes of other characters belong to terms.
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and distinct counts that a task holds before it passes them on.
CHUNK = 1 << 20
HELD = 200_000
#: Shares are counted in parts of this.
UNITS = 1_000_000_000
#: Numbers in the dense table of one block of terms.
BLOCK_CELLS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Documents of its language that a term must be in, and ranks of terms that are returned."""

    least_docs: int = 3
    top: int = 200


def term_counter(text: bytes) -> Counter:
    """Terms of one document with their frequencies."""
    blanked = text.translate(TABLE)
    if len(blanked) <= CHUNK:
        return Counter(blanked.split())
    found: Counter = Counter()
    at = 0
    while at < len(blanked):
        end = at + CHUNK
        if end < len(blanked):  # cut at a separator; a longer term is taken whole
            cut = blanked.rfind(b" ", at, end)
            if cut < 0:
                cut = blanked.find(b" ", end)
            end = len(blanked) if cut < 0 else cut + 1
        found.update(blanked[at:end].split())
        at = end
    return found


def _counts(docs: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``term``, ``count``, ``docs``) of tasks' parts; each group also has an empty term that counts nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], Counter] = defaultdict(Counter)
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def close() -> pa.RecordBatch:
            rows = [(lang, source, term, n, seen[lang, source][term]) for (lang, source), c in totals.items() for term, n in c.items()]
            rows += [(lang, source, b"", 0, 0) for lang, source in totals]
            totals.clear()
            seen.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "term", "count", "docs"]
            )

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = term_counter(text)
                total, docs_with = totals[lang, source], seen[lang, source]
                held -= len(total)
                total.update(own)
                docs_with.update(own.keys())
                held += len(total)
                if held >= HELD:
                    yield close()
                    held = 0
        if totals:
            yield close()

    parts = docs.mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column) -> Column:
    """1 + floor(UNITS (count + 1) / (n + v)), exact."""
    return 1 + F.expr(f"cast({UNITS} as decimal(38,0)) * ({count} + 1) div (n + v)")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(``lang``, ``source``, ``item``, ``value``): distances of all pairs of a language's sources, by blocks of terms.

    A block is a table of its terms by the language's sources; what it adds to each pair is summed over blocks.
    """
    parts = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v"))
    width = F.greatest(F.lit(1).cast("long"), F.expr(f"{BLOCK_CELLS}L div sources"))
    blocks = parts.where("v > 0").select("lang", F.expr("v").alias("terms"), (F.expr("v") / width).cast("long").alias("last"))
    number = F.pmod(F.xxhash64("term"), F.col("last") + 1).alias("block")
    cells = shares.join(blocks, "lang").select("lang", number, "term", "source", "p")
    sides = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), "source", "p0")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        sources = right.column("source").to_pylist()
        columns = {s: k for k, s in enumerate(sources)}
        terms = left.column("term").combine_chunks().dictionary_encode()
        floor = np.array(right.column("p0").to_pylist(), np.int64)
        table = np.repeat(floor[None, :], len(terms.dictionary), 0)
        table[terms.indices.to_numpy(), [columns[s] for s in left.column("source").to_pylist()]] = left.column("p").to_numpy()
        out = []
        for k in range(len(sources)):
            apart = table[:, k : k + 1] - table
            out.append((apart * apart // table).sum(axis=0))
        n = len(sources)
        lang = (left if left.num_rows else right).column("lang")[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * n * n, pa.string()),
                "source": pa.array([s for s in sources for _ in range(n)], pa.string()),
                "item": pa.array(sources * n, pa.string()),
                "value": pa.array(np.concatenate(out) if n else [], pa.int64()),
            }
        )

    found = cells.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(add, "lang string, source string, item string, value long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # the result itself has all pairs of a language's sources
    other = groups.select("lang", F.col("source").alias("item"))
    return groups.select("lang", "source").join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )


def audit(
    docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Rows (``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``).

    Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z lowered. A language
    keeps the V terms that are in at least ``least_docs`` of its documents. A group, which is a
    source within a language or the language, gives a kept term with c occurrences the share
    p = 1 + floor(10^9 (c + 1) / (N + V)), N its occurrences of kept terms. p lies apart from q
    by f = floor((p - q)^2 / q). Part ``pair`` has, for each source, each other source of the
    language with the sum of f over all kept terms (0 if none is kept); part ``term`` the terms
    that are more frequent in the source than in the language, by f, up to rank ``top``. Ranks
    go by value, larger first, then by the item's UTF-8.

    Null text, language or source are empty strings, and an empty language or source is one like
    any other. Repeated rows count each, also as documents. A group without terms still has its
    pairs. Very long texts are split piece by piece. An empty table gives an empty result; other
    columns are not read. Sums beyond 64 bits are an error.
    """
    named = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        text_bytes(text_col).alias("text"),
    )
    counts = stored(_counts(named), "term-counts")
    terms = counts.where("term <> X''").groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"))
    kept = stored(terms.where(F.col("docs") >= settings.least_docs).select("lang", "term", "all"), "kept-terms")
    inside = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "all"), "kept-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n"))
    sums = inside.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term = X''").select("lang", "source").join(sums, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0"))), "groups")
    shares = inside.join(groups, ["lang", "source"]).withColumn("p", _share("count"))
    pairs = _pairs(shares.select("lang", "source", "term", "p"), groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    whole = sizes.select("lang", "n", "v")
    base = kept.join(whole, "lang").select("lang", "term", _share("all").alias("q"))
    raised = shares.select("lang", "source", "term", "p").join(base, ["lang", "term"]).where("p > q")
    raised = raised.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = raised.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
