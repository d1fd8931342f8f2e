"""Quality rules: plain counts of words and repeats, and the fertility of a public tokeniser.

Fertility: characters per token, share of byte-fallback tokens and entropy of the
tokens. Prose in a language that the vocabulary knows keeps within a band of each;
noise, mark-up residue and endless repeats leave it. Bands belong to a language and,
where no language is named, to the script of the text.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import small, stored, text_bytes
from keelson.llm.vocab import piece_vocab


@dataclass(frozen=True)
class Band:
    """Accepted range of each measure; entropy is the share of the most that so many tokens could have."""

    chars_low: float
    chars_high: float
    byte_high: float
    entropy_low: float


#: Wide bands per language code or script name, where nothing was measured; ``*`` for all others.
BANDS: dict[str, Band] = {
    "latin": Band(1.3, 8.0, 0.15, 0.35),
    "cyrillic": Band(1.2, 7.0, 0.20, 0.45),
    "greek": Band(0.8, 6.0, 0.50, 0.40),
    "cjk": Band(0.4, 4.0, 0.80, 0.40),
    "*": Band(0.3, 10.0, 0.95, 0.35),
}

# fixed values: code point ranges that stand for a script
_SCRIPTS = (
    ("latin", re.compile("[A-Za-zÀ-ɏ]")),
    ("cyrillic", re.compile("[Ѐ-ӿ]")),
    ("greek", re.compile("[Ͱ-Ͽ]")),
    ("cjk", re.compile("[぀-ヿ㐀-鿿가-힯]")),
)
_SYMBOLS = tuple(c.encode() for c in "#*$%&|<>")
_SPACES = tuple(bytes([c]) for c in b" \t\n\x0b\x0c\r")
RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "chars_per_token:double,byte_share:double,token_entropy:double,base_failed:boolean,kept:boolean>"
)

MEASURES = RESULT.replace("kept:boolean", "script:string")
#: Good rows of a language at which its measured band weighs as much as the wide band of its script.
PRIOR = 100


def script_of(text: str) -> str:
    """The script of most letters; ``*`` without any of those known."""
    name, pattern = _SCRIPTS[0]
    first = len(pattern.findall(text))
    if 2 * first > len(text):
        return name
    counts = [(first, name), *((len(pattern.findall(text)), name) for name, pattern in _SCRIPTS[1:])]
    best = max(counts, key=lambda c: c[0])
    return best[1] if best[0] else "*"


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def fertility(text: bytes, ids: np.ndarray, n_chars: int, vocab) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, entropy as a share of log2(number of tokens)."""
    ids = np.sort(ids)
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    c = np.diff(np.append(first, n))
    # line feeds have no piece of their own and say nothing about the language
    odd = int(c[vocab.is_byte[ids[first]]].sum()) - text.count(b"\n")
    entropy = float(np.log2(n) - (c * np.log2(c)).sum() / n)
    return n_chars / n, max(odd, 0) / n, entropy / max(float(np.log2(n)), 1.0)


def measures(text: bytes, ids: np.ndarray, vocab) -> tuple:
    """All measures of ``RESULT`` but the last, of a text and its token ids."""
    words = text.split()
    n = len(words)
    # code points are the bytes that continue none; white space is ASCII here
    chars = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    word_chars = chars - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    repeated = repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    return n, word_chars, symbols, duplicate_lines(text), repeated, *fertility(text, ids, chars, vocab), failed


def accepts(band: Band, per_token: float, byte_share: float, entropy: float) -> bool:
    return band.chars_low <= per_token <= band.chars_high and byte_share <= band.byte_high and entropy >= band.entropy_low


def judge(text: bytes, ids: np.ndarray, lang: str | None, vocab, bands: dict[str, Band]) -> tuple:
    found = measures(text, ids, vocab)
    band = bands.get(lang) if lang else None
    if band is None:
        band = bands.get(script_of(text.decode("utf-8", "replace")), bands["*"])
    return *found, not found[8] and accepts(band, *found[5:8])


def _struct(rows: list[tuple], ddl: str) -> pa.Array:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [part.split(":") for part in ddl[7:-1].split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def verdict(text: Column, lang: Column, path: str, bands: dict[str, Band] = BANDS) -> Column:
    """All measures of a binary text column as one struct."""

    @arrow_udf(RESULT)
    def measure(texts: pa.Array, langs: pa.Array) -> pa.Array:
        vocab = piece_vocab(path)
        plain = [t or b"" for t in texts.to_pylist()]
        return _struct([judge(t, ids, l, vocab, bands) for t, ids, l in zip(plain, vocab.encode_all(plain), langs.to_pylist())], RESULT)

    return measure(text, lang)


def measure_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(``_id``, ``_lang``, ``_v``) per row, written once, so each text is encoded once: ``_v`` has the measures and the script."""

    @arrow_udf(MEASURES)
    def measure(texts: pa.Array) -> pa.Array:
        vocab = piece_vocab(path)
        plain = [t or b"" for t in texts.to_pylist()]
        return _struct([(*measures(t, ids, vocab), script_of(t.decode("utf-8", "replace"))) for t, ids in zip(plain, vocab.encode_all(plain))], MEASURES)

    return stored(docs.select(F.col(id_col).alias("_id"), _lang(docs, lang_col).alias("_lang"), measure(text_bytes(text_col)).alias("_v")), "quality-measures")


def _good(labels: DataFrame, id_col: str) -> DataFrame:
    """Ids that ``labels`` calls good (``quality`` = 1), each once."""
    return labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()


def bands_of(measured: DataFrame) -> dict[str, Band]:
    """Bands per language of the rows of ``measure_rows``, all of them good.

    A band begins half the distance from the median to the outer 1 % quantile beyond that
    quantile: good documents stay inside with room. It is then drawn to the wide band of the
    script of most of the language's rows: of n rows the measured band has the weight
    n / (n + PRIOR), so a language with few rows moves off the script's band row by row and
    there is no number of rows at which the rules switch. One row per language reaches the driver.
    """
    cuts = F.array(*(F.lit(q) for q in (0.01, 0.5, 0.99)))
    scripts = [name for name, _ in _SCRIPTS]
    found = (
        measured.where(~F.col("_v.base_failed") & F.col("_lang").isNotNull())
        .groupBy("_lang")
        .agg(
            F.count("*").alias("n"),
            *(F.count_if(F.col("_v.script") == name).alias(name) for name in scripts),
            F.percentile_approx("_v.chars_per_token", cuts, F.lit(10_000)).alias("chars"),
            F.percentile_approx("_v.byte_share", cuts, F.lit(10_000)).alias("bytes"),
            F.percentile_approx("_v.token_entropy", cuts, F.lit(10_000)).alias("entropy"),
        )
    )
    bands = dict(BANDS)
    low = lambda q: q[0] - (q[1] - q[0]) / 2
    high = lambda q: q[2] + (q[2] - q[1]) / 2
    for row in found.collect():
        script = max(scripts, key=lambda name: row[name])
        wide = BANDS[script if row[script] else "*"]
        weight = row["n"] / (row["n"] + PRIOR)
        own = Band(low(row["chars"]), high(row["chars"]), max(high(row["bytes"]), 0.05), low(row["entropy"]))
        bands[row["_lang"]] = Band(*(weight * x + (1 - weight) * y for x, y in zip(astuple(own), astuple(wide))))
    return bands


def fit_bands(docs: DataFrame, labels: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Band]:
    """Bands per language, measured on all documents that ``labels`` calls good (``bands_of``); the wide default bands for the others."""
    good = stored(_good(labels, id_col), "quality-good")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = texts.join(small(good, good.count()), "_id", "left_semi")
    return bands_of(measure_rows(rows, path, "_id", "_text", "_lang"))


def _lang(docs: DataFrame, lang_col: str | None) -> Column:
    return F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")


def quality_rules(
    docs: DataFrame, path: str, bands: dict[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """One row per row of ``docs`` with all counts, the fertility measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rule. Without a language (null,
    or one without bands) the script of the text chooses the bands. Repeated rows are
    judged each, other columns are not read, an empty table gives an empty result.
    Texts are judged whole, whatever their length.
    """
    judged = docs.select(F.col(id_col), verdict(text_bytes(text_col), _lang(docs, lang_col), path, bands).alias("_v"))
    return judged.select(id_col, "_v.*")


def keep_good(docs: DataFrame, path: str, bands: dict[str, Band] = BANDS, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    return docs.where(verdict(text_bytes(text_col), _lang(docs, lang_col), path, bands)["kept"])


def fitted_rules(
    docs: DataFrame, labels: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """``quality_rules`` with the bands that ``fit_bands`` measures on the same ``docs``; each text is encoded once for both."""
    measured = measure_rows(docs, path, id_col, text_col, lang_col)
    good = _good(labels, id_col)
    # a null text has no words: it fails the base rule and is in no band
    bands = bands_of(measured.join(good, "_id", "left_semi"))

    @arrow_udf("boolean")
    def keeps(langs: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for lang, v in zip(langs.to_pylist(), found.to_pylist()):
            band = (bands.get(lang) if lang else None) or bands.get(v["script"], bands["*"])
            out.append(not v["base_failed"] and accepts(band, v["chars_per_token"], v["byte_share"], v["token_entropy"]))
        return pa.array(out, pa.bool_())

    return measured.select(F.col("_id").alias(id_col), "_v.*", keeps("_lang", "_v").alias("kept")).drop("script")
