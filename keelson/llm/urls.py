"""URL filters: longest-prefix rules first, gradient-boosted trees on lexical features for the rest.

Features of the text of a URL alone: lengths, path depth, digit share, character entropy,
query parameters, hyphens, and how often labelled URLs under the same host suffix were bad.
All features are SQL expressions; the trees are Spark ML's and are trained here from
labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """Host (with its subdomains) and path prefix; ``allow`` or block."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` and the path after it; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.char_length(host) + 1)
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null. For lists that fit into an expression."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def _share(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")) / F.greatest(F.char_length(text), F.lit(1))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.char_length(text)
    terms = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c == "", 0.0).otherwise((n - F.char_length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1))),
    )
    return F.aggregate(terms, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy", "params", "query_length", "suffix_odds"]


def with_features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``_host``, ``_path``, ``_suffix`` and the lexical features (all but ``suffix_odds``)."""
    host, path = host_path(F.col(url_col))
    split = urls.withColumns({"_url": F.coalesce(F.col(url_col), F.lit("")), "_host": host, "_path": path})
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    h, p, u = F.col("_host"), F.col("_path"), F.col("_url")
    return split.withColumns(
        {
            "_suffix": F.substring_index("_host", ".", -1),
            "url_length": F.char_length(u).cast("double"),
            "host_length": F.char_length(h).cast("double"),
            "path_length": F.char_length(p).cast("double"),
            "depth": (F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))).cast("double"),
            "labels": (F.char_length(h) - F.char_length(F.replace(h, F.lit("."), F.lit("")))).cast("double"),
            "digits": _share(u, "[^0-9]"),
            "host_digits": _share(h, "[^0-9]"),
            "hyphens": (F.char_length(h) - F.char_length(F.replace(h, F.lit("-"), F.lit("")))).cast("double"),
            "entropy": entropy(u),
            "host_entropy": entropy(h),
            "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "query_length": F.char_length(query).cast("double"),
        }
    )


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    prior: float

    def block_probability(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds ``_block``; without trained trees nothing is blocked."""
        rows = with_features(urls, url_col)
        # at most one row per suffix of the bounded sample
        rows = rows.join(F.broadcast(self.suffixes), "_suffix", "left").fillna({"suffix_odds": self.prior})
        if self.trees is None:
            return rows.withColumn("_block", F.lit(0.0)).drop(*FEATURES)
        vector = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
        scored = self.trees.transform(vector)
        return scored.withColumn("_block", vector_to_array("probability")[1]).drop(*FEATURES, "_features", "probability", "rawPrediction", "prediction")


def fit(labelled: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 3, seed: int = 17) -> UrlModel:
    """Train on ``labelled`` (``url``, ``bad`` 0/1). At most ``sample`` rows are used: those with the
    smallest digest of the URL, the same on every run. Classes are weighted to equal sums. With
    one class only there are no trees, and every URL passes."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("url", F.col("bad").cast("double").alias("bad"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "bad").limit(sample)
    rows = stored(with_features(rows).drop("_url", "_path"), "urls")
    bad, total = rows.agg(F.sum("bad"), F.count("*")).first()
    bad = bad or 0.0
    prior = float(_log_odds(bad, total))
    odds = F.log((F.sum("bad") + 1) / (F.count("*") - F.sum("bad") + 1))
    suffixes = stored(rows.groupBy("_suffix").agg(odds.alias("suffix_odds")), "suffixes")
    if not 0 < bad < total:
        return UrlModel(None, suffixes, prior)
    weighted = rows.join(F.broadcast(suffixes), "_suffix").withColumn(
        "_weight", F.when(F.col("bad") == 1, total / (2.0 * bad)).otherwise(total / (2.0 * (total - bad)))
    )
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(weighted).select("_features", "bad", "_weight").coalesce(4)
    learner = GBTClassifier(featuresCol="_features", labelCol="bad", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=seed)
    model = learner.fit(vector)
    return UrlModel(model, suffixes, prior)


def _log_odds(bad: float, total: int) -> float:
    from math import log

    return log((bad + 1) / (total - bad + 1))


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``block_probability``, ``verdict``.

    A null URL, or one without ``://``, has an empty host and path and no rule; the trees judge
    it by what text there is. Repeated rows are judged each; other columns are not read; an empty
    table gives an empty result.
    """
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_given"))
    scored = model.block_probability(urls, "_given")
    verdicts = {r.text: r.allow for r in rules}
    rule = fitting_rule(F.col("_host"), F.col("_path"), rules)
    by_rule = F.when(F.col("rule").isin([t for t, allow in verdicts.items() if allow]), "allow").when(F.col("rule").isNotNull(), "block")
    return (
        scored.withColumn("rule", rule)
        .select(
            F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
            F.col("_block").alias("block_probability"),
            F.coalesce(by_rule, F.when(F.col("_block") >= threshold, "block").otherwise("allow")).alias("verdict"),
        )
    )


# fixed values: words in a host name that mark sites no training corpus wants, the labels of the seed
BAD_HOST_WORDS = ("casino", "bets", "poker", "pills", "viagra", "spam", "adult", "porn", "xxx", "ads", "track", "torrent", "warez")


def seed_labels(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Labelled URLs: bad where a word of the host is in ``BAD_HOST_WORDS``; good
    where the document that the URL numbers was called good."""
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("url"), host.alias("_host"), F.try_to_number(F.regexp_extract(path, r"/([0-9]{1,18})\b", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    words = F.split("_host", "[^a-z]+")
    named = urls.withColumn("_named", F.arrays_overlap(words, F.array(*map(F.lit, BAD_HOST_WORDS))))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    seed = named.where("_named").select("url", F.lit(1).alias("bad"))
    good = named.where("NOT _named AND doc_id IS NOT NULL").join(known, "doc_id").where("_quality = 1").select("url", F.lit(0).alias("bad"))
    return seed.union(good)
