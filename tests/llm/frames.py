"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven quiet painters carry long wooden ladders through the narrow "
    "garden behind an old stone house near the river where children were playing with paper boats until the evening rain "
    "came down and everybody ran inside to drink hot tea and tell each other stories about travel and weather"
)
LONG = " ".join(f"word{i % 977} item{i}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE + " indeed", "en", "a"),
    (3, PROSE, None, "a"),
    (4, None, "en", None),
    (5, "", "en", "b"),
    (6, " \t\n ", "en", "b"),
    (7, "x", "zz", "b"),
    (8, LONG, "en", "c"),
    (9, "naïve Ünïcode — “quotes” 漢字 İstanbul ﬁ\u00a0nbsp  two  spaces ", "de", "c"),
    (9, "naïve Ünïcode — “quotes” 漢字 İstanbul ﬁ\u00a0nbsp  two  spaces ", "de", "c"),
    (None, "a row without an id and some more words", "en", "c"),
    (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark, rows=ROWS):
    """The rows, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = ("id", "_id", "_text", "_gone", "component", "set_id", "size", "shard", "_v", "_f", "n_tokens", "ids", "_bucket")
    return df.withColumns({name: F.lit("clash") for name in extra})


def empty(spark):
    return awkward(spark, [])
