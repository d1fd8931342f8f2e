"""Token counts by the whole-token shortcut.

The vocabulary is asked once, offline, which of its strings it encodes alone as one
token. A word of the text that is among them counts one without being encoded; only
the others are merged, each once per worker as long as the bounded table keeps it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from keelson.llm.common import text_bytes
from keelson.llm.vocab import piece_vocab


def token_count(text: Column, path: str) -> Column:
    """Number of ids of a binary text column under the sentencepiece vocabulary at ``path``."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        vocab = piece_vocab(path)
        return pa.array(list(map(len, vocab.encode_all([t or b"" for t in texts.to_pylist()]))), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text counts as empty (0 bytes, 0 tokens, not over); a null id stays null;
    repeated rows are counted each; other columns are not read; an empty table gives
    an empty result. Very long texts are counted whole.
    """
    counted = docs.select(F.col(id_col), text_bytes(text_col).alias("_text")).select(
        id_col, F.octet_length("_text").cast("long").alias("n_bytes"), token_count(F.col("_text"), path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
