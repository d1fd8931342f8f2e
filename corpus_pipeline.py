"""Corpus pipeline: quality rules, toxicity, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns rows with
the columns of ``documents``, the last one packed sequences. Bands are measured on all documents
called good in ``sf_dir``, the toxicity model is fitted on a bounded sample of its labelled documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import decontaminate, neardup, packing, quality, toxicity
from keelson.llm.common import load, prepare, stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    bands = quality.fit_bands(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), PIECES)
    return quality.keep_good(docs, PIECES, bands)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    model = toxicity.fit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, whatever its id: shingles of five words, similarity 0.8 or more."""
    prepare(spark)
    return neardup.keep_first(docs, neardup.Settings(words=5), repeats=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece, with its token ids."""
    prepare(spark)
    return packing.pack(docs, WORDS, 2048, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models and token ids are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
