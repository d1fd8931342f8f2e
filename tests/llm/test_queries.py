"""Registered queries on the small tables, against SQL or plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from harness import compare
from test_small import base_counts

import corpus_pipeline
from keelson.llm import neardup, toxicity, vocab
from keelson.llm.common import load
from keelson.llm.queries import ORACLES, QUERIES, RULES

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(small):
    return pd.read_parquet(f"{small}/documents.parquet").set_index("doc_id").text


@pytest.fixture(scope="module")
def word_ids(docs):
    library = vocab.WordVocab(WORDS).library
    return {i: e.ids for i, e in zip(docs.index, library.encode_batch(list(docs), add_special_tokens=False))}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck, small):
    assert compare(QUERIES[name](spark, small), duck, ORACLES[name]) is None


def test_url_filters(spark, small):
    pages = pd.read_parquet(f"{small}/pages.parquet").set_index("page_id").url
    rules = sorted(RULES, key=lambda r: -len(r.text))
    got = QUERIES["op1_url_filters"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]])
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rule = next((x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)), None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == ("allow" if rule.allow else "block"))


def test_packing(spark, small, word_ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_packing"](spark, small).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in word_ids.items():
        ids, at = np.array([*ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_token_counts(spark, small, docs):
    library = vocab.PieceVocab(public_tokenizers.path("piece_bpe_32k.model")).library
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_token_counts"](spark, small).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in docs.items()}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").toxic
    got = QUERIES["op5_toxicity"](spark, folder).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    held = got[got.held_out].join(labels, how="inner")
    assert ((held.predicted == held.toxic).mean() > 0.9) and held[held.toxic == 0].predicted.mean() < 0.02


def test_leaks(spark, small, docs):
    items = pd.read_parquet(f"{small}/benchmark.parquet").set_index("item_id").text
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, small).collect()}
    assert {(i, k) for i, t in docs.items() for k, item in items.items() if item in t} <= got
    assert {i for i, _ in got} <= {i for i, t in docs.items() if any(item.lower()[:30] in t.lower() or item.lower()[-30:] in t.lower() for item in items)}


def test_quality_counts(spark, small, docs):
    for r in QUERIES["op7_quality_rules"](spark, small).collect():
        want = base_counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["kept"] and r["base_failed"])


def test_licenses_found(spark, small, docs):
    got = {r["doc_id"] for r in QUERIES["op8_license_scan"](spark, small).collect()}
    notices = "Licensed under CC BY-NC 4.0|under the GNU General Public License, version 3|Licensed under the Apache License, Version 2.0|Released under the MIT License"
    assert got == {i for i, t in docs.items() if re.search(notices, t, re.I)}


def test_wavelet_shards(spark, small, word_ids):
    start = 0
    for r in sorted(QUERIES["op10_wavelet_shards"](spark, small).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*word_ids[r["doc_id"]], 2], "<u4")
        assert tuple(r) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pipeline_stages(spark, small, docs):
    """Each stage keeps what its operator keeps of the rows it was given."""
    frame = load(spark, small, "documents")
    columns, kept = frame.columns, set(docs.index)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = stage(spark, frame, small).persist()
        assert frame.columns == columns, name
        now = {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert now <= kept and len(now) > 0.6 * len(kept), name
        if name == "near_dedup":
            judged = neardup.near_duplicates(before, neardup.Settings(words=5))
            assert now == {r["doc_id"] for r in judged.where("kept").collect()}
        if name == "toxicity":
            lexicon = toxicity.fit(load(spark, small, "documents"), load(spark, small, "labels")).lexicon
            grammar = toxicity.Grammar(lexicon)
            assert all(any(grammar.read(docs[i])) for i in kept - now)
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()
    assert {r["doc_id"] for r in packed} == kept
