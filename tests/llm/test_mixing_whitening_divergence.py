"""Mixing, whitening and divergence on awkward rows, against plain Python."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from frames import ROWS, awkward, empty
from pyspark.sql import functions as F

from keelson.llm import common, divergence, mixing, whitening


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.prepare(spark)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def level(sizes, most=3):
    """Targets by resharing turn by turn; ``sizes`` by source."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, bound = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in bound)
        shares = sum(weight[s] for s in order if s not in bound)
        now = {s for s in order if s in bound or Fraction(rest * weight[s], shares) > most * sizes[s]} if shares else bound
        if now == bound:
            return {s: most * sizes[s] if s in bound else rest * weight[s] / shares for s in order}
        bound = now


def test_mixing_meets_targets(spark):
    # small sources whose weights ask for more than three passes, and a hot one
    data = ROWS + [(100 + i, "one two three four five " * (i % 7), "en", "a") for i in range(60)] + [(300, "short", "en", "b"), (301, "tiny text", "en", "")]
    mix = mixing.mix(awkward(spark, data), mixing.Settings(block_words=16, shard_slots=64))
    rows = mix.taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, n_words(t)) for i, t, _, _ in data)
    sizes = Counter()
    for _, text, _, source in data:
        sizes[source] += n_words(text)
    targets = level(sizes)
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
    by_source = {r["sid"]: r for r in mix.sources.collect()}
    for r in mix.spans.groupBy("sid").agg(F.sum("length").alias("n")).collect():
        taken[by_source[r["sid"]]["source"]] = r["n"]
    for r in by_source.values():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert abs(taken[r["source"]] - r["target"]) <= 0.5
    assert sum(r["taken"] for r in rows) == sum(taken.values())
    assert rows_of(mixing.mix(awkward(spark, data).repartition(7), mixing.Settings(block_words=16, shard_slots=64)).taken()) == rows_of(mix.taken())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mixing_fills_slots_with_blocks(spark):
    data = [(i, " ".join(f"w{i}.{k}" for k in range(i % 23)), "en", f"s{i % 4}") for i in range(300)]
    mix = mixing.mix(awkward(spark, data), mixing.Settings(block_words=10, shard_slots=16))
    texts = {i: t.split() for i, t, _, _ in data}
    slots, drawn = defaultdict(list), Counter()
    for r in mix.spans.collect():
        slots[r["shard"], r["slot"]].append((r["place"], r["doc_id"], r["first"], r["length"], r["sid"]))
    blocks = {r["sid"]: r["blocks"] for r in mix.sources.collect()}
    for (shard, slot), spans in slots.items():
        at, words = 0, []
        assert 0 <= slot < 16 and len({s[-1] for s in spans}) == 1
        for place, doc, first, length, _ in sorted(spans):
            assert place == at  # gapless
            words += texts[doc][first : first + length]
            at += length
        assert len(words) == at <= 10
        drawn[spans[0][-1], tuple(words)] += 1
    shards = Counter(shard for shard, _ in slots)
    assert all(shards[k] == 16 for k in range(max(shards)))  # all but the last are full
    assert max(drawn.values()) <= 3 and set(blocks) == set(range(4))
    # counts of a shard vary as draws do, and are no fixed shares
    per = Counter((shard, spans[0][-1]) for (shard, _), spans in slots.items())
    assert len({n for (shard, sid), n in per.items() if sid == 0}) > 1


def test_mixing_of_copies_and_nothing(spark):
    hot = spark.range(25_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    one = spark.createDataFrame([(1, "d e f g", "y")], "doc_id long, text string, source string")
    got = mixing.mix(hot.union(one)).taken()
    assert got.where("doc_id IS NULL").count() == 25_000
    sums = got.groupBy("doc_id").agg(F.sum("taken").alias("n"), F.max("taken").alias("most")).collect()
    # 75,004 words: y stops at three passes, x gives the rest
    assert {r["doc_id"]: r["n"] for r in sums} == {None: 74_992, 1: 12} and max(r["most"] for r in sums if r["doc_id"] is None) <= 3
    assert mixing.mix(empty(spark)).taken().count() == 0
    silent = awkward(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert rows_of(mixing.mix(silent).taken()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_permutation_takes_each_block_once(spark):
    for n in (1, 2, 7, 100):
        keys = F.lit("k")
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), mixing._swaps(keys, 0, F.lit(n).cast("long"), mixing.Settings())).alias("to"), "id")
        rows = df.collect()
        assert sorted(r["to"] for r in rows) == list(range(n))
    assert sum(r["to"] == r["id"] for r in rows) < 12


# ---------------------------------------------------------------- whitening


def brute(vectors, width=16):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1][:width], u[:, ::-1][:, :width]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ u / np.sqrt(values), values / np.trace(centred.T @ centred / n)


SCHEMA = "vec_id long, embedding array<float>, label int, x string, v string, d int, deviation string, rows string"


def vectors_of(rng, n, d, scale):
    return (rng.standard_normal((n, d)) * scale).astype(np.float32)


@pytest.mark.parametrize("d", [3, 16, 48])
def test_whitening_matches_dense_algebra(spark, d):
    rng = np.random.default_rng(d)
    data = vectors_of(rng, 400, d, np.linspace(2, 0.5, d))
    rows = [(i if i % 9 else None, v.tolist()) for i, v in enumerate(data)] + [(7, data[7].tolist())] * 30
    good = [v for _, v in rows]
    bad = [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] + [0.0] * (d - 1)), (903, [0.0] * (d - 1) + [float("-inf")]), (904, []), (905, [1.0] * (d + 1))]
    extra = (1, "clash", "clash", 3, "clash", "clash")
    df = spark.createDataFrame([(*r, *extra) for r in rows + bad], SCHEMA).repartition(5)
    got = whitening.whiten(df).toPandas()
    n, deviation, white, explained = brute(good)
    k = min(16, d)
    assert len(got) == len(rows) * k and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for c, part in got.groupby("component"):
        known = part[part.vec_id.notna()].sort_values("vec_id", kind="stable")
        want = sorted(((i, deviation[j], white[j, c - 1]) for j, (i, _) in enumerate(rows) if i is not None), key=lambda r: r[0])
        sign = np.sign(known.whitened.iloc[0] * want[0][2])
        assert np.allclose(known.whitened, [sign * w[2] for w in want], atol=1e-8)
        assert known.deviation.tolist() == [int(w[1]) for w in want]
        assert np.allclose(part.explained, explained[c - 1], rtol=1e-9)


def test_whitening_passes_do_not_depend_on_the_split(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors_of(rng, 500, 40, 1.0))], "vec_id long, embedding array<float>")
    steps = whitening.steps_of(df, "vec_id", "embedding")
    one = whitening.fit(steps)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several levels of sums
    many = whitening.fit(steps)
    assert one.sums == many.sums and np.allclose(one.values, many.values, rtol=1e-12) and np.allclose(one.vectors, many.vectors, atol=1e-8)
    assert one.residual < 1e-11 and np.allclose(one.vectors.T @ one.vectors, np.eye(16), atol=1e-13)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # one direction varies: one component; huge entries are held at a bound
    got = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0, 1e300]) for i in range(40)], schema)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


# ---------------------------------------------------------------- divergence


def plain_audit(data, least=3, top=200):
    docs = [(lang or "", source or "", [t.decode() for t in re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]) for _, text, lang, source in data]
    out = []
    for lang in {d[0] for d in docs}:
        groups = defaultdict(Counter)
        seen, whole = Counter(), Counter()
        for own, source, terms in docs:
            if own == lang:
                groups[source].update(terms)
                seen.update(set(terms))
                whole.update(terms)
        kept = [t for t in seen if seen[t] >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out, key=str)


MORE = [(20 + i, f"Wörter und Words {'ALPHA ' * (i % 5)} beta_gamma x{i % 3}y don't", "de" if i % 4 else None, f"s{i % 3}" if i % 7 else None) for i in range(30)]


def test_divergence_matches_plain_python(spark, monkeypatch):
    data = ROWS + MORE
    want = plain_audit(data)
    assert any(r[2] == "term" for r in want) and any(r[:2] == ("zz", "b") for r in want) is False
    assert rows_of(divergence.audit(awkward(spark, data))) == want
    assert rows_of(divergence.audit(awkward(spark, data), divergence.Settings(least_docs=1, top=3))) == plain_audit(data, 1, 3)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 5)  # many blocks
    assert rows_of(divergence.audit(awkward(spark, data))) == want
    assert divergence.audit(empty(spark)).count() == 0


def test_terms_of_long_texts(monkeypatch):
    text = ("Ab cd, " * 50 + "x" * 300 + " yz éé") .encode()
    want = divergence.term_counter(text)
    assert want == Counter({b"ab": 50, b"cd": 50, b"x" * 300: 1, b"yz": 1, "éé".encode(): 1})
    for size in (1, 7, 64, 299):
        monkeypatch.setattr(divergence, "CHUNK", size)
        assert divergence.term_counter(text) == want
