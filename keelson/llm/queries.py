"""The registered query of each operator, with its check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import counts, decontaminate, divergence, interleave, licenses, mixing, neardup, packing, quality, toxicity, urls, wavelet, whitening
from keelson.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def ordered(df: DataFrame, first: str) -> DataFrame:
    """The columns named in ``first``, then the others."""
    names = first.split()
    return df.select(*names, *[c for c in df.columns if c not in names])


# the rules of the URL query: host, path prefix, allowed
RULES = [
    urls.Rule("org", "/", True),
    urls.Rule("example.org", "/es/", False),
    urls.Rule("example.org", "/en/1", False),
    urls.Rule("com", "/fr/", True),
    urls.Rule("com", "/de/", False),
]


@query("op1_url_filters")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages, labels = load(spark, folder, "pages"), load(spark, folder, "labels")
    return ordered(urls.judge_urls(pages, RULES, urls.fit(urls.seed_labels(pages, labels))), "page_id host path rule verdict")


@query("op2_packing")
def sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(load(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, end_id=1)
    return ordered(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "doc_id start length ids_crc32 doc_tokens sequence_id offset")


NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w),
u AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
 HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON s.doc_id = c.doc_id"""


@query("op3_near_duplicates", NEAR_DUPLICATES_SQL)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, folder, "documents"), neardup.Settings(words=4))


@query("op4_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.count_tokens(load(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~held_out()))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_decontamination")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return ordered(quality.fitted_rules(docs, labels, path), "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")


@query("op8_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, folder, "documents"))


# CRC-32 from its definition: the table of the reflected polynomial, then one step per byte
INTERLEAVE_SQL = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
   lambda x: ((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1)::BIGINT)),
  lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])) AS text_crc32,
 coalesce('s' || source, 'n') AS src, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents, t),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY digest, doc_id, size, text_crc32) AS rank, count(*) OVER (PARTITION BY src) AS total, count(*) OVER () AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1) / (2 * total), src, digest, doc_id, size, text_crc32) - 1 AS place FROM r),
s AS (SELECT *, CAST(place * 40 // n AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, shard, CAST(place - (shard * n + 39) // 40 AS BIGINT) AS slot, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


@query("op9_interleave", INTERLEAVE_SQL)
def stratified_interleave(spark: SparkSession, folder: str) -> DataFrame:
    dealt = interleave.interleave(load(spark, folder, "documents"), shards=40)
    named = dealt.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return ordered(named, "doc_id size text_crc32 law shard slot grown_shard")


@query("op10_wavelet_shards")
def wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    files = wavelet.write_shards(load(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_shards(files)


# the settings of the operator are written out: blocks of 128 words, shards of 4,096 slots, 12 swap rounds, seed 29, three passes at most
MIXING_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
w AS (SELECT *, sid % 3 + 1 AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source)),
o AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
 sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM w),
f AS (SELECT rest::DOUBLE AS rest, shares::DOUBLE AS shares FROM o WHERE 3 * source_size::DOUBLE * shares >= rest::DOUBLE * weight ORDER BY source_size / weight, sid LIMIT 1),
t AS (SELECT w.*, least(f.rest * weight / f.shares, 3 * source_size::DOUBLE) AS target, (source_size + 127) // 128 AS blocks, coalesce('s' || source, 't') AS key FROM w, f),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
p AS (SELECT *, goal // source_size AS epoch, goal % source_size AS rest, list_transform(range(0, 4), lambda e: list_transform(range(1, 13), lambda r: {
  's': ('0x' || substr(md5('29|swap|' || key || '|' || e || '|' || r), 1, 15))::BIGINT % blocks,
  'f': ('0x' || substr(md5('29|swap|' || key || '|' || e || '|' || r), 16, 7))::BIGINT + 1,
  'h': ('0x' || substr(md5('29|swap|' || key || '|' || e || '|' || r), 23, 7))::BIGINT})) AS swaps FROM g WHERE goal > 0),
q AS (SELECT *, blocks * 128 - source_size AS lack, list_reduce(list_reverse(swaps[epoch + 1]), lambda x, r: CASE WHEN (greatest(x, (r.s - x + blocks) % blocks) % 2147483647 * r.f + r.h) % 2147483647 < 1073741823
  THEN (r.s - x + blocks) % blocks ELSE x END, blocks - 1) AS short_at FROM p),
m AS (SELECT *, CASE WHEN rest <= short_at * 128 THEN (rest + 127) // 128 ELSE (rest + lack + 127) // 128 END AS more FROM q),
n AS (SELECT *, epoch * blocks + more AS slots, more * 128 - CASE WHEN more > short_at THEN lack ELSE 0 END - rest AS cut FROM m),
l AS (SELECT sid, slots, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(slots) OVER () AS total FROM n),
u AS (SELECT i // 4096 AS shard, ('0x' || substr(md5('29|draw|' || i), 1, 15))::BIGINT % total AS u FROM (SELECT unnest(range(0, total::BIGINT)) AS i, total FROM (SELECT max(total) AS total FROM l))),
c AS (SELECT sid, shard, slots, count(*) AS drawn FROM u JOIN l ON u >= low AND u < low + slots GROUP BY ALL),
h AS (SELECT sid, shard, drawn, greatest(least(drawn, slots - coalesce(sum(drawn) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS held FROM c),
v AS (SELECT shard, row_number() OVER (ORDER BY shard) AS pos FROM (SELECT shard, unnest(range(0, sum(drawn - held)::BIGINT)) FROM h GROUP BY shard)),
x AS (SELECT sid, row_number() OVER (ORDER BY sid) AS pos FROM (SELECT sid, unnest(range(0, (slots - coalesce((SELECT sum(held) FROM h WHERE h.sid = n.sid), 0))::BIGINT)) FROM n)),
y AS (SELECT sid, shard, sum(k)::BIGINT AS k FROM (SELECT sid, shard, held AS k FROM h UNION ALL SELECT sid, shard, 1 FROM v JOIN x USING (pos)) GROUP BY ALL),
b AS (SELECT sid, unnest(range(0, slots)) AS k FROM n),
a AS (SELECT n.sid, (CASE WHEN k = slots - 1 THEN cut ELSE 0 END)::BIGINT AS cut, list_reduce(swaps[k // blocks + 1], lambda x, r: CASE WHEN (greatest(x, (r.s - x + blocks) % blocks) % 2147483647 * r.f + r.h) % 2147483647 < 1073741823
  THEN (r.s - x + blocks) % blocks ELSE x END, k % blocks) AS block FROM b JOIN n USING (sid) WHERE (SELECT sum(k) FROM y) = (SELECT sum(slots) FROM n)),
e AS (SELECT d.*, sid, source_size, target, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5('29|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), size, doc_id NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, row_number() OVER () AS nr FROM e),
k AS (SELECT nr, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM i WHERE size > 0),
j AS (SELECT nr, sum(greatest(0, least(start + size, least((block + 1) * 128, source_size) - cut) - greatest(start, block * 128))) AS taken FROM k JOIN i USING (nr) JOIN a USING (sid, block) GROUP BY nr)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM i LEFT JOIN j USING (nr)"""


@query("op11_mixing", MIXING_SQL)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents")).taken()


@query("op12_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(load(spark, folder, "embeddings"))


DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT nr, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY ALL HAVING count(DISTINCT nr) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, (SELECT coalesce(sum(c), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS n FROM g),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + v.v) AS p
 FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 1) // (n + v) AS q FROM k JOIN v USING (lang)),
t AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
UNION ALL SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM t) WHERE rank <= 200"""


@query("op13_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(load(spark, folder, "documents"))
