"""Registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.llm import (
    decontamination,
    encoding,
    filter_audit,
    hard_negatives,
    language_scores,
    near_duplicates,
    neighbours,
    packing,
    passages,
    secrets,
    token_counts,
    toxicity,
    warc,
)
from packetscope.llm.common import table
from packetscope.session import scratch_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).drop("intact")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, net)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return language_scores.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op6_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digests(decontamination.contamination(docs, benchmark))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.with_limit(token_counts.count_tokens(docs))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(encoding.encode_documents(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.filter_interactions(docs, labels)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_toxicity,
        op3_nearest_neighbours,
        op4_secret_scan,
        op5_language_scores,
        op6_repeated_paragraphs,
        op7_decontaminate,
        op8_token_counts,
        op9_near_duplicates,
        op10_bpe,
        op11_hard_negatives,
        op12_filter_audit,
        op13_packing,
    )
}

_OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
b AS (SELECT h, max(page_id) AS best, count(*) AS copies FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      16 * (strpos('0123456789abcdef', substr(d.h, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1)
      + (strpos('0123456789abcdef', substr(d.h || '0', CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1)
    ) >> CAST(3 - (5 * i) % 4 AS BIGINT)) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN best = page_id OR copies = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best = page_id OR copies = 1 THEN NULL ELSE best END AS refers_to
FROM d JOIN b ON d.h = b.h
"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
_OP7 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)),
hit AS (SELECT dw.doc_id, dw.n, s, item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hit, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items,
  list_aggregate(list_sort(list_distinct(list(item))), 'string_agg', ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP11 = """
WITH v AS (SELECT vec_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

_OP12 = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 200 AS INT)
    + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > first_id, false) AS INT) AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step,
    CAST(1 << (ascii(filter_order[k]) - 65) AS INT) AS own,
    CAST(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS INT) AS before
  FROM o, unnest(range(1, 6)) AS u(k)),
r AS (SELECT part, filter_order, step, own, c.*, coalesce(before, 0) AS b FROM s, c)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (failed & (b | own) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (failed & b = 0 AND failed & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (failed & b <> 0 AND failed & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (failed & b = 0 AND failed & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (failed & b = 0 AND failed & own <> 0), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (failed & b = 0 AND failed & own <> 0), 0))
    OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step, own
"""

# the other results rest on tokenizers, models, signatures or match positions
ORACLE_SQL: dict[str, str] = {
    "op1_warc": _OP1,
    "op7_decontaminate": _OP7,
    "op11_hard_negatives": _OP11,
    "op12_filter_audit": _OP12,
}
