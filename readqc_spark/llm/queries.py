"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc_spark.llm import exact_dedup, media, mixing, ngram_join, pieces, private_data, quality, token_shards, toxicity, url_filter
from readqc_spark.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_digest(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=3, percent=90, links=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find_private(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the URLs of pages whose page_id is divisible by 50."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_verdicts(pages, pages.filter(F.col("page_id") % 50 == 0).select("url")).drop("listed", "passed")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_token_shards, op3_ngram_join, op4_mixing, op5_private_data, op6_toxicity, op7_exact_dedup, op8_url_filter, op9_media, op10_quality, pipeline)}
_OP7 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

_OP8 = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages),
k AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM p),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key FROM k),
l AS (SELECT DISTINCT url_key FROM c WHERE page_id % 50 = 0 AND url_key IS NOT NULL),
r AS (
  SELECT c.page_id, c.host, c.path, c.url_key, x.rule, x.verdict,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(x.rule) DESC NULLS LAST) AS n
  FROM c LEFT JOIN (VALUES ('com', '/', 'allow', 'com/'), ('example.com', '/en/', 'block', 'example.com/en/'), ('www.example.com', '/en/', 'allow', 'www.example.com/en/'), ('net', '/es/', 'block', 'net/es/'), ('net', '/fr/', 'block', 'net/fr/')) AS x(h, u, verdict, rule)
  ON (c.host = x.h OR ends_with(c.host, '.' || x.h)) AND starts_with(c.path, x.u))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN url_key IN (SELECT url_key FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM r WHERE n = 1
"""

_OP4 = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key, row_number() OVER () AS id
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM r GROUP BY source),
b AS (SELECT 1.5::DOUBLE * sum(n) AS budget FROM s),
w AS (SELECT *, ([3.0, 1.0, 2.0])[1 + rank % 3]::DOUBLE AS weight, 2.0::DOUBLE * n AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS i, sum(cap) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING) - cap AS before, sum(weight) OVER (ORDER BY cap / weight DESC, rank DESC ROWS UNBOUNDED PRECEDING) AS free FROM w WHERE n > 0),
k AS (SELECT budget - before AS rest, free, i FROM o, b WHERE (budget - before) * weight / free < cap ORDER BY i LIMIT 1),
t AS (
  SELECT w.source, w.rank, w.n, CASE WHEN w.n = 0 THEN 0.0 WHEN o.i < coalesce(k.i, 1000000000) THEN w.cap ELSE k.rest * w.weight / k.free END::DOUBLE AS target
  FROM w LEFT JOIN o ON w.rank = o.rank LEFT JOIN k ON true),
q AS (
  SELECT r.id, r.doc_id, r.size, r.key, t.rank, t.n AS source_size, t.target,
    (sum(r.size) OVER (PARTITION BY t.rank ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS UNBOUNDED PRECEDING))::DOUBLE / nullif(t.target, 0) AS first_finish
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT id, size, rank, key, doc_id, e, first_finish + e * (source_size::DOUBLE / target) AS time FROM q, (VALUES (0), (1)) AS x(e) WHERE size > 0 AND target > 0),
l AS (SELECT id, sum(size) OVER (ORDER BY time, rank, key, doc_id NULLS FIRST, size, e ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT id, count(*) AS copies FROM l, b WHERE run <= budget GROUP BY id)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, coalesce(copies, 0)::INT AS copies, first_finish FROM q LEFT JOIN n USING (id)
"""

ORACLE: dict[str, str] = {"op4_mixing": _OP4, "op7_exact_dedup": _OP7, "op8_url_filter": _OP8}
