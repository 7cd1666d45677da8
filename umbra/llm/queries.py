"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import attribution, mixing, warc
from umbra.llm.exact_dedup import dedup
from umbra.llm.jaccard import jaccard_components
from umbra.llm.langid import language_of
from umbra.llm.packing import pack_conversations, pack_documents
from umbra.llm.quality import quality_of
from umbra.llm.runtime import documents
from umbra.llm.sharding import shard_documents
from umbra.llm.topk import search

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(documents(spark, sf_dir))


@query
def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 16)


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=4, percent=85)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(
        F.col("record_id").alias("page_id"), "url", "refers_to", "state", "etag",
        F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"), F.col("headers")["server"].alias("server"),
    )


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.document_leaves(documents(spark, sf_dir)), mixing.document_weights())


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.section_tokens(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query
def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing operator where loss-bearing tokens are a limit of their own: instruction data."""
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("word_bpe_49k.json"))


ORACLE["op7_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

ORACLE["op10_exact_topk"] = """
WITH v AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.place <> c.place AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

ORACLE["op6_warc_revisits"] = r"""
WITH u AS (
    SELECT page_id, md5(coalesce(html, '')) AS etag, strlen(coalesce(html, '')) AS size,
        regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?', ['scheme', 'host', 'path', 'mark', 'args']) AS u FROM pages
), p AS (
    SELECT page_id, etag, size, lower(u.scheme) AS scheme, rtrim(u.path, '/') AS path, list_sort(list_filter(string_split(u.args, '&'), lambda x: x <> '')) AS args,
        CASE WHEN lower(u.scheme) = 'http' AND ends_with(u.host, ':80') THEN lower(u.host[:-4]) WHEN lower(u.scheme) = 'https' AND ends_with(u.host, ':443') THEN lower(u.host[:-5]) ELSE lower(u.host) END AS host
    FROM u
), h AS (SELECT * REPLACE (CASE WHEN starts_with(host, 'www.') THEN host[5:] ELSE host END AS host, CASE scheme WHEN 'http' THEN 'https' ELSE scheme END AS scheme) FROM p
), c AS (
    SELECT page_id, etag, size, CASE WHEN host <> '' THEN scheme || '://' || host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS url FROM h
), r AS (
    SELECT a.page_id, a.url, a.etag, f.page_id AS refers_to, f.etag AS stored, f.size,
        row_number() OVER (PARTITION BY a.page_id ORDER BY f.page_id DESC) AS k
    FROM c a LEFT JOIN c f ON f.url = a.url AND 2 * f.page_id < 2 * (a.page_id + 100) + 1
)
SELECT page_id, url, refers_to, CASE WHEN refers_to IS NULL THEN 'unresolved' WHEN etag = stored THEN 'resolved' ELSE 'changed' END AS state, etag,
    CASE WHEN etag = stored THEN CAST(page_id + 100 AS VARCHAR) END AS date,
    CASE WHEN etag = stored THEN CAST(size AS VARCHAR) END AS content_length,
    CASE WHEN etag = stored THEN 'a' END AS server
FROM r WHERE k = 1
"""


def _level(level: str, parents: list[str], above: str) -> str:
    keys = ", ".join([*parents, level])
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN {above} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
    return f"""
n_{level} AS (SELECT {keys}, CAST(2 * sum(tokens) AS BIGINT) AS most, max(w_{level}) AS weight FROM leaves GROUP BY {keys}),
a_{level} AS (SELECT *, coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM n_{level} {join} WINDOW w AS ({over} ORDER BY most / weight, {level})),
b_{level} AS (SELECT *, most * open <= (budget - used) * weight AS sated FROM a_{level}),
c_{level} AS (SELECT *, coalesce(sum(most) FILTER (WHERE sated) OVER p, 0) AS spent, coalesce(sum(weight) FILTER (WHERE NOT sated) OVER p, 0) AS others
    FROM b_{level} WINDOW p AS ({over})),
d_{level} AS (SELECT *, CASE WHEN sated THEN most ELSE (budget - spent) * weight // others END AS base FROM c_{level}),
e_{level} AS (SELECT *, budget - sum(base) OVER ({over}) AS rest,
    sum(CASE WHEN sated THEN 0 ELSE 1 END) OVER ({over} ORDER BY most / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM d_{level}),
g_{level} AS (SELECT {keys}, CAST(base + CASE WHEN NOT sated AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS budget FROM e_{level})"""


ORACLE["op8_mixing"] = rf"""
WITH d AS (
    SELECT doc_id, 'd' || CAST(coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
        coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(tokens) AS tokens, 4 - CAST(substr(domain, 2, 1) AS BIGINT) AS w_domain,
        CASE WHEN lang = 'en' THEN 6 WHEN lang IN ('fr', 'de') THEN 2 ELSE 1 END AS w_lang,
        1 + coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 3 AS w_source FROM d GROUP BY domain, lang, source
), total AS (SELECT CAST(sum(tokens) AS BIGINT) // 2 AS budget FROM leaves),
{_level("domain", [], "")}, {_level("lang", ["domain"], "g_domain")}, {_level("source", ["domain", "lang"], "g_lang")},
given AS (SELECT domain, lang, source, budget // CAST(tokens AS BIGINT) AS epochs, budget % CAST(tokens AS BIGINT) AS prefix
    FROM g_source JOIN leaves USING (domain, lang, source) WHERE tokens > 0),
whole AS (SELECT doc_id, domain, lang, source, CAST(unnest(range(epochs)) AS INTEGER) AS epoch, tokens, tokens AS take_tokens FROM d JOIN given USING (domain, lang, source)),
last AS (SELECT *, md5('17:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS place FROM d JOIN given USING (domain, lang, source) WHERE prefix > 0),
part AS (SELECT *, prefix - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM last)
SELECT doc_id, domain, lang, source, epoch, tokens, take_tokens FROM whole
UNION ALL
SELECT doc_id, domain, lang, source, CAST(epochs AS INTEGER), tokens, CAST(least(tokens, remaining) AS BIGINT) FROM part WHERE remaining > 0
"""
