"""Catalogue: envelopes and provider payloads."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.plans import oracle as o
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.schemas import GOLD_SCHEMA, RAW_SCHEMA
from credlake.sources import envelopes as ev
from credlake.sources import fixtures as fx
from credlake.sources import payloads as pl

ENV_OK = "doc_id % 97 <> 0 AND doc_id % 89 <> 0"


@query("parse_envelopes", "S4, P9", sql(f"""
SELECT id, source, title, content, url, published_at, fetched_at, source AS kafka_key,
       CAST(fetched_at AS TIMESTAMP) AS kafka_ts, CAST(CAST(published_at AS TIMESTAMP) AS DATE) AS date
FROM f1t WHERE {ENV_OK}""", "f1t"))
def q_parse_envelopes(spark, sf):
    return ev.parse_envelopes(fx.envelopes(spark, sf))


@query("reject_envelopes", "S5", sql("""
SELECT source AS key, CAST(fetched_at AS TIMESTAMP) AS kafka_ts,
       CASE WHEN doc_id % 97 = 0 THEN 'unparsable' ELSE 'missing_id' END AS reason
FROM f1t WHERE doc_id % 97 = 0 OR doc_id % 89 = 0""", "f1t"))
def q_reject_envelopes(spark, sf):
    return ev.reject_envelopes(fx.envelopes(spark, sf)).select("key", "kafka_ts", "reason")


@query("raw_envelope", "S14", sql("""
SELECT source AS key, id, source, title, content, url, published_at, fetched_at, 7 AS n_keys
FROM f1t""", "f1t"))
def q_raw_envelope(spark, sf):
    env = ev.to_raw_envelope(fx.articles_text(fx.articles_raw(spark, sf)))
    back = F.from_json("value", RAW_SCHEMA)
    return env.select("key", back.alias("r"), F.size(F.json_object_keys("value")).alias("n_keys")) \
              .select("key", "r.*", "n_keys")


@query("scored_envelope", "S10", sql("""
SELECT id AS key, id, source, title, content, url, published_at, fetched_at, date, label,
       confidence, scored_at, 11 AS n_keys
FROM f3""", "f3"))
def q_scored_envelope(spark, sf):
    env = ev.to_scored_envelope(fx.articles_scored(spark, sf))
    back = F.from_json("value", GOLD_SCHEMA)
    return env.select("key", back.alias("r"), F.size(F.json_object_keys("value")).alias("n_keys")) \
              .select("key", "r.*", "n_keys")


@query("valid_scored", "S12b", sql("""
SELECT CASE WHEN doc_id % 79 = 0 THEN NULL ELSE id END AS id,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE source END AS source,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE title END AS title,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE content END AS content,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE url END AS url,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE published_at END AS published_at,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE fetched_at END AS fetched_at,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE date END AS date,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE label END AS label,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE confidence END AS confidence,
       CASE WHEN doc_id % 79 = 0 THEN NULL ELSE scored_at END AS scored_at
FROM f3 WHERE doc_id % 97 <> 0 AND doc_id % 89 <> 0 AND doc_id % 83 <> 0
  AND (doc_id % 73 <> 0 OR doc_id % 79 = 0)""", "f3"))
def q_valid_scored(spark, sf):
    return ev.valid_scored(fx.scored_envelopes(spark, sf))


# F5 payloads, restated from F1 (block = doc_id div 20).
PAYLOAD_ITEMS = f"""
SELECT f.doc_id, f.title AS raw_title, f.url AS raw_url,
       CASE WHEN f.doc_id % 41 = 0 THEN NULL ELSE d.source END AS name,
       CASE WHEN f.doc_id % 7 = 0 THEN NULL ELSE ' Writer ' || CAST(f.doc_id % 11 AS VARCHAR) || ' ' END AS author,
       CASE WHEN f.doc_id % 53 = 0 THEN '[Removed]' ELSE f.title END AS title,
       CASE WHEN f.doc_id % 3 = 0 THEN '' ELSE f.content END AS description,
       f.content,
       CASE WHEN f.doc_id % 59 = 0 THEN NULL ELSE f.url END AS url,
       f.published_at AS publishedAt,
       (f.doc_id // 20) % 13 <> 0 AS status_ok,
       TIMESTAMP '2024-01-01' + to_seconds(((f.doc_id // 20) * 20 + 30) * 420) AS pfetched
FROM f1t f JOIN documents d ON d.doc_id = f.doc_id"""

BODY = "coalesce(nullif(description, ''), content)"


def _provider_sql(prefix: str, name_expr: str, require_ok: bool) -> str:
    ok = "status_ok AND " if require_ok else ""
    return sql(f"""
SELECT substr(sha1(url || '||' || title), 1, 24) AS id, '{prefix}' || {name_expr} AS source,
       {o.strip('title')} AS title, {o.strip(f"coalesce({BODY}, '')")} AS content, url,
       {o.iso("CAST(publishedAt AS TIMESTAMP)")} AS published_at, {o.iso('pfetched')} AS fetched_at
FROM ({PAYLOAD_ITEMS})
WHERE {ok}coalesce(url, '') <> '' AND coalesce(title, '') <> ''""", "f1t")


@query("payload_newsapi", "S2, P3, P4", _provider_sql("newsapi:", "coalesce(name, 'unknown')", True))
def q_payload_newsapi(spark, sf):
    return pl.normalize_newsapi(fx.payloads(spark, sf))


@query("payload_gnews", "S3, P3, P4", _provider_sql("gnews:", "coalesce(nullif(name, ''), 'unknown')", False))
def q_payload_gnews(spark, sf):
    return pl.normalize_gnews(fx.payloads(spark, sf))


def _live_sql(newsapi: bool) -> str:
    t = o.strip("coalesce(title, '')")
    u = o.strip("coalesce(url, '')")
    body = o.strip(f"coalesce({BODY}, '')")
    trimmed = o.strip("coalesce(author, '')")
    author = f"nullif({trimmed}, '')" if newsapi else "NULL::VARCHAR"
    keep = "ts <> '' AND us <> ''" + (" AND ts <> '[Removed]' AND status_ok" if newsapi else "")
    mt = o.model_text("ts", "body")
    return sql(f"""
SELECT substr(sha1(us || '||' || ts), 1, 24) AS id, ts AS title, coalesce(name, 'Unknown') AS source,
       us AS url, {author} AS author, body AS content,
       coalesce(nullif(publishedAt, ''), {o.iso('pfetched')}) AS published_at,
       {o.iso('pfetched')} AS fetched_at, pfetched AS scored_at, 'News' AS category,
       {o.score_label(mt)} AS label, {o.score_conf(mt)} AS confidence
FROM (SELECT *, {t} AS ts, {u} AS us, {body} AS body FROM ({PAYLOAD_ITEMS}))
WHERE {keep}""", "f1t")


@query("payload_live", "S3b, P25", _live_sql(True))
def q_payload_live(spark, sf):
    return pl.normalize_live(fx.payloads(spark, sf), "newsapi")


@query("payload_live_gnews", "S3b (GNews)", _live_sql(False))
def q_payload_live_gnews(spark, sf):
    return pl.normalize_live(fx.payloads(spark, sf), "gnews")
