"""Catalogue: column functions and silver cleaning."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.functions import display as disp
from credlake.functions.ids import stable_id, title_id
from credlake.functions.scoring import label_map, normalize_label, score_article, softmax_argmax
from credlake.functions.text import normalize_text
from credlake.functions.times import parse_published, to_iso
from credlake.operators.clean import build_article, clean
from credlake.operators.merge import duplicate_ids
from credlake.plans import oracle as o
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.sources import fixtures as fx


@query("stable_id", "P1", sql("""
SELECT doc_id, substr(sha1(url || '||' || title), 1, 24) AS id FROM f1""", "f1"))
def q_stable_id(spark, sf):
    art = fx.articles_raw(spark, sf)
    return art.select("doc_id", stable_id("url", "title").alias("id"))


@query("title_id", "P2", sql("SELECT doc_id, substr(sha256(title), 1, 24) AS id FROM f1", "f1"))
def q_title_id(spark, sf):
    return fx.articles_raw(spark, sf).select("doc_id", title_id("title").alias("id"))


def published_text(art):
    """Varied ISO renderings of F1 published_at (offset, Z, naive, -05:00, junk)."""
    ts = F.col("published_at")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    minus5 = F.date_format(ts - F.make_dt_interval(F.lit(0), F.lit(5)), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("doc_id") % 4
    return (F.when(F.col("doc_id") % 97 == 0, F.lit("garbage"))
            .when(F.col("doc_id") % 89 == 0, F.lit(""))
            .when(F.col("doc_id") % 83 == 0, F.lit("2024"))
            .when(k == 0, F.concat(base, F.lit("+00:00")))
            .when(k == 1, F.concat(base, F.lit("Z")))
            .when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.concat(minus5, F.lit("-05:00"))))


PUBLISHED_TEXT_SQL = """
CASE WHEN doc_id % 97 = 0 THEN 'garbage'
     WHEN doc_id % 89 = 0 THEN ''
     WHEN doc_id % 83 = 0 THEN '2024'
     WHEN doc_id % 4 = 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'
     WHEN doc_id % 4 = 1 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') || 'Z'
     WHEN doc_id % 4 = 2 THEN strftime(published_at, '%Y-%m-%d %H:%M:%S')
     ELSE strftime(published_at - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' END"""

PARSE_SQL = """
coalesce(CASE WHEN NOT regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}') THEN NULL
              WHEN regexp_matches(t, '(Z|[+-]\\d{2}:\\d{2})$') THEN timezone('UTC', try_cast(t AS TIMESTAMPTZ))
              ELSE try_cast(t AS TIMESTAMP) END, fetched_at)"""


@query("published", "P3, P9", sql(f"""
SELECT doc_id, {PARSE_SQL} AS published_at, CAST({PARSE_SQL} AS DATE) AS date
FROM (SELECT doc_id, fetched_at, {PUBLISHED_TEXT_SQL} AS t FROM f1)""", "f1"))
def q_published(spark, sf):
    art = fx.articles_raw(spark, sf)
    p = parse_published(published_text(art), F.col("fetched_at"))
    return art.select("doc_id", p.alias("published_at"), F.to_date(p).alias("date"))


@query("normalize_text", "P5", sql(f"""
SELECT doc_id, nullif({o.strip(f"regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '{o.WS}{{2,}}', ' ', 'g')")}, '') AS text_norm
FROM documents"""))
def q_normalize_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", normalize_text("text").alias("text_norm"))


@query("model_score", "P10, P11", sql(f"""
SELECT doc_id, {o.score_label('mt')} AS label, {o.score_conf('mt')} AS confidence
FROM (SELECT doc_id, {o.model_text()} AS mt FROM f1)""", "f1"))
def q_model_score(spark, sf):
    art = fx.articles_raw(spark, sf)
    s = score_article("title", "content")
    return art.select("doc_id", s["label"].alias("label"), s["confidence"].alias("confidence"))


@query("label_norm", "P12", sql(f"""
SELECT doc_id, raw,
       CASE WHEN upper(raw) LIKE '%FAKE%' OR upper(raw) = '0' THEN 'Fake' ELSE 'Real' END AS label,
       CASE raw WHEN 'FAKE' THEN 'Fake' WHEN 'REAL' THEN 'Real' ELSE raw END AS label_mapped
FROM (SELECT doc_id, CASE WHEN {o.md5_byte('text', 1)} % 8 = 0 THEN picked || ' ' || split_part(text, {o.NL}, 1) ELSE picked END AS raw
      FROM (SELECT doc_id, text,
                   ['FAKE', 'fake', '0', '1', 'LABEL_0', 'real', 'Fake News'][{o.md5_byte('text', 0)} % 7 + 1] AS picked
            FROM documents))"""))
def q_label_norm(spark, sf):
    r = fx.raw_labels(spark, sf)
    mapping = label_map(fx.ID2LABEL.values())
    return r.select("doc_id", "raw", normalize_label("raw").alias("label"),
                    normalize_label("raw", mapping).alias("label_mapped"))


@query("logits_to_label", "P13", sql("""
SELECT vec_id,
       CASE WHEN l IS NULL THEN NULL WHEN list_position(l, list_max(l)) = 1 THEN 'Fake' ELSE 'Real' END AS label,
       round(1.0 / list_sum(list_transform(l, lambda x: exp(x - list_max(l)))), 6) AS confidence
FROM (SELECT vec_id, [list_reduce(list_filter(x, lambda v, i: i % 2 = 1), lambda a, v: a + v, 0.0::DOUBLE),
                      list_reduce(list_filter(x, lambda v, i: i % 2 = 0), lambda a, v: a + v, 0.0::DOUBLE)] AS l
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""))
def q_logits_to_label(spark, sf):
    lg = fx.logits(spark, sf)
    p = softmax_argmax("logits", fx.ID2LABEL)
    return lg.select("vec_id", p["label"].alias("label"), F.round(p["confidence"], 6).alias("confidence"))


@query("clean", "C1, P6, P7, P8, D1 (batch)", sql("""
SELECT doc_id, id, source, title, content, url, published_at, fetched_at, lang_guess, date
FROM silver""", "silver"))
def q_clean(spark, sf):
    art = fx.articles_raw(spark, sf)
    return clean(art, order_by=("fetched_at", "doc_id")).select(
        "doc_id", "id", "source", "title", "content", "url", "published_at", "fetched_at",
        "lang_guess", "date")


@query("build_article", "P4", sql(f"""
SELECT substr(sha1(url || '||' || title), 1, 24) AS id, source, {o.strip('title')} AS title,
       {o.strip("coalesce(content, '')")} AS content, url, published_at, fetched_at
FROM f1t WHERE coalesce(url, '') <> '' AND coalesce(title, '') <> ''""", "f1t"))
def q_build_article(spark, sf):
    return build_article(fx.articles_text(fx.articles_raw(spark, sf)))


@query("duplicate_ids", "S13", sql("""
SELECT id, count(*) AS n FROM f1 GROUP BY id HAVING count(*) > 1""", "f1"))
def q_duplicate_ids(spark, sf):
    return duplicate_ids(fx.articles_raw(spark, sf))


DISPLAY_SQL = f"""
SELECT id, title, source, coalesce(published_at, fetched_at) AS publishedAt,
       CASE WHEN label = 'Fake' THEN 'FAKE' ELSE 'REAL' END AS classification, confidence,
       'News' AS category,
       CASE WHEN content IS NULL THEN ''
            ELSE substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END END AS summary,
       url, coalesce(scored_at, fetched_at) AS processedAt, coalesce(content, '') AS content,
       {o.truncate('source', 15)} AS source_badge
FROM f3"""


@query("display", "P20, P21", sql(DISPLAY_SQL, "f3"))
def q_display(spark, sf):
    return fx.articles_scored(spark, sf).select(*disp.display_columns())


@query("explain_text", "P22", sql(f"""
SELECT id, CASE WHEN lower(label) = 'fake'
                THEN {o.template(disp.EXPLAIN_FAKE, label='label', pct=o.pct0('confidence'), source='source')}
                ELSE {o.template(disp.EXPLAIN_REAL, label='label', pct=o.pct0('confidence'), source='source')}
           END AS text,
       'demo-fallback' AS model, 0 AS tokens_used
FROM f3""", "f3"))
def q_explain_text(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return sc.select("id", disp.explanation_text().alias("text"),
                     F.lit(disp.TEMPLATE_MODEL).alias("model"), F.lit(0).alias("tokens_used"))


@query("summary_text", "P23", sql(f"""
SELECT id, {o.template(disp.SUMMARY, title='title', source=o.or_default('source', disp.UNKNOWN_SOURCE),
                        label='label', pct=o.pct0('confidence'),
                        preview="CASE WHEN content IS NULL OR content = '' THEN title ELSE substr(content, 1, 200) END")} AS text,
       'demo-fallback' AS model, 0 AS tokens_used
FROM f3""", "f3"))
def q_summary_text(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return sc.select("id", disp.summary_text().alias("text"),
                     F.lit(disp.TEMPLATE_MODEL).alias("model"), F.lit(0).alias("tokens_used"))


@query("prompts", "P24", sql(f"""
SELECT id,
       {o.template(disp.EXPLAIN_PROMPT, label='label', pct1=o.pct1('confidence'),
                   source=o.or_default('source', disp.UNKNOWN_SOURCE_PROMPT), title='title',
                   content800="substr(coalesce(content, ''), 1, 800)")} AS explain_prompt,
       {o.template(disp.SUMMARY_PROMPT, title='title',
                   content1500="substr(coalesce(content, ''), 1, 1500)")} AS summary_prompt
FROM f3""", "f3"))
def q_prompts(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return sc.select("id", disp.explain_prompt().alias("explain_prompt"),
                     disp.summary_prompt().alias("summary_prompt"))


@query("iso_times", "P26", sql(f"""
SELECT id, {o.iso('published_at')} AS published_at, {o.iso('fetched_at')} AS fetched_at,
       {o.iso('scored_at')} AS scored_at FROM f3""", "f3"))
def q_iso_times(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return sc.select("id", to_iso("published_at").alias("published_at"),
                     to_iso("fetched_at").alias("fetched_at"), to_iso("scored_at").alias("scored_at"))
