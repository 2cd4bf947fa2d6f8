"""Catalogue: pages, lookups, feeds, union/dedupe/retention."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.operators import feed as fd
from credlake.operators.clean import new_articles, retain
from credlake.operators.stats import as_of_literal
from credlake.plans import oracle as o
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.session import work_dir
from credlake.sources import fixtures as fx
from credlake.sources.lake import write_by_date

GOLD = "doc_id, id, source, title, content, url, published_at, fetched_at, date, label, confidence, scored_at"


@query("page", "T1, P17, P18", sql(f"""
SELECT {GOLD} FROM f3
WHERE label = 'Fake' AND starts_with(lower(source), 'newsapi:src1')
ORDER BY fetched_at DESC, id ASC LIMIT 20 OFFSET 20""", "f3"))
def q_page(spark, sf):
    return fd.page(fx.articles_scored(spark, sf), label="Fake", source="NEWSAPI:SRC1",
                   page_no=2, size=20)


@query("page_contains", "T1, P19", sql(f"""
SELECT {GOLD} FROM f3 WHERE contains(lower(source), 'src1')
ORDER BY fetched_at DESC, id ASC LIMIT 50""", "f3"))
def q_page_contains(spark, sf):
    return fd.page(fx.articles_scored(spark, sf), source="Src1", match="contains", size=50)


@query("page_info", "T1", sql("""
SELECT count(*) AS total, 2 AS page, 20 AS page_size,
       CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages
FROM f3 WHERE label = 'Fake' AND starts_with(lower(source), 'newsapi:src1')""", "f3"))
def q_page_info(spark, sf):
    return fd.page_info(fx.articles_scored(spark, sf), label="Fake", source="NEWSAPI:SRC1",
                        page_no=2, size=20)


@query("page_after", "T1b", sql(f"""
SELECT {GOLD} FROM f3
WHERE fetched_at < (SELECT max(fetched_at) FROM f3) - INTERVAL 36 HOUR
   OR (fetched_at = (SELECT max(fetched_at) FROM f3) - INTERVAL 36 HOUR AND id > '8')
ORDER BY fetched_at DESC, id ASC LIMIT 20""", "f3"))
def q_page_after(spark, sf):
    sc = fx.articles_scored(spark, sf)
    cur = sc.select(F.max("fetched_at")).scalar() - F.make_dt_interval(F.lit(0), F.lit(36))
    return fd.page_after(sc, cur, F.lit("8"))


@query("article", "T2", sql(f"SELECT {GOLD} FROM f3 WHERE id = (SELECT min(id) FROM f3)", "f3"))
def q_article(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return fd.article(sc, sc.select(F.min("id")).scalar())


def _feed_sql(newest_first: bool) -> str:
    since = "(SELECT as_of FROM as_of) - INTERVAL 6 HOUR"
    direction = "DESC" if newest_first else "ASC"
    nxt = ("(SELECT max(scored_at) FROM f3 WHERE scored_at > {since})" if newest_first
           else "max(scored_at) OVER ()").format(since=since)
    cols = ", ".join(o.iso(c) + f" AS {c}" if c in ("published_at", "fetched_at", "scored_at") else c
                     for c in GOLD.split(", "))
    return sql(f"""
SELECT {cols}, (SELECT count(*) FROM f3 WHERE scored_at > {since}) AS count,
       {o.iso('next_cursor')} AS next_cursor
FROM (SELECT *, {nxt} AS next_cursor
      FROM (SELECT * FROM f3 WHERE scored_at > {since} ORDER BY scored_at {direction}, id ASC LIMIT 10))""",
               "f3", "as_of")


@query("feed", "T3, P26", _feed_sql(True))
def q_feed(spark, sf):
    sc = fx.articles_scored(spark, sf)
    since = as_of_literal(sc) - F.make_dt_interval(F.lit(0), F.lit(6))  # a constant, as a client sends it
    return fd.feed(sc, since, 10, newest_first=True)


@query("feed_next", "T3b, P26", _feed_sql(False))
def q_feed_next(spark, sf):
    sc = fx.articles_scored(spark, sf)
    since = as_of_literal(sc) - F.make_dt_interval(F.lit(0), F.lit(6))  # a constant, as a client sends it
    return fd.feed(sc, since, 10, newest_first=False)


@query("retain", "D4", sql(f"SELECT {GOLD} FROM f3 ORDER BY fetched_at DESC, id ASC LIMIT 500", "f3"))
def q_retain(spark, sf):
    return retain(fx.articles_scored(spark, sf), 500)


@query("union_dedupe", "D3, U1, J3", sql("""
SELECT doc_id, id, source, title, content, url, published_at, fetched_at FROM f1
WHERE id NOT IN (SELECT id FROM f3 WHERE doc_id % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at, doc_id) = 1""", "f1", "f3"))
def q_union_dedupe(spark, sf):
    art = fx.articles_raw(spark, sf)
    newsapi = art.where(F.col("source").startswith("newsapi:"))
    gnews = art.where(F.col("source").startswith("gnews:"))
    seen = fx.articles_scored(spark, sf).where(F.col("doc_id") % 3 == 0).select("id")
    return new_articles([newsapi, gnews], seen, order_by=("fetched_at", "doc_id"))


def _stored(spark, sf):
    """F3 as a table, and the hour counts kept beside it."""
    path = work_dir(spark, "feed")
    write_by_date(fx.articles_scored(spark, sf), f"{path}/rows")
    sc = spark.read.parquet(f"{path}/rows").select(*GOLD.split(", "))
    fd.hour_counts(sc).write.parquet(f"{path}/fetched")
    fd.hour_counts(sc, "scored_at").write.parquet(f"{path}/scored")
    return sc, spark.read.parquet(f"{path}/fetched"), spark.read.parquet(f"{path}/scored")


@query("page_bounded", "T1, P17, P18 (bound and source list found in the hour counts)", sql(f"""
SELECT {GOLD} FROM f3 WHERE label = 'Fake' AND starts_with(lower(source), 'newsapi:src1')
ORDER BY fetched_at DESC, id ASC LIMIT 20 OFFSET 20""", "f3"))
def q_page_bounded(spark, sf):
    sc, counts, _ = _stored(spark, sf)
    return fd.bounded_page(sc, counts, label="Fake", source="NEWSAPI:SRC1", page_no=2, size=20)


@query("page_bounded_contains", "T1, P19 (bound and source list found in the hour counts)", sql(f"""
SELECT {GOLD} FROM f3 WHERE contains(lower(source), 'src1') ORDER BY fetched_at DESC, id ASC LIMIT 50""", "f3"))
def q_page_bounded_contains(spark, sf):
    sc, counts, _ = _stored(spark, sf)
    return fd.bounded_page(sc, counts, source="Src1", match="contains", size=50)


@query("retain_bounded", "D4 (bound found in the hour counts)", sql(f"""
SELECT {GOLD} FROM f3 ORDER BY fetched_at DESC, id ASC LIMIT 500""", "f3"))
def q_retain_bounded(spark, sf):
    sc, counts, _ = _stored(spark, sf)
    return fd.bounded_retain(sc, counts, 500)


@query("feed_bounded", "T3, P26 (bound, count and cursor through the hour counts)", _feed_sql(True))
def q_feed_bounded(spark, sf):
    sc, _, counts = _stored(spark, sf)
    return fd.bounded_feed(sc, counts, as_of_literal(sc) - F.make_dt_interval(F.lit(0), F.lit(6)))
