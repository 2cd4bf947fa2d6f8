"""Catalogue: the serving table with its id directory and running totals.

Each query lands F3 in the serving table as one named batch and then F4 with moved
dates as a second, which is replayed; what it answers comes from the table, from the
directory alone, or from the running totals alone.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.operators import stats
from credlake.plans.merge_queries import COLS
from credlake.plans.oracle import cte, sql
from credlake.plans.registry import query
from credlake.schemas import GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources import fixtures as fx
from credlake.sources import lake, serving

GOLD = [c for c in COLS if c != "doc_id"]

# F4 with the date of every second updated article moved by ten days
cte("f4m", ["f4"], "SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN CAST(date + 10 AS DATE) ELSE date END AS date) FROM f4")
cte("served", ["f3", "f4m"], f"""
SELECT coalesce(u.id, t.id) AS id, {", ".join(f"coalesce(u.{c}, t.{c}) AS {c}" for c in GOLD)}
FROM f3 t FULL OUTER JOIN (
  SELECT id, {", ".join(f"arg_max({c}, scored_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in GOLD)} FROM f4m GROUP BY id) u ON t.id = u.id""")

FAKE_N = "count(*) FILTER (WHERE label = 'Fake')"
REAL_N = "count(*) FILTER (WHERE label = 'Real')"


def moved(updates):
    """Updates with every second article's date moved."""
    date = F.when(F.col("doc_id") % 10 == 0, F.date_add("date", 10)).otherwise(F.col("date"))
    return updates.withColumn("date", date)


def served(spark, sf) -> str:
    """A serving table after F3, the moved F4 and a replay of it.

    F3 is computed once and landed; both batches are read from there."""
    table, landed = work_dir(spark, "serving"), work_dir(spark, "landed")
    columns = GOLD_SCHEMA.fieldNames()
    fx.articles_scored(spark, sf).write.parquet(landed)
    scored = spark.read.parquet(landed)
    serving.merge_into(spark, table, scored.select(*columns), batch="first")
    for _ in range(2):
        serving.merge_into(spark, table, moved(fx.updates_of(scored)).select(*columns), batch="second")
    return table


@query("serving_merge", "S12, J5 (rows found through the id directory)", sql(f"SELECT id, {', '.join(GOLD)} FROM served", "served"))
def q_serving_merge(spark, sf):
    return lake.read_serving(spark, served(spark, sf))


@query("serving_ids", "S12, J5 (the id directory alone)", sql("SELECT id, date FROM served", "served"))
def q_serving_ids(spark, sf):
    return serving.directory(spark, served(spark, sf))


@query("rollup_totals", "A1 (running totals alone)", sql(f"""
SELECT count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real,
       coalesce(round_even({FAKE_N}::DOUBLE / count(*) * 100, 1), 0.0) AS fake_pct,
       coalesce(round_even({REAL_N}::DOUBLE / count(*) * 100, 1), 0.0) AS real_pct
FROM served""", "served"))
def q_rollup_totals(spark, sf):
    return stats.totals(None, serving.rollup_summary(serving.rollup(spark, served(spark, sf))))


@query("rollup_breakdown", "A2, A4 (running totals alone)", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real
FROM served GROUP BY source ORDER BY total DESC, source ASC NULLS FIRST LIMIT 10""", "served"))
def q_rollup_breakdown(spark, sf):
    return stats.breakdown(None, summary=serving.rollup_summary(serving.rollup(spark, served(spark, sf))))


@query("rollup_fake_rate", "A3 (running totals alone)", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake_count, {FAKE_N}::DOUBLE / count(*) AS fake_rate
FROM served GROUP BY source HAVING count(*) >= 3 ORDER BY fake_rate DESC, source ASC NULLS FIRST LIMIT 10""", "served"))
def q_rollup_fake_rate(spark, sf):
    return stats.fake_rate(None, summary=serving.rollup_summary(serving.rollup(spark, served(spark, sf))))


@query("rollup_timeline", "A5 (running totals alone, all hours)", sql(f"""
SELECT strftime(scored_at, '%Y-%m-%dT%H:00') AS hour, {FAKE_N} AS fake, {REAL_N} AS real, {FAKE_N} + {REAL_N} AS total
FROM served GROUP BY 1""", "served"))
def q_rollup_timeline(spark, sf):
    return serving.rollup_timeline(serving.rollup(spark, served(spark, sf)))


@query("rollup_kpi", "A11 (running totals, newest hour of the table)", sql("""
SELECT count(*) AS total, count(DISTINCT source) AS sources, round(avg(confidence), 6) AS avg_confidence, max(scored_at) AS last_scored_at
FROM served""", "served"))
def q_rollup_kpi(spark, sf):
    return serving.rollup_kpi(spark, served(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("serving_rebuild", "S12 (table, directory and totals made anew from gold)", sql(f"""
SELECT s.source, s.total, s.fake, s.real, d.ids FROM (
  SELECT source, count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real FROM f3 GROUP BY source) s, (SELECT count(DISTINCT id) AS ids FROM f3) d""", "f3"))
def q_serving_rebuild(spark, sf):
    table = work_dir(spark, "serving")
    serving.rebuild(spark, fx.articles_scored(spark, sf), table)
    ids = serving.directory(spark, table).count()
    return serving.rollup_summary(serving.rollup(spark, table)).withColumn("ids", F.lit(ids).cast("long"))
