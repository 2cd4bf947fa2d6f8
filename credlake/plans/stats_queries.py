"""Catalogue: statistics, charts, joins over scored articles."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.operators import stats
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.session import work_dir
from credlake.sources import fixtures as fx
from credlake.sources import lake

FAKE_N = "count(*) FILTER (WHERE label = 'Fake')"
REAL_N = "count(*) FILTER (WHERE label = 'Real')"


@query("totals", "A1", sql(f"""
SELECT count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real,
       coalesce(round_even({FAKE_N}::DOUBLE / count(*) * 100, 1), 0.0) AS fake_pct,
       coalesce(round_even({REAL_N}::DOUBLE / count(*) * 100, 1), 0.0) AS real_pct
FROM f3""", "f3"))
def q_totals(spark, sf):
    return stats.totals(fx.articles_scored(spark, sf))


@query("totals_shared", "A1 (from the shared per-source aggregate)", sql(f"""
SELECT count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real,
       coalesce(round_even({FAKE_N}::DOUBLE / count(*) * 100, 1), 0.0) AS fake_pct,
       coalesce(round_even({REAL_N}::DOUBLE / count(*) * 100, 1), 0.0) AS real_pct
FROM f3""", "f3"))
def q_totals_shared(spark, sf):
    sc = fx.articles_scored(spark, sf)
    return stats.totals(sc, stats.source_summary(sc))


def _one_file_layers(spark, sf):
    """Silver and gold of F3 with one file per partition, so that SQL can tell the number of files."""
    base = work_dir(spark, "layers")
    sc = fx.articles_scored(spark, sf)
    for layer in ("silver", "gold"):
        parts = lake.LAYER_PARTITIONS[layer]
        rows = sc.select(*(F.col(f.name) if f.name in sc.columns else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in lake.LAYER_SCHEMAS[layer]))
        rows.repartition(*parts).write.partitionBy(*parts).parquet(f"{base}/{layer}")
    return base


@query("totals_footers", "A1 (from file footers)", sql(f"""
SELECT count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real,
       coalesce(round_even({FAKE_N}::DOUBLE / count(*) * 100, 1), 0.0) AS fake_pct,
       coalesce(round_even({REAL_N}::DOUBLE / count(*) * 100, 1), 0.0) AS real_pct
FROM f3""", "f3"))
def q_totals_footers(spark, sf):
    counts = lake.footer_counts(spark, f"{_one_file_layers(spark, sf)}/gold", "gold")
    return stats.totals(counts, stats.label_counts_summary(counts))


@query("inventory_footers", "S18 (from file footers)", sql("""
SELECT 'bronze' AS tier, false AS exists, 0 AS files, 0 AS rows, 0 AS partitions, NULL::DATE AS first_date, NULL::DATE AS last_date
UNION ALL SELECT 'silver', true, count(DISTINCT date), count(*), count(DISTINCT date), min(date), max(date) FROM f3
UNION ALL SELECT 'gold', true, count(DISTINCT (date, label)), count(*), count(DISTINCT (date, label)), min(date), max(date) FROM f3""", "f3"))
def q_inventory_footers(spark, sf):
    return lake.footer_inventory(spark, _one_file_layers(spark, sf))


@query("top_sources", "A2", sql("""
SELECT source, count(*) AS count FROM f3 GROUP BY source
ORDER BY count DESC, source ASC NULLS FIRST LIMIT 10""", "f3"))
def q_top_sources(spark, sf):
    return stats.top_sources(fx.articles_scored(spark, sf))


@query("fake_rate", "A3", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake_count, {FAKE_N}::DOUBLE / count(*) AS fake_rate
FROM f3 GROUP BY source HAVING count(*) >= 3
ORDER BY fake_rate DESC, source ASC NULLS FIRST LIMIT 10""", "f3"))
def q_fake_rate(spark, sf):
    return stats.fake_rate(fx.articles_scored(spark, sf))


@query("fake_rate_rounded", "A3b", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake_count,
       round_even({FAKE_N}::DOUBLE / count(*), 3) AS fake_rate
FROM f3 GROUP BY source HAVING count(*) >= 1
ORDER BY fake_rate DESC, source ASC NULLS FIRST LIMIT 10""", "f3"))
def q_fake_rate_rounded(spark, sf):
    return stats.fake_rate(fx.articles_scored(spark, sf), min_total=1, digits=3)


@query("breakdown", "A4", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real
FROM f3 GROUP BY source ORDER BY total DESC, source ASC NULLS FIRST LIMIT 10""", "f3"))
def q_breakdown(spark, sf):
    return stats.breakdown(fx.articles_scored(spark, sf))


@query("breakdown_rest", "A4b", sql(f"""
SELECT source, count(*) AS total, {FAKE_N} AS fake, count(*) - {FAKE_N} AS real
FROM f3 GROUP BY source ORDER BY total DESC, source ASC NULLS FIRST LIMIT 10""", "f3"))
def q_breakdown_rest(spark, sf):
    return stats.breakdown(fx.articles_scored(spark, sf), real_mode="rest")


TIMELINE_SQL = f"""
SELECT strftime(scored_at, '%Y-%m-%dT%H:00') AS hour, {FAKE_N} AS fake, {REAL_N} AS real,
       {FAKE_N} + {REAL_N} AS total
FROM f3 WHERE scored_at >= (SELECT as_of FROM as_of) - INTERVAL 24 HOUR
GROUP BY 1"""


@query("timeline", "A5", sql(TIMELINE_SQL + " ORDER BY hour", "f3", "as_of"))
def q_timeline(spark, sf):
    return stats.timeline(fx.articles_scored(spark, sf))


@query("timeline_week", "A5 (hours=168)", sql(TIMELINE_SQL.replace("24 HOUR", "168 HOUR"),
                                             "f3", "as_of"))
def q_timeline_week(spark, sf):
    return stats.timeline(fx.articles_scored(spark, sf), hours=168)


@query("kpi", "A11", sql("""
SELECT count(*) AS total, count(DISTINCT source) AS sources,
       round(avg(confidence), 6) AS avg_confidence, max(scored_at) AS last_scored_at
FROM f3""", "f3"))
def q_kpi(spark, sf):
    k = stats.kpi(fx.articles_scored(spark, sf))
    return k.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("kpi_approx", "A11b", sql("""
SELECT count(*) AS total, approx_count_distinct(source) AS sources,
       round(avg(confidence), 6) AS avg_confidence, max(scored_at) AS last_scored_at
FROM f3""", "f3"))
def q_kpi_approx(spark, sf):
    """HyperLogLog sketches in both engines; at the fixtures' cardinality (20
    sources) both estimates are exact, so the oracle compares values."""
    k = stats.kpi(fx.articles_scored(spark, sf), approx=True)
    return k.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("chart_pie", "A12 pie", sql(f"""
SELECT 'Real News' AS name, coalesce(round_even({REAL_N}::DOUBLE / count(*) * 100, 1), 0.0) AS value FROM f3
UNION ALL
SELECT 'Fake News', coalesce(round_even({FAKE_N}::DOUBLE / count(*) * 100, 1), 0.0) FROM f3""", "f3"))
def q_chart_pie(spark, sf):
    return stats.chart_pie(fx.articles_scored(spark, sf))


@query("chart_bars", "A12 bars, P21", sql(f"""
SELECT CASE WHEN length(source) > 20 THEN substr(source, 1, 20) || '...' ELSE source END AS category,
       real, fake, total
FROM (SELECT source, count(*) AS total, {FAKE_N} AS fake, {REAL_N} AS real
      FROM f3 GROUP BY source ORDER BY total DESC, source ASC NULLS FIRST LIMIT 7)""", "f3"))
def q_chart_bars(spark, sf):
    return stats.chart_bars(fx.articles_scored(spark, sf))


@query("chart_timeline", "A12 timeline label", sql(f"""
SELECT coalesce(nullif(split_part(hour, 'T', 2), ''), hour) AS hour, fake, real, total
FROM ({TIMELINE_SQL})""", "f3", "as_of"))
def q_chart_timeline(spark, sf):
    return stats.chart_timeline(stats.timeline(fx.articles_scored(spark, sf)))


@query("source_analysis", "J1, P21", sql(f"""
SELECT CASE WHEN length(t.source) > 25 THEN substr(t.source, 1, 25) || '...' ELSE t.source END AS source,
       t.count, coalesce(nullif(r.fake_rate, 0.0) * 100, 0.0) AS fake_rate_pct,
       100.0 - coalesce(nullif(r.fake_rate, 0.0) * 100, 0.0) AS real_rate_pct
FROM (SELECT source, count(*) AS count FROM f3 GROUP BY source
      ORDER BY count DESC, source ASC NULLS FIRST LIMIT 10) t
LEFT JOIN (SELECT source, {FAKE_N}::DOUBLE / count(*) AS fake_rate FROM f3 GROUP BY source
           HAVING count(*) >= 3 ORDER BY fake_rate DESC, source ASC NULLS FIRST LIMIT 10) r
  ON t.source = r.source
ORDER BY t.count DESC, t.source ASC NULLS FIRST LIMIT 5""", "f3"))
def q_source_analysis(spark, sf):
    return stats.source_analysis(fx.articles_scored(spark, sf))


@query("landed", "J2", sql("""
SELECT (SELECT count(DISTINCT id) FROM f4) AS expected,
       (SELECT count(DISTINCT id) FROM f4 WHERE id IN (SELECT id FROM f3)) AS found""", "f3", "f4"))
def q_landed(spark, sf):
    return stats.landed(fx.articles_scored(spark, sf), fx.updates(spark, sf))


@query("kpi_sketch", "A11b (merged daily sketches, the newest three days)", sql("""
SELECT count(*) AS total, count(DISTINCT source) AS sources, round(avg(confidence), 6) AS avg_confidence, max(scored_at) AS last_scored_at
FROM f3 WHERE date >= (SELECT max(date) FROM f3) - 2""", "f3"))
def q_kpi_sketch(spark, sf):
    path = work_dir(spark, "sketches")
    stats.daily_sketches(fx.articles_scored(spark, sf)).write.parquet(path)
    days = spark.read.parquet(path)
    newest = F.lit(days.agg(F.max("date")).first()[0])
    return stats.sketch_kpi(days, first=F.date_sub(newest, 2)).withColumn("avg_confidence", F.round("avg_confidence", 6))
