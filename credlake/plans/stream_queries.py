"""Catalogue: streaming jobs, checked against their batch twins.

Each query lands the driver-derived envelopes (F2) or scored rows (F3) as
four spans of time under the shared checkpoint folder, drains them with
``availableNow`` one span per micro-batch, and returns the batch read of the
job's output.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.operators import seen
from credlake.plans.oracle import score_conf, score_label, sql
from credlake.plans.registry import query
from credlake.schemas import GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources import fixtures as fx
from credlake.sources import lake
from credlake.sources.envelopes import read_envelopes
from credlake.streaming import jobs

def five_seconds():
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(5))


def _stage_envelopes(spark, sf):
    root = work_dir(spark, "envelopes")
    fx.write_envelopes(spark, sf, root, 4)
    return root


def _env_stream(spark, root):
    return read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=max(1, fx.files_per_part(spark, root)))


def _stage_scored(spark, sf):
    root = work_dir(spark, "scored")
    sc = fx.articles_scored(spark, sf).select(*GOLD_SCHEMA.fieldNames())
    return fx.land_in_time_order(sc, root, "scored_at", ["scored_at", "id"], 4)


def _scored_stream(spark, root):
    return (spark.readStream.schema(GOLD_SCHEMA).option("maxFilesPerTrigger", str(max(1, fx.files_per_part(spark, root))))
            .parquet(f"{root}/part=*"))


def _scored_at(batch):
    return F.col("fetched_at") + five_seconds()


ENV_OK = "doc_id % 97 <> 0 AND doc_id % 89 <> 0"

PARSED_SQL = sql(f"""
SELECT id, source, title, content, url, published_at, fetched_at, source AS kafka_key,
       CAST(fetched_at AS TIMESTAMP) AS kafka_ts, CAST(CAST(published_at AS TIMESTAMP) AS DATE) AS date
FROM f1t WHERE {ENV_OK}""", "f1t")

# the copy of an article that arrives first: messages land in order of (time, doc_id)
FIRST_SILVER = f"""
SELECT t.id, t.source, trim(t.title) AS title, coalesce(trim(t.content), '') AS content, t.url, t.published_at, t.fetched_at,
       t.source AS kafka_key, CAST(t.fetched_at AS TIMESTAMP) AS kafka_ts, 'en' AS lang_guess,
       CAST(CAST(t.published_at AS TIMESTAMP) AS DATE) AS date
FROM f1t t WHERE {ENV_OK} AND title IS NOT NULL AND length(title) > 0 AND regexp_matches(trim(title), '[A-Za-z]')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(fetched_at AS TIMESTAMP), doc_id) = 1"""

SILVER_SQL = sql(FIRST_SILVER, "f1t")

GOLD_SQL = sql(f"""
SELECT id, source, title, content, url, CAST(published_at AS TIMESTAMP) AS published_at, CAST(fetched_at AS TIMESTAMP) AS fetched_at,
       date, {score_label('mt')} AS label, {score_conf('mt')} AS confidence,
       CAST(fetched_at AS TIMESTAMP) + to_seconds(5) AS scored_at
FROM (SELECT *, substr(coalesce(title, '') || '. ' || coalesce(content, ''), 1, 4000) AS mt FROM ({FIRST_SILVER}))""", "f1t")


@query("bronze_stream", "S1, S4, S6, W1, W2, W3", PARSED_SQL)
def q_bronze_stream(spark, sf):
    root = _stage_envelopes(spark, sf)
    base, ckpt = work_dir(spark, "lake"), work_dir(spark, "ckpt")
    jobs.run_bronze(_env_stream(spark, root), base, ckpt).awaitTermination()
    return lake.read_layer(spark, f"{base}/bronze", "bronze").select(
        "id", "source", "title", "content", "url", "published_at", "fetched_at", "kafka_key",
        "kafka_ts", "date")


def _silver(spark, sf, **options):
    root = _stage_envelopes(spark, sf)
    base, ckpt = work_dir(spark, "lake"), work_dir(spark, "ckpt")
    jobs.run_silver(_env_stream(spark, root), base, ckpt, **options).awaitTermination()
    return base, ckpt


@query("silver_stream", "S7, C1, D1, W4", SILVER_SQL)
def q_silver_stream(spark, sf):
    base, _ = _silver(spark, sf)
    return lake.read_layer(spark, f"{base}/silver", "silver")


@query("silver_bounded", "S7, C1, D2", SILVER_SQL)
def q_silver_bounded(spark, sf):
    base, _ = _silver(spark, sf, dedupe_delay="7 days")
    return lake.read_layer(spark, f"{base}/silver", "silver")


@query("silver_seen", "S7, C1, D1, J3 (day filters and an exact check instead of state)", SILVER_SQL)
def q_silver_seen(spark, sf):
    root = _stage_envelopes(spark, sf)
    base, ckpt = work_dir(spark, "lake"), work_dir(spark, "ckpt")
    jobs.run_silver_seen(_env_stream(spark, root), base, ckpt).awaitTermination()
    return jobs.read_silver_seen(spark, base)


@query("new_by_filter", "D3, J3 (seen ids found through day filters)", sql("""
SELECT id, min(scored_at) AS scored_at FROM f4 WHERE id NOT IN (SELECT id FROM f3) GROUP BY id""", "f3", "f4"))
def q_new_by_filter(spark, sf):
    stored = work_dir(spark, "stored")
    lake.write_by_date(fx.articles_scored(spark, sf).select("id", "date"), stored)
    stored = spark.read.schema("id string, date date").parquet(stored)
    filters = seen.day_filters(stored)
    return seen.drop_seen(fx.updates(spark, sf).select("id", "scored_at"), filters, stored, order_by=["scored_at"])


@query("score_stream", "S8, S9, S10, S11, W5, P14-default", GOLD_SQL)
def q_score_stream(spark, sf):
    base, ckpt = _silver(spark, sf)
    jobs.run_score_stream(spark, base, ckpt, scored_at=_scored_at).awaitTermination()
    return lake.read_layer(spark, f"{base}/gold", "gold")


def _chain(spark, root, serving):
    """One full pass from the raw messages, with layers and checkpoints of its own."""
    base, ckpt = work_dir(spark, "lake"), work_dir(spark, "ckpt")
    jobs.run_chain(spark, lambda: _env_stream(spark, root), base, ckpt, serving, _scored_at)


@query("lake_chain", "W9, S12 (serving table)", GOLD_SQL)
def q_lake_chain(spark, sf):
    serving = work_dir(spark, "serving")
    _chain(spark, _stage_envelopes(spark, sf), serving)
    return lake.read_serving(spark, serving)


@query("lake_chain_replay", "W9 replay: a second pass from raw leaves the merged table unchanged", GOLD_SQL)
def q_lake_chain_replay(spark, sf):
    root, serving = _stage_envelopes(spark, sf), work_dir(spark, "serving")
    for _ in range(2):
        _chain(spark, root, serving)
    return lake.read_serving(spark, serving)


@query("timeline_stream", "W6", sql("""
SELECT strftime(date_trunc('hour', scored_at), '%Y-%m-%dT%H:00') AS hour,
       count(*) FILTER (WHERE label = 'Fake') AS fake, count(*) FILTER (WHERE label = 'Real') AS real,
       count(*) FILTER (WHERE label IN ('Fake', 'Real')) AS total
FROM f3 GROUP BY 1""", "f3"))
def q_timeline_stream(spark, sf):
    root = _stage_scored(spark, sf)
    out, ckpt = work_dir(spark, "timeline"), work_dir(spark, "ckpt")
    jobs.run_timeline_stream(_scored_stream(spark, root), out, ckpt).awaitTermination()
    return jobs.latest_rows(spark, out, "hour")


@query("breakdown_stream", "W7", sql("""
SELECT source, count(*) AS total, count(*) FILTER (WHERE label = 'Fake') AS fake,
       count(*) FILTER (WHERE label = 'Real') AS real
FROM f3 GROUP BY source""", "f3"))
def q_breakdown_stream(spark, sf):
    root = _stage_scored(spark, sf)
    out, ckpt = work_dir(spark, "breakdown"), work_dir(spark, "ckpt")
    jobs.run_breakdown_stream(_scored_stream(spark, root), out, ckpt).awaitTermination()
    return jobs.latest_rows(spark, out, "source")


@query("feed_counter", "W8", sql("""
SELECT row_number() OVER (ORDER BY part) - 1 AS batch_id, n, CAST(sum(n) OVER (ORDER BY part) AS BIGINT) AS running_n, last_source
FROM (SELECT part, count(*) AS n, last(source ORDER BY scored_at, id) AS last_source
      FROM (SELECT source, scored_at, id, floor((s - min(s) OVER ()) * 4 / (max(s) OVER () - min(s) OVER () + 1)) AS part
            FROM (SELECT *, floor(epoch(scored_at)) AS s FROM f3)) GROUP BY part)""", "f3"))
def q_feed_counter(spark, sf):
    root = _stage_scored(spark, sf)
    out, ckpt = work_dir(spark, "counter"), work_dir(spark, "ckpt")
    jobs.run_feed_counter(_scored_stream(spark, root), out, ckpt).awaitTermination()
    return jobs.feed_counter_table(spark, out)


@query("stream_dedupe_bounded", "D2", sql(f"SELECT DISTINCT id FROM f1 WHERE {ENV_OK}", "f1"))
def q_stream_dedupe_bounded(spark, sf):
    root = _stage_envelopes(spark, sf)
    out, ckpt = work_dir(spark, "dedupe"), work_dir(spark, "ckpt")
    jobs.run_bounded_dedupe(_env_stream(spark, root), out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("id")


@query("layer_inventory", "S18", sql(f"""
SELECT 'bronze' AS tier, true AS exists, count(*) AS rows FROM f1t WHERE {ENV_OK}
UNION ALL SELECT t.tier, true, s.n FROM (VALUES ('silver'), ('gold')) t(tier), (SELECT count(*) AS n FROM ({FIRST_SILVER})) s""", "f1t"))
def q_layer_inventory(spark, sf):
    root = _stage_envelopes(spark, sf)
    base, ckpt = work_dir(spark, "lake"), work_dir(spark, "ckpt")
    for q in jobs.run_clean(lambda: _env_stream(spark, root), base, ckpt):
        q.awaitTermination()
    jobs.run_score_stream(spark, base, ckpt, scored_at=_scored_at).awaitTermination()
    return lake.layer_inventory(spark, base).select("tier", "exists", "rows")


@query("timeline_corrected", "W6 (late rows kept: newest files first, a one-hour delay)", sql("""
SELECT strftime(date_trunc('hour', scored_at), '%Y-%m-%dT%H:00') AS hour,
       count(*) FILTER (WHERE label = 'Fake') AS fake, count(*) FILTER (WHERE label = 'Real') AS real,
       count(*) FILTER (WHERE label IN ('Fake', 'Real')) AS total
FROM f3 GROUP BY 1""", "f3"))
def q_timeline_corrected(spark, sf):
    root, backwards = _stage_scored(spark, sf), work_dir(spark, "backwards")
    for k in range(4):  # a file stream takes files in the order in which they were written
        spark.read.schema(GOLD_SCHEMA).parquet(f"{root}/part={3 - k}").write.parquet(f"{backwards}/part={k}")
    out, ckpt = work_dir(spark, "timeline"), work_dir(spark, "ckpt")
    jobs.run_timeline_kept(_scored_stream(spark, backwards), out, ckpt, "1 hour").awaitTermination()
    return jobs.kept_timeline(spark, out)


@query("state_audit", "W2, W4 (the state store's ids against silver's)", sql(f"""
SELECT DISTINCT id, true AS in_silver, true AS in_state FROM ({FIRST_SILVER})""", "f1t"))
def q_state_audit(spark, sf):
    base, ckpt = _silver(spark, sf)
    return jobs.state_audit(spark, base, ckpt)
