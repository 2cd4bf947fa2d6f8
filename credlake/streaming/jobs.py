"""Structured Streaming jobs.

clean   : raw envelopes -> bronze (verbatim parse) and silver (cleaned, deduped)
score   : silver file stream -> scored once -> gold (file sink, exactly-once)
publish : gold file stream -> scored envelopes + keyed merge into the serving
          table (one foreachBatch, replay-safe merge)
live    : hourly timeline (W6) and per-source totals (W7) kept as streams
counter : per-batch feed summary (W8)

Every job has its own checkpoint; tests drain input with ``availableNow``,
deployments pass a processing-time trigger (the reference uses 30 s).
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from credlake.operators import seen
from credlake.operators.clean import clean, dedupe_within, silver_filter
from credlake.operators.score import score_default
from credlake.schemas import GOLD_COLUMNS, SILVER_SCHEMA
from credlake.session import few_tasks, list_in_few_tasks
from credlake.sources import lake
from credlake.sources.envelopes import parse_envelopes, to_scored_envelope
from credlake.sources.lake import trigger_args
from credlake.sources.serving import merge_into

ScoredAt = Callable[[DataFrame], Column]


OLD_DATE_WRITERS = 2  # of a date before yesterday


def by_date(df: DataFrame, *also: str) -> DataFrame:
    """Deal a micro-batch to its writers by (date, id salt) before a date-partitioned write.

    Without it every upstream task writes one file into every date it holds.
    The number of writers is the session's number of shuffle partitions, and
    hash partitioning samples nothing, so a stateful operator below runs once.
    The salt lets a date that holds all rows of a batch (today's news) use an
    eighth of the writers.  Dates before yesterday come in numbers (a backfill,
    a replay) and have ``OLD_DATE_WRITERS``: their files grow with the dates, not
    with dates times writers.  Dealt by a further column (gold's label), a date's rows
    go to several writers as it is, and an old date has one for each of its values.
    """
    splits = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    recent = F.coalesce(F.col("date") >= F.date_sub(F.current_date(), 1), F.lit(True))
    salts = F.when(recent, F.lit(splits)).otherwise(F.lit(1 if also else min(splits, OLD_DATE_WRITERS)))
    return df.repartition("date", *also, F.pmod(F.xxhash64("id"), salts))


def run_bronze(src: DataFrame, base: str, ckpt: str, trigger: str | None = None) -> StreamingQuery:
    """S1 -> S4 -> S6: verbatim parsed envelopes, partitioned by date."""
    return lake.write_layer(by_date(parse_envelopes(src)), f"{base}/bronze", f"{ckpt}/bronze", ("date",), trigger)


def run_silver(src: DataFrame, base: str, ckpt: str, trigger: str | None = None,
               dedupe_delay: str | None = None) -> StreamingQuery:
    """S1 -> S4 -> C1 -> S7.

    By default D1: whole-history first-arrival dedupe, as the reference does --
    the state keeps every id ever seen.  ``dedupe_delay`` (e.g. ``"7 days"``)
    switches to D2: an id is remembered for that long after it arrived and then
    evicted, so the state stays bounded by the delay.
    """
    parsed = parse_envelopes(src)
    silver = dedupe_within(silver_filter(parsed), "id", dedupe_delay) if dedupe_delay else clean(parsed)
    return lake.write_layer(by_date(silver.select(*SILVER_SCHEMA.fieldNames())), f"{base}/silver", f"{ckpt}/silver", ("date",), trigger)


def run_silver_seen(src: DataFrame, base: str, ckpt: str, trigger: str | None = None, bits: int = seen.BITS,
                    keep_days: int | None = None) -> StreamingQuery:
    """S7 without a state store: D1 by day filters and an exact check (see :mod:`credlake.operators.seen`).

    Every micro-batch keeps the first row of each id that no earlier batch stored, in a
    folder of its own; a retry overwrites that folder and does not count it as stored.
    The filters are written after the rows, so a row is never taken for seen before it is there.
    """
    rows_at, filters_at = f"{base}/silver_seen", f"{base}/silver_filters"
    list_in_few_tasks(src.sparkSession)
    tasks = few_tasks(src.sparkSession)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        stored = read_silver_seen(spark, base, with_batch=True).where(F.col("batch_id") != batch_id)
        fresh = seen.drop_seen(rows, seen.read_filters(spark, filters_at, keep_days), stored, bits=bits)
        folder = f"{rows_at}/batch_id={batch_id}"
        by_date(fresh).write.mode("overwrite").partitionBy("date").parquet(folder)
        written = spark.read.schema(SILVER_SCHEMA).parquet(folder).select("id", "date").coalesce(tasks).persist()
        seen.add_filters(written, filters_at, str(batch_id), bits, keep_days)
        written.unpersist()
        rows.unpersist()

    cleaned = silver_filter(parse_envelopes(src)).select(*SILVER_SCHEMA.fieldNames())
    return (cleaned.writeStream.foreachBatch(sink).option("checkpointLocation", f"{ckpt}/silver_seen")
            .trigger(**trigger_args(trigger)).start())


def read_silver_seen(spark: SparkSession, base: str, with_batch: bool = False) -> DataFrame:
    """The rows kept by :func:`run_silver_seen`."""
    path = f"{base}/silver_seen"
    columns = [*SILVER_SCHEMA.fieldNames(), *(["batch_id"] if with_batch else [])]
    schema = StructType([*SILVER_SCHEMA.fields, StructField("batch_id", LongType())])
    if not lake.exists(spark, path):
        return spark.createDataFrame([], schema).select(*columns)
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*columns)


def run_clean(src_factory: Callable[[], DataFrame], base: str, ckpt: str,
              trigger: str | None = None, dedupe_delay: str | None = None) -> list[StreamingQuery]:
    """The clean job: bronze and silver queries, each with its own checkpoint."""
    return [run_bronze(src_factory(), base, ckpt, trigger),
            run_silver(src_factory(), base, ckpt, trigger, dedupe_delay=dedupe_delay)]


def run_score_stream(spark: SparkSession, base: str, ckpt: str, scored_at: ScoredAt | None = None,
                     scorer: Callable[[DataFrame], DataFrame] | None = None,
                     trigger: str | None = None, max_files_per_trigger: int | None = None,
                     max_bytes_per_trigger: int | None = lake.SCORE_BYTES_PER_TRIGGER) -> StreamingQuery:
    """S8 -> score -> S9: the silver file stream, scored once, appended to gold.

    A micro-batch takes at most ``max_bytes_per_trigger`` of silver or, where it is given,
    ``max_files_per_trigger`` files.  Silver has files for every date, so a limit of files
    alone makes the number of micro-batches grow with the dates, however small they are.

    Gold is written by Spark's file sink: a micro-batch's files become
    visible (through the sink's metadata log, which batch and stream readers
    of the layer use) only when the batch commits, and a batch id the log
    already holds is skipped -- exactly-once even when the driver dies
    between writing and committing.  The reference scores every row twice
    (two queries over one plan, two different ``scored_at``); here the
    publish side (:func:`run_publish`) reads the scored rows back from gold.
    """
    silver = lake.read_layer(spark, f"{base}/silver", "silver", stream=True, max_files_per_trigger=max_files_per_trigger,
                             max_bytes_per_trigger=None if max_files_per_trigger else max_bytes_per_trigger)
    tasks = few_tasks(spark, max_bytes_per_trigger or 0)
    silver = silver.coalesce(tasks)  # small files by the thousand: the cost is the task, not its rows
    at = scored_at(silver) if scored_at is not None else None
    scored = score_default(silver, at) if scorer is None else scorer(silver)
    gold = by_date(scored.select(*GOLD_COLUMNS), "label")
    return lake.write_layer(gold, f"{base}/gold", f"{ckpt}/score", ("date", "label"), trigger)


def run_publish(spark: SparkSession, base: str, ckpt: str, serving: str | None = None,
                trigger: str | None = None,
                max_bytes_per_trigger: int | None = lake.PUBLISH_BYTES_PER_TRIGGER) -> StreamingQuery:
    """S10 + S12 (S11's second half): the gold stream published as scored
    envelopes and merged into the serving table, in one ``foreachBatch``.

    Both halves may run twice for one batch, and both stand it: the envelopes
    of a batch are a folder of their own, which a retry overwrites, and the
    merge is an upsert by id.

    Each micro-batch takes at most ``max_bytes_per_trigger`` of gold files, so
    a backlog (a restart after an outage, a replay) is merged in bounded
    steps instead of one batch holding all of it.
    """
    gold = lake.read_layer(spark, f"{base}/gold", "gold", stream=True, max_files_per_trigger=None,
                           max_bytes_per_trigger=max_bytes_per_trigger)
    tasks = few_tasks(spark, max_bytes_per_trigger or lake.PUBLISH_BYTES_PER_TRIGGER)
    query = hashlib.sha1(ckpt.encode()).hexdigest()[:12]

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*GOLD_COLUMNS).coalesce(tasks).persist()
        (to_scored_envelope(rows).write.mode("overwrite")
         .parquet(f"{base}/scored_topic/query={query}/batch={batch_id}"))
        if serving:
            merge_into(spark, serving, rows, batch=f"{query}-{batch_id}")
        rows.unpersist()

    return (gold.writeStream.foreachBatch(sink).option("checkpointLocation", f"{ckpt}/publish")
            .trigger(**trigger_args(trigger)).start())


def run_score_job(spark: SparkSession, base: str, ckpt: str, serving: str | None = None,
                  scored_at: ScoredAt | None = None, trigger: str = "30 seconds",
                  max_files_per_trigger: int | None = None) -> list[StreamingQuery]:
    """The score job as deployed: scoring and publishing run side by side,
    each on its own processing-time trigger and checkpoint."""
    return [run_score_stream(spark, base, ckpt, scored_at=scored_at, trigger=trigger,
                             max_files_per_trigger=max_files_per_trigger),
            run_publish(spark, base, ckpt, serving=serving, trigger=trigger)]


def run_chain(spark: SparkSession, src_factory: Callable[[], DataFrame], base: str, ckpt: str,
              serving: str, scored_at: ScoredAt | None = None,
              max_files_per_trigger: int | None = None) -> None:
    """Raw -> bronze + silver -> gold -> envelopes + merge, as chained
    availableNow runs (each stage drains what the previous one committed)."""
    for q in run_clean(src_factory, base, ckpt):
        q.awaitTermination()
    run_score_stream(spark, base, ckpt, scored_at=scored_at,
                     max_files_per_trigger=max_files_per_trigger).awaitTermination()
    run_publish(spark, base, ckpt, serving=serving).awaitTermination()


# -- live aggregates ---------------------------------------------------------

def _keyed_rows(agg: DataFrame, path: str, ckpt: str, trigger: str | None) -> StreamingQuery:
    """Update-mode aggregate kept as keyed rows: each batch writes the keys it
    changed to a folder of its own (a retry overwrites it); :func:`latest_rows`
    reads the newest row of each key, so a reader never meets a half-written
    result."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", ckpt).trigger(**trigger_args(trigger)).start())


def latest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row per key of a :func:`_keyed_rows` result."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
            .select(key, *[F.col(f"v.{c}").alias(c) for c in values]))


def timeline_agg(scored: DataFrame, delay: str | None = None) -> DataFrame:
    """Hourly Fake/Real counts as a stream (tumbling 1-hour windows).

    With ``delay`` (e.g. ``"2 hours"``) an hour's state is dropped once the
    stream is that far past it, and rows later than that are left out; without
    it every hour stays open and every row counts."""
    s = scored.withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    if delay:
        s = s.withWatermark("scored_at", delay)
    return (s.groupBy(F.window("scored_at", "1 hour").alias("w"))
            .agg(F.count_if(F.col("label") == "Fake").alias("fake"),
                 F.count_if(F.col("label") == "Real").alias("real"))
            .select(F.date_format("w.start", "yyyy-MM-dd'T'HH:00").alias("hour"), "fake", "real",
                    (F.col("fake") + F.col("real")).alias("total")))


def run_timeline_stream(scored: DataFrame, path: str, ckpt: str, trigger: str | None = None):
    return _keyed_rows(timeline_agg(scored), path, ckpt, trigger)


HOURS = "side string, hour timestamp, fake long, real long, max_scored_at timestamp"


def run_timeline_kept(scored: DataFrame, path: str, ckpt: str, delay: str = "2 hours", trigger: str | None = None) -> StreamingQuery:
    """W6 with late rows kept: the stream is split at the watermark.

    The watermark of a micro-batch is the latest scored_at of the batches before
    it less ``delay``.  Rows of hours that ended before it are late: they go to the
    corrections, the others to the timeline.  Both are sums per hour and batch, so
    there is no state to grow and no row is left out; a retry overwrites its folder."""
    spark = scored.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = _hour_parts(spark, path).where(F.col("batch_id") < batch_id).agg(F.max("max_scored_at")).first()[0]
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        hour = F.date_trunc("hour", F.col("scored_at").cast("timestamp"))
        late = F.coalesce(hour + F.make_dt_interval(F.lit(0), F.lit(1)) <= mark, F.lit(False))
        sums = batch.groupBy(F.when(late, "late").otherwise("on_time").alias("side"), hour.alias("hour")).agg(
            F.count_if(F.col("label") == "Fake").alias("fake"), F.count_if(F.col("label") == "Real").alias("real"),
            F.max("scored_at").alias("max_scored_at"))
        sums.where("hour is not null").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (scored.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(**trigger_args(trigger)).start())


def _hour_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{HOURS}, batch_id long"
    if not lake.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def kept_timeline(spark: SparkSession, path: str, corrections: bool = True) -> DataFrame:
    """The hours of :func:`run_timeline_kept`; without ``corrections`` as a watermark alone leaves them."""
    parts = _hour_parts(spark, path)
    parts = parts if corrections else parts.where("side = 'on_time'")
    return parts.groupBy(F.date_format("hour", "yyyy-MM-dd'T'HH:00").alias("hour")).agg(
        F.sum("fake").alias("fake"), F.sum("real").alias("real"), F.sum(F.col("fake") + F.col("real")).alias("total"))


def late_hours(spark: SparkSession, path: str) -> DataFrame:
    """The corrections: hour, batch that brought them, rows."""
    return _hour_parts(spark, path).where("side = 'late'").select("hour", "batch_id", (F.col("fake") + F.col("real")).alias("n"))


def breakdown_agg(scored: DataFrame) -> DataFrame:
    """Per-source total / fake / real as a stream."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == "Fake").alias("fake"),
        F.count_if(F.col("label") == "Real").alias("real"))


def run_breakdown_stream(scored: DataFrame, path: str, ckpt: str, trigger: str | None = None):
    return _keyed_rows(breakdown_agg(scored), path, ckpt, trigger)


FEED_COUNTER_SCHEMA = "batch_id long, n long, running_n long, last_source string"


def run_feed_counter(scored: DataFrame, path: str, ckpt: str, trigger: str | None = None):
    """One summary row per micro-batch: n, running_n, last source (latest scored_at).

    The running total is carried from batch to batch: each batch adds its own
    one-row aggregate to the previous batch's total, which is kept after each
    write and read back (one pushed-down row) only when the query (re)starts.
    Nothing ever re-reads or re-orders the whole history.
    """
    spark = scored.sparkSession
    last: dict[str, int] = {}  # batch id and running total of the last written row

    def previous(batch_id: int) -> int:
        if last.get("b") == batch_id - 1:
            return last["n"]
        if batch_id == 0 or not lake.exists(spark, path):
            return 0
        r = (spark.read.schema(FEED_COUNTER_SCHEMA).option("basePath", path).parquet(path)
             .where(F.col("batch_id") == batch_id - 1).select("running_n").first())
        return r[0] if r else 0

    def sink(batch: DataFrame, batch_id: int) -> None:
        row = batch.agg(F.count(F.lit(1)).alias("n"),
                        F.max_by("source", F.struct("scored_at", "id")).alias("last_source")).first()
        running = previous(batch_id) + row["n"]
        summary = spark.createDataFrame([(row["n"], running, row["last_source"])],
                                        "n long, running_n long, last_source string")
        summary.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")  # one row
        last.update(b=batch_id, n=running)

    return (scored.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
            .trigger(**trigger_args(trigger)).start())


def feed_counter_table(spark: SparkSession, path: str) -> DataFrame:
    """Summary rows of the non-empty micro-batches (running total included)."""
    return (spark.read.schema(FEED_COUNTER_SCHEMA).option("basePath", path).parquet(path).where(F.col("n") > 0)
            .select("batch_id", "n", "running_n", "last_source"))


def run_bounded_dedupe(src: DataFrame, path: str, ckpt: str, delay: str = "30 days",
                       trigger: str | None = None) -> StreamingQuery:
    """Parsed envelopes deduped on id within a delay after arrival."""
    d = dedupe_within(parse_envelopes(src), "id", delay)
    return (d.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt)
            .outputMode("append").trigger(**trigger_args(trigger)).start())


def state_ids(spark: SparkSession, ckpt: str, operator: int = 0) -> DataFrame:
    """The ids that a dedupe query's checkpoint remembers, read with Spark's state data source."""
    return spark.read.format("statestore").option("operatorId", operator).load(ckpt).select(F.col("key.id").alias("id"))


def state_audit(spark: SparkSession, base: str, ckpt: str) -> DataFrame:
    """Ids of the silver layer against those in the silver query's state.

    An id in silver alone would be let in again; one in state alone was remembered
    without its row."""
    silver = lake.read_layer(spark, f"{base}/silver", "silver").select("id").distinct().withColumn("in_silver", F.lit(True))
    state = state_ids(spark, f"{ckpt}/silver").withColumn("in_state", F.lit(True))
    return silver.join(state, "id", "full_outer").select(
        "id", F.coalesce("in_silver", F.lit(False)).alias("in_silver"), F.coalesce("in_state", F.lit(False)).alias("in_state"))
