"""Streams at size: spans of several files are one micro-batch, files and batches follow the rows and not dates times writers."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from credlake.operators.clean import silver_filter
from credlake.schemas import ENVELOPE_SCHEMA, GOLD_SCHEMA, RAW_SCHEMA, SILVER_SCHEMA
from credlake.session import LISTING, few_tasks, work_dir
from credlake.sources import fixtures as fx
from credlake.sources import lake
from credlake.sources.envelopes import parse_envelopes
from credlake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def test_spans_of_several_files_keep_the_order_of_copies_and_are_one_batch_each(spark, monkeypatch):
    monkeypatch.setattr(fx, "FILE_BYTES", 2_000)
    rows = [(f"i{k % 37}", "s", "t", "word " * 20, "u", T0, T0, T0.date(), "Fake", 0.6, T0 + dt.timedelta(minutes=k)) for k in range(400)]
    rows += [("late", "z", "t", "c", "u", T0, T0, T0.date(), "Fake", 0.6, T0 + dt.timedelta(minutes=1599))]  # a span of one row
    root = work_dir(spark, "spans")
    fx.land_in_time_order(spark.createDataFrame(rows, GOLD_SCHEMA), root, "scored_at", ["scored_at", "id"], 4)
    files = [fx.files_per_part(spark, root, k) for k in range(4)]
    assert files[0] > 1 and len(set(files)) == 1
    landed = spark.read.schema(GOLD_SCHEMA).parquet(f"{root}/part=*")
    assert sorted(map(tuple, landed.collect())) == sorted(rows)
    of_file = landed.groupBy("id").agg(F.count_distinct("_metadata.file_path").alias("n"))
    assert of_file.where("n > 1").count() == 0  # copies of a span are in one file, in order of time
    in_file = landed.select("_metadata.file_path", "_metadata.row_index", "scored_at").orderBy("file_path", "row_index").collect()
    assert all(a.scored_at <= b.scored_at for a, b in zip(in_file, in_file[1:]) if a.file_path == b.file_path)
    out, ckpt = work_dir(spark, "counter"), work_dir(spark, "c")
    stream = spark.readStream.schema(GOLD_SCHEMA).option("maxFilesPerTrigger", str(files[0])).parquet(f"{root}/part=*")
    jobs.run_feed_counter(stream, out, ckpt).awaitTermination()
    assert [(r.n, r.last_source) for r in jobs.feed_counter_table(spark, out).orderBy("batch_id").collect()] == [(400, "s"), (1, "z")]


def silver_rows(day, n, copies):
    d = day + dt.timedelta(days=n)
    return [(f"i{n}-{k}", "s", "title", "c", "u", d.isoformat(), "2024-01-01T00:00:00+00:00", "s", T0, "en", d) for k in range(copies)]


def test_old_dates_have_few_writers_and_todays_date_keeps_its_eighth(spark):
    rows = [r for n in range(20) for r in silver_rows(T0.date(), n, 60)]
    today = [r for r in silver_rows(dt.datetime.now(dt.timezone.utc).date(), 0, 400)]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stateful stream
    try:
        dealt = jobs.by_date(spark.createDataFrame(rows + today, SILVER_SCHEMA)).withColumn("task", F.spark_partition_id())
        writers = {r.date: r.n for r in dealt.groupBy("date").agg(F.count_distinct("task").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(writers[T0.date() + dt.timedelta(days=n)] for n in range(20)) <= jobs.OLD_DATE_WRITERS
    assert writers[today[0][-1]] > jobs.OLD_DATE_WRITERS


def test_score_stream_takes_many_small_dates_in_one_batch(spark):
    base, ckpt = work_dir(spark, "l"), work_dir(spark, "c")
    rows = [r for n in range(40) for r in silver_rows(T0.date(), n, 1)]
    spark.createDataFrame(rows, SILVER_SCHEMA).write.partitionBy("date").parquet(f"{base}/silver")
    q = jobs.run_score_stream(spark, base, ckpt, scored_at=lambda b: F.col("fetched_at"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 1
    assert lake.read_layer(spark, f"{base}/gold", "gold").count() == 40


def test_gold_of_an_old_date_has_one_writer_a_label(spark):
    rows = [r for n in range(20) for r in silver_rows(T0.date(), n, 60)]
    labelled = spark.createDataFrame(rows, SILVER_SCHEMA).withColumn("label", F.when(F.crc32("id") % 2 == 0, "Fake").otherwise("Real"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        dealt = jobs.by_date(labelled, "label").withColumn("task", F.spark_partition_id())
        writers = dealt.groupBy("date", "label").agg(F.count_distinct("task").alias("n"))
        assert {r.n for r in writers.collect()} == {1} and writers.count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def small_silver(spark, days):
    base = work_dir(spark, "l")
    rows = [r for n in range(days) for r in silver_rows(T0.date(), n, 1)]
    spark.createDataFrame(rows, SILVER_SCHEMA).write.partitionBy("date").parquet(f"{base}/silver")
    return base


def test_many_small_files_are_scored_and_listed_in_few_tasks(spark):
    base, ckpt = small_silver(spark, 40), work_dir(spark, "c")
    q = jobs.run_score_stream(spark, base, ckpt, scored_at=lambda b: F.col("fetched_at"))
    q.awaitTermination()
    assert f"Coalesce {few_tasks(spark, lake.SCORE_BYTES_PER_TRIGGER)}" in q._jsq.explainInternal(False)
    assert int(spark.conf.get(LISTING)) < 40 and few_tasks(spark) < 40 < few_tasks(spark, 1 << 33)
    assert lake.read_layer(spark, f"{base}/gold", "gold").count() == 40


def test_an_inventory_of_many_small_files_is_few_tasks(spark):
    inventory = lake.layer_inventory(spark, small_silver(spark, 40))
    assert f"Coalesce {few_tasks(spark)}" in inventory._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, inventory.collect())) == [("bronze", False, 0, 0), ("gold", False, 0, 0), ("silver", True, 40, 40)]


def test_a_message_is_parsed_once_and_as_before(spark):
    values = ['{"id":"a","title":"T","published_at":"2024-01-02T00:00:00+00:00"}', '{"id":"b","title":"cut', "not json", "", None, "{}", '{"title":"no id"}',
              '[{"id":"c","title":"in a list"}]', '{"id":5,"title":{"x":1},"content":[1]}', '{"id":"d","id":"e","title":null}', '{"id":"f"} rest']
    df = spark.createDataFrame([(str(k), v, T0) for k, v in enumerate(values)], ENVELOPE_SCHEMA)
    article = F.from_json("value", RAW_SCHEMA)
    each = df.where(article["id"].isNotNull()).select(*[article[f].alias(f) for f in RAW_SCHEMA.fieldNames()], F.col("key").alias("kafka_key"))
    parsed = parse_envelopes(df)
    assert sorted(map(str, parsed.drop("kafka_ts", "date").collect())) == sorted(map(str, each.collect()))
    assert silver_filter(parsed)._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
