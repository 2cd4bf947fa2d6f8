"""Streaming = batch equivalence, restart safety, replay-safe merges."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from credlake.operators.clean import clean
from credlake.schemas import ENVELOPE_SCHEMA, GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources import lake, serving
from credlake.sources.envelopes import parse_envelopes, read_envelopes
from credlake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def land_envelopes(spark, root, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ENVELOPE_SCHEMA).coalesce(1).write.parquet(f"{root}/part={i}")


def env(i, title, minute, src="s"):
    import json
    art = {"id": f"id{i}", "source": src, "title": title, "content": " c ", "url": f"u{i}",
           "published_at": f"2024-01-0{1 + minute // 1440}T00:00:00+00:00",
           "fetched_at": "2024-01-01T00:00:00+00:00"}
    return (src, json.dumps(art), T0 + dt.timedelta(minutes=minute))


BATCHES = [[env(1, "Alpha", 1), env(2, "Beta", 2), (None, "not json", T0)],
           [env(1, "Alpha", 3), env(3, "漢字", 4), env(4, "Delta", 1500)],
           [env(2, "Beta", 5), env(5, "", 6)]]


def test_bronze_silver_stream_equal_batch(spark):
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    land_envelopes(spark, root, BATCHES)
    src = lambda: read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1)
    for q in jobs.run_clean(src, base, ckpt):
        q.awaitTermination()
    batch = read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", stream=False)
    bronze = lake.read_layer(spark, f"{base}/bronze", "bronze")
    assert sorted(map(tuple, bronze.select("id", "kafka_ts").collect())) == \
        sorted(map(tuple, parse_envelopes(batch).select("id", "kafka_ts").collect()))
    silver = lake.read_layer(spark, f"{base}/silver", "silver")
    assert sorted(r.id for r in silver.collect()) == ["id1", "id2", "id4"]
    assert sorted(r.id for r in clean(parse_envelopes(batch)).collect()) == ["id1", "id2", "id4"]
    # restart from the checkpoint: nothing new, nothing added
    for q in jobs.run_clean(src, base, ckpt):
        q.awaitTermination()
    assert lake.read_layer(spark, f"{base}/silver", "silver").count() == 3
    assert lake.read_layer(spark, f"{base}/bronze", "bronze").count() == 7


def test_silver_bounded_dedupe_option(spark):
    # D2 instead of D1: with every copy inside the delay, the same ids survive
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    land_envelopes(spark, root, BATCHES)
    src = read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1)
    jobs.run_silver(src, base, ckpt, dedupe_delay="1 day").awaitTermination()
    silver = lake.read_layer(spark, f"{base}/silver", "silver")
    assert sorted(r.id for r in silver.collect()) == ["id1", "id2", "id4"]


def test_score_stream_and_serving_replay(spark):
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    land_envelopes(spark, root, BATCHES)
    table = f"{base}/serving"
    src = lambda: read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1)
    at = lambda b: F.col("fetched_at")
    jobs.run_chain(spark, src, base, ckpt, table, at)
    first = sorted(map(tuple, lake.read_serving(spark, table).collect()))
    assert len(first) == 3
    gold = lake.read_layer(spark, f"{base}/gold", "gold")
    assert gold.count() == 3 and spark.read.parquet(f"{base}/scored_topic").count() == 3
    # a replay from raw, scored again into a layer of its own: same merged table
    jobs.run_chain(spark, src, work_dir(spark, "l2"), work_dir(spark, "c2"), table, at)
    assert sorted(map(tuple, lake.read_serving(spark, table).collect())) == first
    # a byte-bounded publish takes the backlog in several micro-batches, same table
    s3 = f"{base}/serving3"
    q = jobs.run_publish(spark, base, work_dir(spark, "c4"), serving=s3, max_bytes_per_trigger=1)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) > 1
    assert sorted(map(tuple, lake.read_serving(spark, s3).collect())) == first


def test_fresh_checkpoint_on_a_written_layer_is_refused(spark):
    root, base = work_dir(spark, "e"), work_dir(spark, "l")
    land_envelopes(spark, root, BATCHES[:1])
    src = lambda: read_envelopes(spark, fmt="parquet", path=f"{root}/part=*")
    ckpt = work_dir(spark, "c")
    jobs.run_silver(src(), base, ckpt).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.run_silver(src(), base, work_dir(spark, "c2"))
    jobs.run_silver(src(), base, ckpt).awaitTermination()  # its own goes on


def test_silver_state_is_updated_once_per_new_id(spark):
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    land_envelopes(spark, root, BATCHES)
    q = jobs.run_silver(read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1), base, ckpt)
    q.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert updated == [2, 1, 0]  # ids 1 and 2, then 4 (3 has no English title), then none


def test_bounded_dedupe_keeps_first_copies_of_old_rows(spark):
    # event times run backwards by months: nothing may count as late; state is dropped meanwhile
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    batches = [[env(10 * b + k, "Title", 1440 - 200 * b) for k in range(3)] for b in range(5)]
    land_envelopes(spark, root, [[(key, value, T0 - dt.timedelta(days=60 * i)) for key, value, _ in rows]
                                 for i, rows in enumerate(batches)])
    src = read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1)
    q = jobs.run_silver(src, base, ckpt, dedupe_delay="1 milliseconds")
    q.awaitTermination()
    silver = lake.read_layer(spark, f"{base}/silver", "silver")
    assert sorted(r.id for r in silver.collect()) == sorted(f"id{10 * b + k}" for b in range(5) for k in range(3))
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress) > 0


def art(i, d, label="Real", title="t"):
    return (i, "s", title, "c", "u", T0, T0, d, label, 0.6, T0)


def test_merge_into_is_idempotent_and_moves_rows_between_dates(spark):
    table = work_dir(spark, "serving")
    d0, d1, d2 = (T0.date() + dt.timedelta(days=k) for k in range(3))
    frame = lambda rows: spark.createDataFrame(rows, GOLD_SCHEMA)
    rows = lambda: {r.id: r for r in lake.read_serving(spark, table).collect()}
    serving.merge_into(spark, table, frame([art(f"i{k}", (d0, d1, d2)[k % 3]) for k in range(9)]))
    untouched = lake._glob(spark, f"{table}/date={d2}/*.parquet")
    moved = frame([("i0", None, None, None, None, None, None, dt.date(2024, 2, 1), "Fake", None, T0 + dt.timedelta(days=1)),
                   (None, *art("x", d2)[1:])])
    for _ in range(2):  # a retried batch changes nothing
        serving.merge_into(spark, table, moved)
        cur = rows()
        assert len(cur) == 9 == lake.read_serving(spark, table).count()
        assert cur["i0"].label == "Fake" and cur["i0"].date == dt.date(2024, 2, 1) and cur["i0"].title == "t"
    # every row of d1 moves to d2: d1 is cleared
    serving.merge_into(spark, table, frame([art(f"i{k}", d2, "Fake") for k in (1, 4, 7)] + [art("n1", None)]))
    cur = rows()
    assert len(cur) == 10 and {cur[f"i{k}"].date for k in (1, 4, 7)} == {d2} and cur["n1"].date is None
    assert lake._glob(spark, f"{table}/date={d1}") == []
    # dates a batch does not touch keep their files
    before = lake._glob(spark, f"{table}/date={d2}/*.parquet")
    assert before != untouched
    serving.merge_into(spark, table, frame([art("i3", d0, "Fake")]))
    assert lake._glob(spark, f"{table}/date={d2}/*.parquet") == before
    assert serving.merge_into(spark, table, frame([])) == []


def test_merge_into_after_a_crash_before_the_old_date_was_cleared(spark):
    table = work_dir(spark, "serving")
    d0, d1 = T0.date(), T0.date() + dt.timedelta(days=1)
    serving.merge_into(spark, table, spark.createDataFrame([art("a", d0)], GOLD_SCHEMA))
    later = spark.createDataFrame([art("a", d1, "Fake")[:10] + (T0 + dt.timedelta(hours=1),)], GOLD_SCHEMA)
    later.write.mode("append").partitionBy("date").parquet(table)  # the new copy is there, the old one still too
    assert lake.read_serving(spark, table).count() == 2
    serving.merge_into(spark, table, later)
    assert [(r.id, r.date, r.label) for r in lake.read_serving(spark, table).collect()] == [("a", d1, "Fake")]


def test_live_aggregates_and_counter(spark):
    root = work_dir(spark, "sc")
    for i in range(3):
        rows = [(f"i{i}{k}", f"src{k % 2}", "t", "c", "u", T0, T0, T0.date(), "Fake" if k % 3 else "Real",
                 0.6, T0 + dt.timedelta(minutes=50 * i + k)) for k in range(6)]
        spark.createDataFrame(rows, GOLD_SCHEMA).coalesce(1).write.parquet(f"{root}/part={i}")
    stream = lambda: spark.readStream.schema(GOLD_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{root}/part=*")
    out, ck = work_dir(spark, "tl"), work_dir(spark, "c")
    jobs.run_timeline_stream(stream(), out, ck).awaitTermination()
    tl = {r.hour: (r.fake, r.real, r.total) for r in jobs.latest_rows(spark, out, "hour").collect()}
    assert tl == {"2024-01-01T00:00": (8, 4, 12), "2024-01-01T01:00": (4, 2, 6)}
    out2, ck2 = work_dir(spark, "bd"), work_dir(spark, "c")
    jobs.run_breakdown_stream(stream(), out2, ck2).awaitTermination()
    assert {r.source: r.total for r in jobs.latest_rows(spark, out2, "source").collect()} == {"src0": 9, "src1": 9}
    out3, ck3 = work_dir(spark, "fc"), work_dir(spark, "c")
    jobs.run_feed_counter(stream(), out3, ck3).awaitTermination()
    fc = jobs.feed_counter_table(spark, out3).orderBy("batch_id").collect()
    assert [r.running_n for r in fc] == [6, 12, 18] and fc[-1].last_source == "src1"
