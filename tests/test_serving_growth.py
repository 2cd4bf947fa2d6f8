"""Tables of many small dates: no filter of 1 MB a file, one file a date; updates read F3 once; ids sent or dealt give the same table."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from credlake.schemas import GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources import fixtures as fx
from credlake.sources import lake, serving

T0 = dt.datetime(2024, 1, 1)


def art(i, d, label="Real"):
    return (f"i{i}", "s", "t", "c", "u", T0, T0, d, label, 0.6, T0)


def file_bytes(spark, folder):
    fs, _ = lake._fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return [fs.getFileStatus(path(p)).getLen() for p in lake._glob(spark, f"{folder}/*/*.parquet")]


def rows_of(n):
    return [art(k, T0.date() + dt.timedelta(days=k % 20)) for k in range(n)]


def test_files_of_few_ids_have_small_filters(spark):
    table = work_dir(spark, "serving")
    serving.merge_into(spark, table, spark.createDataFrame(rows_of(60), GOLD_SCHEMA))
    assert len(file_bytes(spark, table)) == 20 and max(file_bytes(spark, table)) < 100_000
    assert max(file_bytes(spark, serving._generations(spark, table)[-1][2])) < 100_000
    lake.write_batch_layer(spark.createDataFrame(rows_of(60), GOLD_SCHEMA), f"{table}-gold", "gold")
    assert max(file_bytes(spark, f"{table}-gold/date=2024-01-01")) < 100_000


def test_a_batch_write_by_date_has_one_file_for_a_small_date(spark):
    path = work_dir(spark, "dates")
    lake.write_by_date(spark.createDataFrame(rows_of(400), GOLD_SCHEMA).repartition(8, "id"), path)
    assert len(lake._glob(spark, f"{path}/date=*/*.parquet")) == 20


def test_ids_sent_and_ids_dealt_give_the_same_table(spark, monkeypatch):
    tables = []
    for most in (1_000_000, 0):
        monkeypatch.setattr(serving, "SENT_IDS", most)
        table = work_dir(spark, "serving")
        serving.merge_into(spark, table, spark.createDataFrame(rows_of(60), GOLD_SCHEMA))
        later = [art(k, T0.date() + dt.timedelta(days=30), "Fake") for k in range(0, 80, 7)]
        serving.merge_into(spark, table, spark.createDataFrame(later, GOLD_SCHEMA))
        tables.append(sorted(map(tuple, lake.read_serving(spark, table).collect())))
    assert tables[0] == tables[1] and len(tables[0]) == 63  # ids 63, 70 and 77 are new


def test_a_replay_reads_no_stored_texts_and_folds_no_whole_rows(spark, monkeypatch):
    table = work_dir(spark, "serving")
    rows = spark.createDataFrame(rows_of(60), GOLD_SCHEMA).persist()
    serving.merge_into(spark, table, rows, batch="a")
    before = sorted(map(tuple, lake.read_serving(spark, table).collect()))
    folds, wide = serving.fold_updates, []
    monkeypatch.setattr(serving, "fold_updates", lambda df, *a: wide.append("content" in df.columns) or folds(df, *a))
    serving.merge_into(spark, table, rows, batch="b")
    assert not any(wide) and rows.is_cached
    assert sorted(map(tuple, lake.read_serving(spark, table).collect())) == before
    # fields to keep, ids that come twice and rows of other ids are all merged as a fold of everything does
    T1 = T0 + dt.timedelta(hours=1)
    later = [("i1", "s", None, "new", None, T0, None, None, "Fake", None, T1), ("i2", "s", "x", "c", "u", T0, T0, T0.date(), "Real", 0.7, T1),
             ("i3", "s", None, "c", "u", T0, T0, T0.date() + dt.timedelta(days=40), "Real", 0.7, T0), ("i3", "z", "y", None, "u", T0, T0, None, "Real", None, T1),
             ("n1", None, "t", None, "u", T0, T0, None, "Fake", 0.5, None), (None, *art(1, T0.date())[1:])]
    updates = spark.createDataFrame(later, GOLD_SCHEMA)
    stored = spark.createDataFrame(before, GOLD_SCHEMA)
    both = stored.withColumn("_later", F.lit(0)).unionByName(updates.withColumn("_later", F.lit(1)))
    expected = folds(both, "id", ("_later", "scored_at")).select(*GOLD_SCHEMA.fieldNames()).collect()
    serving.merge_into(spark, table, updates, batch="c")
    assert any(wide)
    assert sorted(map(str, lake.read_serving(spark, table).collect())) == sorted(map(str, expected))


def test_updates_read_the_scored_rows_once(spark):
    plan = fx.updates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
