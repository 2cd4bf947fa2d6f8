"""Answers from file footers, and what became of the lines of the training files."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from credlake.operators import stats
from credlake.schemas import GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources import corpus as cp
from credlake.sources import lake

T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def gold_rows(n):
    """Rows with null contents, a null date and labels of either class."""
    return [(f"i{k}", "s", "t", None if k % 3 else "c" * 5000, "u", T0, T0, None if k == 5 else (T0 + dt.timedelta(days=k % 4)).date(),
             "Fake" if k % 5 < 2 else "Real", None if k % 2 else 0.7, T0) for k in range(n)]


def test_counts_come_from_footers(spark):
    path = work_dir(spark, "gold")
    sc = spark.createDataFrame(gold_rows(203), GOLD_SCHEMA)
    sc.repartition(3).write.partitionBy("date", "label").parquet(path)
    counts = lake.footer_counts(spark, path, "gold")
    text = plan(counts)
    assert "PushedAggregation: [COUNT(*)]" in text and "PushedGroupBy: [date, label]" in text and "content" not in text
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(
        map(tuple, sc.groupBy("date", "label").agg(F.count(F.lit(1))).collect()), key=str)
    assert stats.totals(counts, stats.label_counts_summary(counts)).collect() == stats.totals(sc).collect()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


def test_footer_inventory_equals_the_scan(spark):
    base = work_dir(spark, "lake")
    sc = spark.createDataFrame(gold_rows(50), GOLD_SCHEMA)
    sc.repartition(2).write.partitionBy("date", "label").parquet(f"{base}/gold")
    spark.createDataFrame([], lake.LAYER_SCHEMAS["silver"]).write.partitionBy("date").parquet(f"{base}/silver")
    got = {r.tier: r for r in lake.footer_inventory(spark, base).collect()}
    for r in lake.layer_inventory(spark, base).collect():
        if r.rows:
            assert (got[r.tier].exists, got[r.tier].files, got[r.tier].rows) == (r.exists, r.files, r.rows)
    assert (got["bronze"].exists, got["bronze"].files, got["bronze"].rows) == (False, 0, 0)
    assert got["silver"].rows == 0 and got["gold"].last_date == dt.date(2024, 1, 4)
    empty = lake.footer_counts(spark, f"{base}/bronze", "bronze")
    assert empty.columns == ["date", "n"] and empty.collect() == []


def test_footers_of_a_streamed_layer(spark):
    root, base = work_dir(spark, "in"), work_dir(spark, "lake")
    for k in range(3):
        spark.createDataFrame(gold_rows(20 + k), GOLD_SCHEMA).coalesce(1).write.parquet(f"{root}/part={k}")
    rows = spark.readStream.schema(GOLD_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/part=*")
    lake.write_layer(rows, f"{base}/gold", work_dir(spark, "ckpt"), ("date", "label")).awaitTermination()
    spark.createDataFrame(gold_rows(7), GOLD_SCHEMA).drop("date", "label").write.parquet(f"{base}/gold/date=2024-01-01/label=Fake/lost")
    assert lake.footer_counts(spark, f"{base}/gold", "gold").agg(F.sum("n")).first()[0] == 63  # committed files alone


def write(path, name, *lines):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w", newline="") as f:
        f.write("".join(lines))


def test_every_line_of_the_training_files_is_accounted_for(spark):
    liar, fnn = work_dir(spark, "liar"), work_dir(spark, "fnn")
    tail = "\t".join(["x"] * 11)
    write(liar, "train.tsv",
          f"1\ttrue\tplain\t{tail}\n", f"2\tfalse\tone too many\t{tail}\tmore\n", f"3\tfalse\tempty extras\t{tail}\t\t\n", "\n",
          "4\ttrue\tshort\n", f'5\tfalse\t"a\ttab and ""quotes"""\t{tail}\n', f'6\tfalse\t"a\ttab"\t{tail}\tmore\n',
          f"7\todd\tno ruling\t{tail}\n", f"8\ttrue\t  \t{tail}\n", f"9\todd\t\t{tail}\n", "10\n",
          f'11\ttrue\t5" screen\t{tail}\n')
    write(fnn, "politifact_fake.csv", "id,Title,text\n", "1,A,b\n", '2,"two\nlines, ""quoted""","c, d"\n', "3,too,many,fields\n",
          '4,"also\nlong",x,y\n', "5\n", '6,"""",""\n', '7,"","",""\n')
    write(fnn, "politifact_real.csv", "id,headline\n", "1,no title column\n")
    write(fnn, "gossipcop_real.csv", "title\n")
    got = {r.file: tuple(r)[1:] for r in cp.corpus_report(spark, liar, fnn).collect()}
    assert got == {"train.tsv": ("read", 11, 4, 3, 3, 1), "valid.tsv": ("missing", 0, 0, 0, 0, 0), "test.tsv": ("missing", 0, 0, 0, 0, 0),
                   "politifact_fake.csv": ("read", 7, 3, 3, 1, 0), "politifact_real.csv": ("no title column", 0, 0, 0, 0, 0),
                   "gossipcop_fake.csv": ("missing", 0, 0, 0, 0, 0), "gossipcop_real.csv": ("read", 0, 0, 0, 0, 0)}
    assert {r.text for r in cp.read_liar(spark, liar).collect()} == {"plain", "short", 'a\ttab and "quotes"', '5" screen'}
    assert {r.text for r in cp.read_fakenewsnet(spark, fnn).collect()} == {"A. b", 'two\nlines, "quoted". c, d', '"'}
    nothing = cp.corpus_report(spark, work_dir(spark, "none"), None).collect()
    assert [(r.file, r.status, r.n_read) for r in nothing] == [(n, "missing", 0) for n in cp.LIAR_FILES]


def test_field_counts_of_raw_records(spark):
    long = "7," + '"' + 'say ""x"", ' * 200_000 + '"' + ",z"
    rows = [("a,b,c", False), ("a,b,c,d", True), ('a,"b,c",d', False), ('"a"",b",c,d', False), ('"""a"",b",c,d,e', True),
            ('a,"""",c', False), ('a,""",""",c', False), (",,", False), (",,,", True), (None, False), (long, False), (long + ",w", True)]
    df = spark.createDataFrame(rows, "raw string, want boolean").withColumn("got", cp.too_many_fields(F.col("raw"), ",", 3))
    assert [(r.want, r.got) for r in df.collect()] == [(w, w) for _, w in rows]


def test_only_files_with_quoted_newlines_are_read_whole(spark):
    plain = ['a,b\n', '1,"x ""y"", z"\n', '5" screen,ok\r\n', ',""\n', '"""q""",w\n', '\n']
    for extra, want in (([], False), (['2,"open\n', 'close"\n'], True), (['5" x,"open\n', 'close",y\n'], True),
                        (['2,lone\rreturn\n'], True), (['"""\n', '",x\n'], True), ([f'3,"{"long " * 200_000}"\n'], False)):
        path = work_dir(spark, "csv")
        write(path, "f.csv", *plain, *extra)
        assert cp.has_quoted_newlines(spark, f"{path}/f.csv") is want, extra
    path = work_dir(spark, "fnn")
    write(path, "gossipcop_fake.csv", "title,text\n", *(f'"t{k}, ""x""",body {k}\n' for k in range(5000)))
    rows = [cp.read_fakenewsnet(spark, path, how).collect() for how in (None, True, False)]
    assert sorted(rows[0]) == sorted(rows[1]) == sorted(rows[2]) and len(rows[0]) == 5000
