"""Physical-plan assertions and the driver contract."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from credlake.operators import feed as fd
from credlake.operators import stats
from credlake.sources import fixtures as fx
from credlake.sources import lake

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gold(spark):
    from credlake.session import work_dir
    path = work_dir(spark, "plan-gold")
    fx.articles_scored(spark, SF).drop("doc_id").write.partitionBy("date", "label").parquet(path)
    return lake.read_layer(spark, path, "gold")


def test_default_scorer_has_no_python(spark):
    p = plan(fx.articles_scored(spark, SF))
    assert "Python" not in p and "ArrowEval" not in p and "BatchEval" not in p


def test_top_sources_single_exchange_partial_agg(spark, gold):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(stats.top_sources(gold))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange hashpartitioning") == 1
    assert "partial_count" in p and "TakeOrderedAndProject" in p


def test_pruning_and_pushdown(spark, gold):
    p = plan(stats.totals(gold))
    assert "ReadSchema: struct<label:string>" in p or "ReadSchema: struct<>" in p
    p2 = plan(fd.article(gold, "abc"))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,abc)]" in p2
    p3 = plan(fd.page(gold, label="Fake", size=5))
    assert "PartitionFilters: [isnotnull(label" in p3 and "TakeOrderedAndProject" in p3


def test_timeline_bound_reaches_the_scan(spark, gold):
    p = plan(stats.timeline(gold))
    assert "GreaterThanOrEqual(scored_at," in p


def test_merge_is_one_join(spark, gold):
    from credlake.operators.merge import merge_articles
    p = plan(merge_articles(gold, gold.limit(10).withColumn("label", F.lit("Fake"))))
    assert p.count("FullOuter") == 1 and "LeftAnti" not in p


def test_layer_writers_follow_the_session_and_sample_nothing(spark):
    from credlake.streaming.jobs import by_date
    p = plan(by_date(fx.articles_scored(spark, SF)))
    assert "Exchange hashpartitioning(date" in p and "rangepartitioning" not in p
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = by_date(fx.articles_scored(spark, SF)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_batch_layer_write_rebalances_on_partition_columns(spark):
    p = plan(lake.batch_layer_frame(fx.articles_scored(spark, SF), "gold"))
    assert "REBALANCE_PARTITIONS_BY_COL" in p
    assert "Exchange hashpartitioning(date" in p  # hot dates split by AQE, not one task


def test_dedupe_reduces_hot_keys_before_the_shuffle(spark):
    # one id holding a third of the rows: the pick is pre-aggregated per map task
    from credlake.operators.clean import first_per_key
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    out = first_per_key(df, ["k"], ["seq"])
    p = plan(out)
    assert "partial_min_by" in p and "Window" not in p
    rows = {r.k: (r.seq, r.v) for r in out.collect()}
    assert len(rows) == 2001 and rows["hot"] == (0, 0)


def test_entry_and_contract(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0 and df.columns == ["hour", "fake", "real", "total"]
    q, o = se.queries(), se.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    for name in ("totals", "timeline", "clean", "merge"):
        assert name in o


def test_small_queries_match_oracle(spark):
    """A handful of queries against their DuckDB oracle at sf0.001."""
    import duckdb

    import __spark_entry__ as se
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, o = se.queries(), se.oracle_sql()
    for name in ("totals", "top_sources", "timeline", "clean", "merge", "display", "parse_envelopes",
                 "payload_newsapi", "report"):
        s = q[name](spark, SF).toPandas()
        d = con.execute(o[name]).df()
        assert len(s) == len(d), name
        assert sorted(s.columns) == sorted(d.columns), name


def test_contract_loads_without_a_session():
    """The driver may ask for oracle SQL before starting Spark: no Column at import time."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as se; "
            "q = se.queries(); o = se.oracle_sql(); print(len(q), len(o))")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_o = map(int, out.stdout.split()[-2:])
    assert n_q >= 70 and n_o >= 60
