"""Headline benchmark: prints ONE JSON line.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.  Steps:

* raw_to_gold   -- documents -> articles -> silver clean/dedupe -> score -> gold
                   Parquet (partitioned by date, label), timed once after one
                   warm-up pass of the same plan into the noop sink
* queries       -- served from that gold table, median of 3 warm runs each,
                   forced with the ``noop`` sink (full compute, nothing collected)
* lake_chain    -- envelopes -> bronze + silver -> gold + serving merge with
                   chained availableNow streams, timed once
``value`` is the sum of the per-step seconds.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from credlake.operators import feed, merge, stats  # noqa: E402
from credlake.session import get_session, work_dir  # noqa: E402
from credlake.sources import fixtures as fx  # noqa: E402
from credlake.sources import lake  # noqa: E402
from credlake.streaming import jobs  # noqa: E402


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("credlake-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g"),
                               "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="credlake-bench-")})
    out: dict[str, float] = {}

    gold_path = work_dir(spark, "bench-gold")
    n_docs = fx.table(spark, sf_dir, "documents").count()

    def raw_to_gold():
        lake.write_batch_layer(fx.articles_scored(spark, sf_dir), gold_path, "gold")

    run(fx.articles_scored(spark, sf_dir))  # JVM warm-up on the same plan (noop sink)
    out["raw_to_gold"] = timed(raw_to_gold)
    gold = lake.read_layer(spark, gold_path, "gold")
    gold_rows = gold.count()
    upd_path = work_dir(spark, "bench-updates")
    fx.updates(spark, sf_dir).drop("doc_id").write.parquet(upd_path)
    upd = spark.read.parquet(upd_path)

    queries = {
        "totals": lambda: stats.totals(gold),
        "top_sources": lambda: stats.top_sources(gold),
        "fake_rate": lambda: stats.fake_rate(gold),
        "breakdown": lambda: stats.breakdown(gold),
        "timeline": lambda: stats.timeline(gold),
        "kpi": lambda: stats.kpi(gold),
        "page": lambda: feed.page(gold, label="Fake", source="newsapi:src1", page_no=2),
        # the client's cursor is a constant: the bound is pushed to the gold scan
        "feed": lambda: feed.feed(gold, stats.as_of_literal(gold)
                                  - F.make_dt_interval(F.lit(0), F.lit(6))),
        "merge": lambda: merge.merge_articles(gold, upd),
        "duplicate_ids": lambda: merge.duplicate_ids(gold),
    }
    for name, build in queries.items():
        run(build())  # warm-up
        out[name] = statistics.median(timed(lambda b=build: run(b())) for _ in range(3))

    env_root = work_dir(spark, "bench-env")
    fx.write_envelopes(spark, sf_dir, env_root, 4)
    base, ckpt = work_dir(spark, "bench-lake"), work_dir(spark, "bench-ckpt")

    def chain():
        from credlake.sources.envelopes import read_envelopes
        jobs.run_chain(spark, lambda: read_envelopes(spark, fmt="parquet", path=f"{env_root}/part=*",
                                                    max_files_per_trigger=1),
                       base, ckpt, f"{base}/serving",
                       lambda b: F.col("fetched_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(5)))

    out["lake_chain"] = timed(chain)
    result = {
        "metric": "credlake_headline_total",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in out.items()},
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "rows": {"documents": n_docs, "gold": gold_rows},
        "raw_to_gold_rows_per_sec": round(n_docs / out["raw_to_gold"], 1),
        "cpus": int(cpus),
        "spark": spark.version,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
