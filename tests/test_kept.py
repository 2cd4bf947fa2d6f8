"""Found bounds, sketches, late rows, the state audit and the choice of a classifier."""
from __future__ import annotations

import collections
import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from credlake.operators import feed, stats, train
from credlake.operators.clean import retain
from credlake.operators.evaluate import stratified_split
from credlake.schemas import GOLD_SCHEMA
from credlake.session import work_dir
from credlake.sources.envelopes import read_envelopes
from credlake.streaming import jobs
from tests.test_streaming import BATCHES, land_envelopes

T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gold(spark):
    """Articles with ties, empty hours, null times and null sources, and the counts kept beside them."""
    draw = random.Random(3)
    rows = []
    for k in range(600):
        hour = draw.choice([0, 1, 1, 1, 7, 30, 31, 90])
        at = None if k % 97 == 0 else T0 + dt.timedelta(hours=hour, minutes=draw.choice([0, 0, 59]))
        source = None if k % 41 == 0 else f"{'NewsAPI' if k % 2 else 'gnews'}:src{draw.randrange(9)}"
        rows.append((f"i{k:04}", source, "t", "c", "u", at, at, T0.date(), draw.choice(["Fake", "Real", "Real"]), 0.6, at))
    path = work_dir(spark, "gold")
    spark.createDataFrame(rows, GOLD_SCHEMA).repartitionByRange(6, "fetched_at").sortWithinPartitions("fetched_at").write.parquet(path)
    sc = spark.read.schema(GOLD_SCHEMA).parquet(path)
    return sc, feed.hour_counts(sc).persist(), feed.hour_counts(sc, "scored_at").persist()


def rows_of(df):
    return list(map(tuple, df.collect()))


@pytest.mark.parametrize("asked", [dict(), dict(label="Fake", page_no=3), dict(source="newsapi:SRC1"), dict(source="src1", match="contains", page_no=2, size=50),
                                   dict(source="nobody"), dict(page_no=6, size=100), dict(page_no=40, size=100)])
def test_bounded_pages_equal_pages(gold, asked):
    sc, counts, _ = gold
    assert rows_of(feed.bounded_page(sc, counts, **asked)) == rows_of(feed.page(sc, **asked))


def test_bounded_retention_and_feed_equal_the_plain_ones(gold):
    sc, counts, scored = gold
    for n in (1, 150, 10_000):
        assert rows_of(feed.bounded_retain(sc, counts, n)) == rows_of(retain(sc, n))
    for hours in (0, 29, 31, 89, 500):
        since = F.lit(T0 + dt.timedelta(hours=hours, minutes=30)).cast("timestamp")
        assert rows_of(feed.bounded_feed(sc, scored, since)) == rows_of(feed.feed(sc, since))


def test_bound_and_source_list_reach_the_scan(spark, gold):
    sc, counts, _ = gold
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(feed.bounded_page(sc, counts, source="newsapi:src1", size=10))
    assert "GreaterThanOrEqual(fetched_at," in text and "EqualTo(source,NewsAPI:src1)" in text
    several = plan(feed.bounded_page(sc, counts, source="NewsAPI", size=10))
    assert "In(source, [" in several and "GreaterThanOrEqual(fetched_at," in several
    assert feed.hour_bound(counts, 10_000) is None
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_too_many_sources_for_a_list_fall_back_to_the_predicate(gold, monkeypatch):
    sc, counts, _ = gold
    monkeypatch.setattr(feed, "MOST_SOURCES", 2)
    assert rows_of(feed.bounded_page(sc, counts, source="g")) == rows_of(feed.page(sc, source="g"))


def test_sketches_answer_ranges_within_their_error(spark):
    sc = spark.range(60_000).select(F.date_add(F.lit(T0.date()), (F.col("id") % 5).cast("int")).alias("date"),
                                    F.concat(F.lit("s"), F.col("id") % 20_000).alias("source"), (F.col("id") % 7 / 7.0).alias("confidence"),
                                    F.timestamp_seconds("id").alias("scored_at"))
    days = stats.daily_sketches(sc).persist()
    assert days.count() == 5
    for first, last in ((None, None), (T0.date(), T0.date()), (dt.date(2024, 1, 2), dt.date(2024, 1, 4))):
        got = stats.sketch_kpi(days, *(None if d is None else F.lit(d) for d in (first, last))).first()
        part = sc.where(F.col("date").between(first or dt.date(2000, 1, 1), last or dt.date(2100, 1, 1)))
        exact = stats.kpi(part).first()
        assert got["total"] == exact["total"] and got["last_scored_at"] == exact["last_scored_at"]
        assert got["avg_confidence"] == pytest.approx(exact["avg_confidence"])
        assert abs(got["sources"] - exact["sources"]) <= 3 * 1.04 / math.sqrt(1 << stats.SKETCH_BITS) * exact["sources"]
    assert stats.sketch_kpi(days.limit(0)).first()["sources"] == 0


def test_late_rows_are_kept_as_corrections(spark):
    root = work_dir(spark, "late")
    row = lambda i, h, label: (f"i{i}", "s", "t", "c", "u", T0, T0, T0.date(), label, 0.6, T0 + dt.timedelta(hours=h))
    batches = [[row(0, 10, "Fake"), row(1, 10.5, "Real")], [row(2, 2, "Fake"), row(3, 11, "Fake")], [row(4, 2.5, "Real"), row(5, 9.9, "Odd"), row(6, 10.2, "Real")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, GOLD_SCHEMA).coalesce(1).write.parquet(f"{root}/part={k}")
    stream = lambda: spark.readStream.schema(GOLD_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{root}/part=*")
    out, ckpt = work_dir(spark, "timeline"), work_dir(spark, "ckpt")
    for _ in range(2):  # a restart adds nothing
        jobs.run_timeline_kept(stream(), out, ckpt, "2 hours").awaitTermination()
        got = {r.hour: (r.fake, r.real, r.total) for r in jobs.kept_timeline(spark, out).collect()}
        everything = spark.read.schema(GOLD_SCHEMA).parquet(f"{root}/part=*")
        batch = stats.timeline(everything, F.lit(T0 + dt.timedelta(hours=20)).cast("timestamp"), 24)
        assert got == {r.hour: (r.fake, r.real, r.total) for r in batch.collect()}
    alone = {r.hour for r in jobs.kept_timeline(spark, out, corrections=False).collect()}
    assert "2024-01-01T02:00" not in alone and "2024-01-01T10:00" in alone
    assert sorted((r.hour.hour, r.batch_id, r.n) for r in jobs.late_hours(spark, out).collect()) == [(2, 1, 1), (2, 2, 1)]


def test_state_audit_before_and_after_a_restart(spark):
    root, base, ckpt = work_dir(spark, "e"), work_dir(spark, "l"), work_dir(spark, "c")
    land_envelopes(spark, root, BATCHES)
    src = lambda: read_envelopes(spark, fmt="parquet", path=f"{root}/part=*", max_files_per_trigger=1)
    for _ in range(2):
        jobs.run_silver(src(), base, ckpt).awaitTermination()
        audit = sorted(map(tuple, jobs.state_audit(spark, base, ckpt).collect()))
        assert audit == [(f"id{k}", True, True) for k in (1, 2, 4)]


# -- classifiers --------------------------------------------------------------

def labelled(spark, shuffled=False):
    draw = random.Random(5)
    rows = []
    for k in range(240):
        real = k % 3 > 0
        words = draw.choices(["calm", "report", "council", "said"] if real else ["shock", "secret", "!!", "wow"], k=6) + draw.choices("abcdefgh", k=6)
        rows.append((k, " ".join(words), draw.choice([0, 1]) if shuffled else int(real)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_the_best_candidate_is_kept_and_shuffled_labels_teach_nothing(spark):
    model, table = train.train_best(labelled(spark), grid=({"reg": 0.1}, {"reg": 0.01}), max_iter=8)
    rows = table.collect()
    best = [r for r in rows if r["best"]]
    assert len(best) == 1 and best[0]["f1"] == max(r["f1"] for r in rows) and best[0]["accuracy"] > best[0]["majority"] + 0.2
    assert model.stages[-1].getOrDefault("regParam") == best[0]["reg"]
    scored = train.model_score(labelled(spark), model)
    assert scored.where("label = 'Real'").count() == 160
    _, table = train.train_best(labelled(spark, shuffled=True), grid=({"reg": 0.1},), max_iter=8)
    assert table.first()["accuracy"] < 0.75


def test_naive_bayes_equals_plain_counting(spark):
    corpus = labelled(spark)
    data = stratified_split(corpus, 0.1, 42).collect()
    words = lambda t: re.findall(r"[^\W_]+|[^\w\s]+", t.lower())
    counts = [collections.Counter(w for r in data if r["part"] == "train" and r["label"] == c for w in words(r["text"])) for c in (0, 1)]
    docs = [sum(r["part"] == "train" and r["label"] == c for r in data) for c in (0, 1)]
    v = len(set(counts[0]) | set(counts[1]))

    def odds(text, a):
        each = (math.log((counts[1][w] + a) / (sum(counts[1].values()) + a * v)) - math.log((counts[0][w] + a) / (sum(counts[0].values()) + a * v)) for w in words(text))
        return math.log((docs[1] + 1) / (docs[0] + 1)) + sum(each)
    part = stratified_split(corpus, 0.1, 42)
    got = train.bayes_log_odds(corpus, "doc_id", part.where("part = 'train'"), train.bayes_terms(part.where("part = 'train'")), [0.5]).collect()
    text = {r["doc_id"]: r["text"] for r in data}
    for r in got:
        assert r["odds_0"] == pytest.approx(odds(text[r["doc_id"]], 0.5), abs=1e-9)
    grid = train.bayes_grid(corpus, "doc_id").collect()
    assert sum(r["best"] for r in grid) == 1 and max(r["f1"] for r in grid) == next(r["f1"] for r in grid if r["best"])
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "shock shock")], "doc_id long, text string")
    scored = {r["doc_id"]: r for r in train.bayes_score(empty, "doc_id", corpus).collect()}
    assert scored[1]["confidence"] == scored[2]["confidence"] == pytest.approx(161 / 242) and scored[3]["label"] == "Fake"
