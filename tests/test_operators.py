"""Batch operators: cleaning, dedupe, merge, stats, pages, feeds, evaluation (edge rows)."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from credlake.operators import evaluate as ev
from credlake.operators import feed as fd
from credlake.operators import merge as mg
from credlake.operators import stats
from credlake.operators.clean import build_article, clean, first_per_key, new_articles, retain
from credlake.schemas import GOLD_SCHEMA

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def gold_rows(spark, rows):
    """rows: (id, source, label, confidence, minutes, title, content)"""
    data = []
    for i, src, lab, conf, m, title, content in rows:
        ts = T0 + dt.timedelta(minutes=m)
        data.append((i, src, title, content, f"https://x/{i}", ts, ts, ts.date(), lab, conf, ts))
    return spark.createDataFrame(data, GOLD_SCHEMA)


def test_clean_edge_rows(spark):
    rows = [("a", "s", "  Title A  ", " body ", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00"),
            ("b", "s", "", "x", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00"),
            ("c", "s", None, "x", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00"),
            ("d", "s", "漢字", "x", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00"),
            ("e", "s", "   ", None, "garbage", "2024-01-01T00:00:00+00:00"),
            ("a", "s2", "Title A", "later copy", "2024-01-01T00:00:00+00:00", "2024-01-02T00:00:00+00:00")]
    df = spark.createDataFrame(rows, "id string, source string, title string, content string, "
                                     "published_at string, fetched_at string")
    out = {r.id: r for r in clean(df, order_by=("fetched_at",)).collect()}
    assert set(out) == {"a"}  # blank / null / non-latin / whitespace-only titles go
    assert out["a"].title == "Title A" and out["a"].content == "body" and out["a"].source == "s"
    assert out["a"].date == dt.date(2024, 1, 1) and out["a"].lang_guess == "en"


def test_whitespace_title_kept_by_silver_but_content_defaults(spark):
    df = spark.createDataFrame([("e", "s", "  x ", None, "garbage", "t")],
                               "id string, source string, title string, content string, published_at string, fetched_at string")
    r = clean(df, order_by=("fetched_at",)).first()
    assert r.content == "" and r.date is None  # unparsable date -> null, not an error


def test_build_article_rules(spark):
    rows = [("newsapi:X", " Padded ", None, "https://u", "2024-01-01T23:30:00-05:00", "2024-01-03T00:00:00+00:00"),
            ("newsapi:X", "T", "c", "", None, "2024-01-03T00:00:00+00:00"),
            ("newsapi:X", None, "c", "https://u", None, "2024-01-03T00:00:00+00:00"),
            ("newsapi:X", "T", " c ", "https://u", "", "2024-01-03T00:00:00+00:00")]
    df = spark.createDataFrame(rows, "source string, title string, content string, url string, "
                                     "published_at string, fetched_at string")
    out = build_article(df).collect()
    assert len(out) == 2
    import hashlib
    a = out[0]
    assert a.id == hashlib.sha1("https://u|| Padded ".encode()).hexdigest()[:24]
    assert a.title == "Padded" and a.content == "" and a.published_at == "2024-01-02T04:30:00+00:00"
    assert out[1].published_at == "2024-01-03T00:00:00+00:00" and out[1].content == "c"


def test_first_per_key_hot_key(spark):
    # one key holds most rows: partial aggregation keeps it correct
    df = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit("hot")).otherwise(
        F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    out = {r.k: r.v for r in first_per_key(df, ["k"], ["v"]).collect()}
    assert out["hot"] == 0 and len(out) == 1001


def test_merge_idempotency_and_keep_old(spark):
    target = gold_rows(spark, [("abc123", "s", "Real", 0.9, 0, "Old", "keep me")])
    ts = T0 + dt.timedelta(days=1)
    ups = spark.createDataFrame([
        ("abc123", "s", "T1", None, None, None, None, None, "Real", 0.6, ts),
        ("abc123", "s", "T2", None, None, None, None, None, "Fake", None, ts + dt.timedelta(seconds=1)),
        ("abc123", "s", "T3", None, None, None, None, None, "Fake", 0.7, ts + dt.timedelta(seconds=2)),
        ("zzz", "s", "New", "n", "https://n", None, None, None, "Real", 0.5, ts),
    ], GOLD_SCHEMA)
    out = {r.id: r for r in mg.merge_articles(target, ups).collect()}
    assert out["abc123"].label == "Fake" and out["abc123"].confidence == 0.7
    assert out["abc123"].title == "T3" and out["abc123"].content == "keep me"
    assert out["zzz"].title == "New" and len(out) == 2
    # re-applying the same batch changes nothing
    once = mg.merge_articles(target, ups)
    twice = mg.merge_articles(once, ups)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    counts = mg.merge_counts(target, ups).first()
    assert (counts.matched, counts.modified, counts.upserted) == (1, 1, 1)
    counts2 = mg.merge_counts(once, ups).first()
    assert (counts2.matched, counts2.modified, counts2.upserted) == (2, 0, 0)


def test_fold_takes_the_last_non_null_per_field(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "x", None, t), ("a", None, "c1", t + dt.timedelta(hours=1)),
            ("a", "y", None, t + dt.timedelta(hours=2)), ("b", None, "c2", t),
            ("c", "z", "c3", t), (None, "n", "n", t)]
    df = spark.createDataFrame(rows, "id string, title string, content string, scored_at timestamp")
    got = sorted(map(tuple, mg.fold_updates(df).collect()))
    assert got == [("a", "y", "c1", t + dt.timedelta(hours=2)), ("b", None, "c2", t), ("c", "z", "c3", t)]


def test_insert_new_first_write_wins(spark):
    target = gold_rows(spark, [("a", "s", "Real", 0.9, 0, "Old", "x")])
    ups = gold_rows(spark, [("a", "s", "Fake", 0.5, 5, "Changed", "y"), ("b", "s", "Fake", 0.5, 9, "B2", "y"),
                            ("b", "s", "Real", 0.5, 3, "B1", "y")])
    out = {r.id: r for r in mg.insert_new(target, ups).collect()}
    assert out["a"].title == "Old" and out["b"].title == "B1"


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert [tuple(r) for r in mg.duplicate_ids(df).collect()] == [("a", 2)]


def test_stats_empty_table(spark):
    empty = spark.createDataFrame([], GOLD_SCHEMA)
    t = stats.totals(empty).first()
    assert (t.total, t.fake, t.real, t.fake_pct, t.real_pct) == (0, 0, 0, 0.0, 0.0)
    assert stats.top_sources(empty).count() == 0 and stats.timeline(empty).count() == 0


def test_stats_values_and_ties(spark):
    rows = [(f"i{k}", "b" if k % 2 else "a", "Fake" if k % 3 == 0 else "Real", 0.6, k, "t", "c") for k in range(12)]
    rows.append(("n1", None, "Other", 0.6, 1, "t", "c"))
    sc = gold_rows(spark, rows)
    t = stats.totals(sc).first()
    assert (t.total, t.fake, t.real) == (13, 4, 8) and t.fake_pct == round(4 / 13 * 100, 1)
    top = [tuple(r) for r in stats.top_sources(sc).collect()]
    assert top == [("a", 6), ("b", 6), (None, 1)]
    fr = {r.source: r.fake_rate for r in stats.fake_rate(sc).collect()}
    assert None not in fr and fr["a"] == 2 / 6
    b = {r.source: (r.total, r.fake, r.real) for r in stats.breakdown(sc, real_mode="rest").collect()}
    assert b[None] == (1, 0, 1)
    tl = stats.timeline(sc, as_of=F.lit(T0 + dt.timedelta(hours=2)), hours=24).collect()
    assert len(tl) == 1 and tl[0].total == 12 and tl[0].hour == "2024-01-01T00:00"  # 'Other' counts nowhere


def test_landed(spark):
    sc = gold_rows(spark, [("a", "s", "Real", 0.6, 0, "t", "c"), ("b", "s", "Real", 0.6, 0, "t", "c")])
    ids = spark.createDataFrame([("a",), ("c",), ("c",)], "id string")
    r = stats.landed(sc, ids).first()
    assert (r.expected, r.found) == (2, 1)


def test_pages(spark):
    rows = [(f"i{k:02d}", "newsapi:CNN" if k % 2 else "gnews:BBC", "Fake" if k % 3 else "Real", 0.6, k, "t", "c")
            for k in range(30)]
    sc = gold_rows(spark, rows)
    p1 = fd.page(sc, source="NEWSAPI:c", page_no=1, size=10).collect()
    assert [r.id for r in p1] == [f"i{k:02d}" for k in range(29, 0, -2)][:10]
    assert fd.page(sc, page_no=9, size=10).count() == 0  # past the end
    info = fd.page_info(sc, label="Fake", page_no=3, size=7).first()
    assert (info.total, info.pages) == (20, 3)
    assert fd.page_info(sc.limit(0), size=7).first().pages == 1
    cont = fd.page(sc, source="bb", match="contains", size=100).count()
    assert cont == 15
    last = p1[-1]
    after = fd.page_after(sc, F.lit(last.fetched_at), F.lit(last.id), source="newsapi:cnn", size=3).collect()
    assert [r.id for r in after] == ["i09", "i07", "i05"]
    assert fd.article(sc, "i03").count() == 1 and fd.article(sc, "nope").count() == 0


def test_feed_newest_and_lossless(spark):
    sc = gold_rows(spark, [(f"i{k:02d}", "s", "Fake", 0.6, k, "t", "c") for k in range(25)])
    since = F.lit(T0 + dt.timedelta(minutes=4))
    newest = fd.feed(sc, since, 10, newest_first=True).collect()
    assert len(newest) == 10 and newest[0].id == "i24" and newest[0]["count"] == 20
    assert newest[0].next_cursor.startswith("2024-01-01T00:24:00")
    oldest = fd.feed(sc, since, 10, newest_first=False).collect()
    assert oldest[0].id == "i05" and oldest[0].next_cursor.startswith("2024-01-01T00:14:00")


def test_union_dedupe_and_retain(spark):
    a = gold_rows(spark, [("x", "n", "Fake", 0.6, 5, "t", "c"), ("y", "n", "Fake", 0.6, 1, "t", "c")])
    b = gold_rows(spark, [("x", "g", "Fake", 0.6, 2, "t", "c"), ("z", "g", "Fake", 0.6, 3, "t", "c")])
    seen = spark.createDataFrame([("y",)], "id string")
    out = {r.id: r.source for r in new_articles([a, b], seen).collect()}
    assert out == {"x": "g", "z": "g"}
    assert [r.id for r in retain(a.unionByName(b), 2).collect()] == ["x", "z"]


def test_evaluation_metrics(spark):
    yp = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    a = ev.accuracy_f1(yp).first()
    assert a.accuracy == 3 / 5 and a.f1 == 4 / 6
    cm = {(r.y, r.p): r.n for r in ev.confusion(yp).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in ev.report(yp).collect()}
    assert rep["Real"].precision == 2 / 3 and rep["Fake"].recall == 1 / 2 and rep["accuracy"].f1 == 0.6
    empty = ev.report(yp.limit(0)).collect()
    assert all((r.f1 or 0.0) == 0.0 for r in empty)  # zero division -> 0
    assert ev.gate(yp, 0.5).first().passed is True


def test_fingerprint_matches_python(spark):
    import hashlib
    import json
    corpus = spark.createDataFrame([("a", 1, "s"), ("b", 0, "s"), ("c", 1, "s")], "text string, label int, source string")
    exp = hashlib.sha1(json.dumps({"n": 3, "pos": 2, "neg": 1}, sort_keys=True).encode()).hexdigest()[:8]
    assert ev.fingerprint(corpus).first().hash8 == exp


def test_split_takes_the_exact_share_of_every_class(spark):
    import math
    corpus = spark.range(3003).select((F.col("id") % 1500).cast("string").alias("text"),
                                      F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("label"))
    s1 = sorted((r.label, r.text, r.part) for r in ev.stratified_split(corpus).collect())
    s2 = sorted((r.label, r.text, r.part) for r in ev.stratified_split(corpus.repartition(7)).collect())
    assert s1 == s2 and len(s1) == 3003
    for label in (0, 1):
        parts = [p for x, _, p in s1 if x == label]
        assert parts.count("test") == math.ceil(0.1 * len(parts))
    assert ev.stratified_split(corpus.limit(0)).count() == 0
    alike = corpus.withColumn("text", F.lit("same"))  # all rows in the cut bucket
    assert ev.stratified_split(alike).where("part = 'test'").count() == math.ceil(0.1 * 429) + math.ceil(0.1 * 2574)


def test_split_of_endless_repeats_counts_instead_of_ranking(spark, monkeypatch):
    import math
    from collections import Counter
    monkeypatch.setattr(ev, "COPIES_A_PIECE", 7)
    rows = ([("hot", 1, "s")] * 100 + [("hot", 1, f"s{k % 5}") for k in range(90)] + [("hot", 1, None)] * 30 + [("hot", None, "s")] * 9
            + [(f"t{k}", k % 2, "s") for k in range(60)] + [(None, 0, "s"), ("", 0, None), ("", 0, None)])
    corpus = spark.createDataFrame(rows, "text string, label int, source string")
    for fraction in (0.0, 0.02, 0.1, 0.5, 0.9, 1.0):
        split = ev.stratified_split(corpus, fraction).withColumn("h", ev.split_hash("text"))
        got = split.collect()
        assert Counter((r.text, r.label, r.source) for r in got) == Counter(rows)
        again = ev.stratified_split(corpus.repartition(9), fraction).collect()
        assert Counter((r.text, r.label, r.source, r.part) for r in got) == Counter(map(tuple, again))
        for label in (0, 1, None):
            sides = [[r.h for r in got if r.label == label and r.part == part] for part in ("test", "train")]
            assert len(sides[0]) == math.ceil(fraction * sum(map(len, sides)))
            assert max(sides[0], default=0) <= min(sides[1], default=1 << 60)
    assert "row_number" not in ev.stratified_split(corpus)._jdf.queryExecution().toString()


def test_split_computes_its_corpus_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text
    rows = [(f"t{k % 40}", k % 2, "s") for k in range(120)] + [("t0", 0, None)]
    corpus = spark.createDataFrame(rows, "text string, label int, source string").select(F.udf(seen)("text").alias("text"), "label", "source")
    split = ev.stratified_split(corpus)
    assert sorted(map(str, split.drop("part").collect())) == sorted(map(str, spark.createDataFrame(rows, corpus.schema).collect()))
    assert ev.split_counts(split).where("part = 'test'").agg(F.sum("n")).first()[0] == 13
    assert read.value == len(rows)  # neither the counts nor the two readers of the parts


def test_model_scoring_loads_once_and_falls_back(spark):
    import os
    import tempfile

    from credlake.operators.score import score_default, score_with
    marks = tempfile.mkdtemp()
    art = spark.range(200).select(F.col("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("c").alias("content")).repartition(12)

    def load():
        import pandas as pd
        with open(f"{marks}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts: pd.DataFrame({"label": ["NEG"] * len(texts), "confidence": [0.75] * len(texts)})

    out = score_with(art, load, "once", {"NEG": "Fake"}).collect()
    assert {(r.label, r.confidence) for r in out} == {("Fake", 0.75)} and len(out) == 200
    assert all(len(open(f"{marks}/{f}").read()) == 1 for f in os.listdir(marks)) and os.listdir(marks)

    def broken():
        raise OSError("gone")

    hashed = {(r.id, r.label, r.confidence) for r in score_default(
        art.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("fetched_at", F.lit(None).cast("timestamp"))).collect()}
    for loader in (None, broken):
        assert {(r.id, r.label, r.confidence) for r in score_with(art, loader, "broken").collect()} == hashed
    with pytest.raises(ValueError):
        score_with(art, None, fallback=False)
    with pytest.raises(Exception, match="gone"):
        score_with(art, broken, "broken", fallback=False).collect()


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from credlake.session import checkpoint_root

    def session(master, value):
        jvm = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
        conf = {"spark.checkpoint.dir": value} if value else {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__),
                               sparkContext=SimpleNamespace(master=master, _jsc=jvm, setCheckpointDir=lambda d: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session("spark://host:7077", None))
    assert checkpoint_root(session("spark://host:7077", "/shared/x/")) == "/shared/x"
    assert checkpoint_root(session("local[4]", None))
