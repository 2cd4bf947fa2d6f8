"""Envelopes, payloads, corpora, fixtures."""
from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from credlake.schemas import ENVELOPE_SCHEMA
from credlake.sources import corpus as cp
from credlake.sources import envelopes as ev
from credlake.sources import fixtures as fx
from credlake.sources import payloads as pl

TS = dt.datetime(2024, 1, 1)


def env_df(spark, values):
    return spark.createDataFrame([("k", v, TS) for v in values], ENVELOPE_SCHEMA)


def test_parse_envelopes_permissive(spark):
    vals = ["not json", '["a"]', '{"id":5,"title":"t"}', '{"id":null}', '{"ID":"z"}', '{"id":""}',
            '{"id":"x","title":{"a":1},"published_at":"2024-13-01T00:00:00Z"}', "", None]
    out = ev.parse_envelopes(env_df(spark, vals)).collect()
    ids = sorted(r.id for r in out)
    assert ids == ["", "5", "x"]
    x = [r for r in out if r.id == "x"][0]
    assert x.title == '{"a":1}' and x.date is None and x.kafka_key == "k" and x.kafka_ts == TS
    rej = {r.value: r.reason for r in ev.reject_envelopes(env_df(spark, vals)).collect()}
    assert rej["not json"] == "unparsable" and rej['["a"]'] == "unparsable"
    assert rej['{"id":null}'] == "missing_id" and rej['{"ID":"z"}'] == "missing_id"
    assert rej[None] == "unparsable" and "" in rej


def test_raw_and_scored_envelopes(spark):
    art = spark.createDataFrame([("i", "s", "t", None, "u", "p", "f")],
                                "id string, source string, title string, content string, url string, "
                                "published_at string, fetched_at string")
    raw = ev.to_raw_envelope(art).first()
    assert raw.key == "s" and json.loads(raw.value)["content"] is None and len(json.loads(raw.value)) == 7
    sc = ev.to_scored_envelope(art).first()
    assert sc.key == "i" and "content" not in json.loads(sc.value)  # nulls omitted


def test_valid_scored_guard(spark):
    vals = ['{"id":"a","label":"Fake","confidence":0.7}', '{"ID":"z"}', '["a"]', "not json", '{"id":null}']
    df = spark.createDataFrame([(v,) for v in vals], "value string")
    out = ev.valid_scored(df).collect()
    assert len(out) == 2 and {r.id for r in out} == {"a", None}


def payload_df(spark, status, articles, fetched=TS):
    return spark.createDataFrame([(fetched, json.dumps({"status": status, "articles": articles}))],
                                 "fetched_at timestamp, payload string")


ARTS = [
    {"source": {"name": "CNN"}, "author": " Ann ", "title": " Hello ", "description": "",
     "content": "Body", "url": "https://a", "publishedAt": "2024-01-01T10:00:00Z"},
    {"source": {}, "title": "[Removed]", "description": "D", "url": "https://b", "publishedAt": None},
    {"source": {"name": ""}, "title": "No url", "url": None},
    {"title": "T", "url": " https://c ", "description": None, "content": None, "publishedAt": "garbage"},
]


def test_newsapi_and_gnews(spark):
    ok = payload_df(spark, "ok", ARTS)
    na = {r.url: r for r in pl.normalize_newsapi(ok).collect()}
    assert set(na) == {"https://a", "https://b", " https://c "}
    assert na["https://a"].source == "newsapi:CNN" and na["https://a"].title == "Hello"
    assert na["https://a"].content == "Body" and na["https://a"].published_at == "2024-01-01T10:00:00+00:00"
    assert na["https://b"].source == "newsapi:unknown" and na["https://b"].title == "[Removed]"
    assert na[" https://c "].published_at == "2024-01-01T00:00:00+00:00"  # unparsable -> fetch time
    assert pl.normalize_newsapi(payload_df(spark, "error", ARTS)).count() == 0
    gn = {r.url: r for r in pl.normalize_gnews(payload_df(spark, "error", ARTS)).collect()}
    assert len(gn) == 3 and gn["https://b"].source == "gnews:unknown"


def test_live_normaliser(spark):
    live = {r.url: r for r in pl.normalize_live(payload_df(spark, "ok", ARTS), "newsapi").collect()}
    assert set(live) == {"https://a", "https://c"}  # [Removed] dropped, url stripped
    a = live["https://a"]
    assert a.source == "CNN" and a.author == "Ann" and a.category == "News"
    assert a.published_at == "2024-01-01T10:00:00Z"  # passed through unparsed
    import hashlib
    assert a.id == hashlib.sha1(b"https://a||Hello").hexdigest()[:24]
    # the live path passes publishedAt through unparsed; only a missing value takes the fetch time
    assert live["https://c"].source == "Unknown" and live["https://c"].published_at == "garbage"
    g = pl.normalize_live(payload_df(spark, "ok", ARTS), "gnews").collect()
    assert len(g) == 3 and all(r.author is None for r in g)


def test_corpus_readers(spark, tmpdir_path):
    liar = os.path.join(tmpdir_path, "liar")
    os.makedirs(liar)
    with open(os.path.join(liar, "train.tsv"), "w") as f:
        f.write("1.json\tFALSE \tStatement one\n")
        f.write("2.json\tmostly-true\t  Statement two  \n")
        f.write("3.json\tunknown\tdropped\n")
        f.write("4.json\ttrue\t\n")
    fnn = os.path.join(tmpdir_path, "fnn")
    os.makedirs(fnn)
    with open(os.path.join(fnn, "politifact_fake.csv"), "w") as f:
        f.write("id,Title,text\n1,Big claim,Body here.\n2,,\n3,Only title.,\n")
    with open(os.path.join(fnn, "gossipcop_real.csv"), "w") as f:
        f.write("id,headline\n1,no title column\n")
    got = {(r.text, r.label, r.source) for r in cp.load_corpus(spark, liar, fnn).collect()}
    assert got == {("Statement one", 0, "liar"), ("Statement two", 1, "liar"),
                   ("Big claim. Body here", 0, "politifact"), ("Only title", 0, "politifact")}


def test_fixture_anchor_numbers(spark):
    sf = "/root/testdata/sf0.01"
    art = fx.articles_raw(spark, sf)
    assert art.count() == 1000 and art.select("id").distinct().count() == 927
    sc = fx.articles_scored(spark, sf)
    r = sc.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "Fake").alias("fake"),
               F.count_distinct("source").alias("src"), F.max("scored_at").alias("mx")).first()
    assert (r.n, r.fake, r.src) == (927, 503, 20) and r.mx == dt.datetime(2024, 1, 5, 21, 12, 16)
