"""Sharding and language fusion against plain Python versions, row by row."""
from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from bisect import bisect_left

import numpy as np
import pytest
import xxhash

from credlake.llm import language, licences, sharding, sql
from credlake.llm.words import mix
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string"


# ---- 9: sharding ----

def plain_ring(rows, n_shards, vnodes, capacities):
    """Every row by itself: to its own shard while it has room, else clockwise."""
    places, owners = sharding.ring(n_shards, vnodes)
    known = []
    for doc, text in rows:
        raw = (text or "").encode()
        place = xxhash.xxh64_intdigest(raw, seed=42) >> (64 - sharding.RING_BITS)
        known.append((place, (doc is not None, doc or 0), len(raw) + 16, doc, zlib.crc32(raw)))
    known.sort(key=lambda r: r[:3])
    room, shard = list(capacities), {}
    by_arc = defaultdict(list)
    for at, r in enumerate(known):
        by_arc[bisect_left(places, r[0])].append(at)  # the arc after the last point is the first one's owner's
    arcs = [*range(len(places)), len(places)]
    left = defaultdict(list)
    for arc in arcs:
        for at in by_arc[arc]:
            own = owners[arc % len(places)]
            if room[own]:
                room[own] -= 1
                shard[at] = own
            else:
                left[arc].append(at)
    waiting = []
    for lap in range(2):
        for arc in arcs:
            own = owners[arc % len(places)]
            while waiting and room[own]:
                room[own] -= 1
                shard[waiting.pop(0)] = own
            if lap == 0:
                waiting += left[arc]
    assert not waiting
    filled, out = Counter(), []
    for at, (place, _, size, doc, crc) in enumerate(known):
        out.append((doc, size, crc, shard[at], filled[shard[at]], sharding.owner(place, places, owners)))
        filled[shard[at]] += 1
    return Counter(out)


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_shards_equal_the_plain_version(spark, slack):
    draw = random.Random(9)
    rows = [(k, f"text {draw.randrange(400)}") for k in range(500)]
    rows += [(1000 + k, "hot") for k in range(300)]                       # a third of all rows on one place
    rows += [(None, None), (None, ""), (None, "x"), (7, "x"), (7, "x"), (8, "é" * 5000), (9, "y" * 400_000)]
    n, total = 11, len(rows)
    caps = sharding.equal_capacities(total, n) if slack == 0 else sharding.slack_capacities(total, n, slack)
    frame = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", shard string").repartition(6)  # a clashing name
    got = sharding.bounded_ring(frame, n, vnodes=8, slack=slack).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["home_shard"]) for r in got) \
        == plain_ring(rows, n, 8, caps)


# ---- 6: language ----

def plain_scores(model, text):
    """Text log likelihoods by single trigrams, or None without a trigram."""
    width = model.weights.shape[0]
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    total = [0.0] * width
    for i in range(len(raw) - 2):
        code = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
        at = int(mix(np.array([code], np.uint64))[0]) >> (64 - language.BINS_LOG2)
        for k in range(width):
            total[k] += float(model.weights[k][at])
    best = max(total)
    return [max(language.TEMPER * (t - best), -language.CERTAIN) for t in total], len(raw) >= 3


def plain_fusion(model, rows):
    names, width = [*model.languages, language.UND], len(model.languages) + 1
    scored = []
    for row_id, text, declared, suffix, host, domain in rows:
        likelihood, has = plain_scores(model, text)
        scored.append((row_id, likelihood, likelihood.index(max(likelihood)) if has else None,
                       {"declared": declared, "suffix": suffix, "host": host, "domain": domain}))
    overall = Counter(g for _, _, g, _ in scored if g is not None)
    everywhere = [(overall[k] + 1) / (sum(overall.values()) + width) for k in range(width)]
    seen = defaultdict(Counter)
    for _, _, g, told in scored:
        for key, value in told.items():
            if g is not None and value is not None:
                seen[key, value][g] += 1
    out = {}
    for row_id, likelihood, g, told in scored:
        def pulled(key, towards):
            counts = [seen[key, told[key]][k] if told[key] is not None else 0 for k in range(width)]
            counts = [max(n - (k == g), 0) for k, n in enumerate(counts)]
            return [(n + language.PULL * p) / (sum(counts) + language.PULL) for n, p in zip(counts, towards)]
        prior = pulled("host", pulled("domain", everywhere))
        score = [x + math.log(p) for x, p in zip(likelihood, prior)]
        for key in ("declared", "suffix"):
            if told[key] is not None:
                score = [s + math.log(a / b) for s, a, b in zip(score, pulled(key, everywhere), everywhere)]
        top = max(score)
        out[row_id] = (None if g is None else names[g], names[score.index(top)], 1 / sum(math.exp(s - top) for s in score))
    return out


def test_language_fusion_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language.train(docs.selectExpr("doc_id as id", "text", "lang"), sample_rows=40)
    texts = [r["text"] for r in docs.select("text").orderBy("doc_id").limit(120).collect()]
    draw = random.Random(4)
    rows = []
    for k in range(240):
        text = draw.choice([None, "", "ab", "la de", texts[k % 120][:draw.choice([3, 9, 30, 800])], (texts[k % 120] or "").upper()[:60]])
        host = draw.choice([None, "hot.site.de", "hot.site.de", "a.site.de", "b.org", "c.b.org"])
        rows.append((k, text, draw.choice([None, "de", "en", "fr", "zz"]), draw.choice([None, "de", "org"]), host,
                     host and ".".join(host.split(".")[-2:])))
    rows.append(rows[0][:0] + (240, *rows[0][1:]))  # a repeated row
    schema = "row_id long, text string, declared string, suffix string, host string, domain string"
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], schema + ", guess double").repartition(5)
    want = plain_fusion(model, rows)
    got = {r["row_id"]: r for r in language.identify(frame, model).collect()}
    assert set(got) == set(want)
    for k, (text_lang, lang, probability) in want.items():
        assert (got[k]["text_lang"], got[k]["lang"]) == (text_lang, lang), k
        assert got[k]["probability"] == pytest.approx(probability, rel=1e-6), k


# ---- 10: licences ----

def test_oracle_digests_equal_the_catalogue_of_the_operator(spark):
    known = licences.known_digests(licences.known_licences(spark)).collect()
    assert {(r["digest"], r["scope"], r["license_id"]) for r in known} == {(d, s, i) for i, s, d in sql.licence_digests()}
    assert len({i for i, s, _ in sql.licence_digests() if s == "text"}) >= 15


@pytest.mark.parametrize("least_broadcast", [0, 10**6])
def test_licence_catalogues_of_any_size_find_the_same(spark, monkeypatch, least_broadcast):
    monkeypatch.setattr(licences, "BROADCAST_DIGESTS", least_broadcast)
    texts = dict((i, b) for i, s, b in licences.long_texts())
    rows = [(1, texts["MPL-2.0"]), (2, None), (3, "Released under CC0 1.0.\nx\nLicensed under CC BY 4.0."), (None, texts["GPL-2.0"].upper()), (1, "")]
    got = sorted((str(r["doc_id"]), r["license_id"] or "", r["notices"], r["n_notices"]) for r in licences.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([("1", "MPL-2.0", "", 0), ("2", "", "", 0), ("3", "", "CC-BY-4.0,CC0-1.0", 2), ("None", "GPL-2.0", "", 0), ("1", "", "", 0)])
