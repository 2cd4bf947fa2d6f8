"""Golden values for the Column functions, recomputed in plain Python."""
from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from credlake.functions import display as disp
from credlake.functions.ids import stable_id, title_id
from credlake.functions.scoring import label_map, normalize_label, score_article, softmax_argmax
from credlake.functions.text import lang_guess, model_text, normalize_text, strip_ws, truncate
from credlake.functions.times import parse_published, to_iso


def py_normalize(v):
    import re
    if v is None:
        return None
    c = re.sub(r"[\r\n\t]+", " ", v)
    c = re.sub(r"\s{2,}", " ", c).strip()
    return c or None


def py_score(title, content):
    text = ((title or "") + ". " + (content or ""))[:4000]
    d = hashlib.md5(text.encode("utf-8")).digest()
    return ("Fake" if d[1] % 2 == 0 else "Real"), round(0.5 + (d[0] / 255.0) * 0.49, 4)


def test_stable_id_matches_python(spark):
    rows = [("https://a.example/x", "Title one"), ("u", "  padded  "), ("https://b", "漢字")]
    df = spark.createDataFrame(rows, "url string, title string")
    got = [r[0] for r in df.select(stable_id("url", "title")).collect()]
    exp = [hashlib.sha1(f"{u}||{t}".encode()).hexdigest()[:24] for u, t in rows]
    assert got == exp and all(len(x) == 24 for x in got)


def test_id_changes_with_url_or_title_and_null_gives_null(spark):
    df = spark.createDataFrame([("u", "t"), ("u2", "t"), ("u", "t2"), (None, "t")], "url string, title string")
    ids = [r[0] for r in df.select(stable_id("url", "title")).collect()]
    assert len(set(ids[:3])) == 3 and ids[3] is None


def test_title_id(spark):
    df = spark.createDataFrame([("Hello",)], "title string")
    assert df.select(title_id("title")).first()[0] == hashlib.sha256(b"Hello").hexdigest()[:24]


@pytest.mark.parametrize("raw,exp", [
    ("hello\n\n  world\t", "hello world"), (None, None), ("   ", None),
    ("Breaking: news!", "Breaking: news!"), ("a\t\nb", "a b"),
    ("x  y ", "x y"), ("　lead", "lead")])
def test_normalize_text_cases(spark, raw, exp):
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(normalize_text("t")).first()[0]
    assert got == exp == py_normalize(raw)


def test_strip_ws_is_python_strip(spark):
    vals = [" a ", "\ta\n", " a ", "a", ""]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    assert [r[0] for r in df.select(strip_ws("t")).collect()] == [v.strip() for v in vals]


def test_strip_ws_looks_at_the_ends_alone(spark):
    every = [chr(k) for k in range(0x11000) if not 0xD800 <= k < 0xE000]
    vals = [f"{c} x{c}y {c}" for c in every] + every
    out = spark.createDataFrame([(v,) for v in vals], "t string").select(strip_ws("t").alias("s"))
    assert [r.s for r in out.collect()] == [v.strip() for v in vals]
    assert "regexp" not in out._jdf.queryExecution().toString()


def test_default_scorer_matches_python(spark):
    rows = [("Breaking news", "Body"), ("", ""), (None, None), ("Another title", "x" * 5000),
            ("Ünïcödé", "漢字 body")]
    df = spark.createDataFrame(rows, "title string, content string")
    s = score_article("title", "content")
    got = [(r[0], r[1]) for r in df.select(s["label"], s["confidence"]).collect()]
    assert got == [py_score(t, c) for t, c in rows]
    assert all(0.5 <= c <= 0.99 for _, c in got)


def test_scorer_covers_all_byte_values(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("title"))
    s = score_article("title", F.lit(""))
    got = df.select("title", s["label"].alias("l"), s["confidence"].alias("c")).collect()
    for r in got:
        assert (r.l, r.c) == py_score(r.title, "")
    assert len({r.c for r in got}) == 256


def test_model_text_cut(spark):
    df = spark.createDataFrame([("t", "x" * 5000)], "title string, content string")
    assert len(df.select(model_text()).first()[0]) == 4000


@pytest.mark.parametrize("raw,rule", [("FAKE", "Fake"), ("fake", "Fake"), ("0", "Fake"), ("1", "Real"),
                                      ("LABEL_0", "Real"), ("real", "Real"), ("Fake News", "Fake")])
def test_label_rule(spark, raw, rule):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(normalize_label("raw")).first()[0] == rule
    mapped = df.select(normalize_label("raw", {"FAKE": "Fake", "REAL": "Real"})).first()[0]
    assert mapped == {"FAKE": "Fake", "REAL": "Real"}.get(raw, raw)


def test_label_map_names_every_raw_label(spark):
    got = spark.range(1).select(label_map(["FAKE", "REAL", "LABEL_0"])).first()[0]
    assert got == {"FAKE": "Fake", "REAL": "Real", "LABEL_0": "Real"}


def test_softmax_argmax_matches_numpy(spark):
    import numpy as np
    rows = [([1.0, 2.0],), ([3.0, -1.0],), ([0.5, 0.5],), ([1000.0, 999.0],)]
    df = spark.createDataFrame(rows, "l array<double>")
    p = softmax_argmax("l", {0: "FAKE", 1: "REAL"})
    got = df.select(p["label"], p["confidence"]).collect()
    for (l,), r in zip(rows, got):
        x = np.array(l)
        e = np.exp(x - x.max())
        pr = e / e.sum()
        idx = int(pr.argmax())
        assert r[0] == ("Fake" if idx == 0 else "Real")
        assert math.isclose(r[1], float(pr[idx]), rel_tol=1e-12)


def test_parse_published_edges(spark):
    rows = ["", "garbage", "2024", "T12:34", "20240101", "2024-01-01T23:30:00-05:00",
            "2024-13-01T00:00:00Z", "2024-01-01T10:00:00Z", "2024-01-01 10:00:00", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    fb = F.timestamp_seconds(F.lit(0))
    got = [r[0] for r in df.select(to_iso(parse_published("t", fb))).collect()]
    fallback = "1970-01-01T00:00:00+00:00"
    assert got == [fallback, fallback, fallback, fallback, fallback, "2024-01-02T04:30:00+00:00",
                   fallback, "2024-01-01T10:00:00+00:00", "2024-01-01T10:00:00+00:00", fallback]


def test_percent_formats_match_python(spark):
    vals = [round(0.5 + b / 255.0 * 0.49, 4) for b in range(256)] + [0.625, 0.5135, 0.5865, 0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "c double")
    got = df.select(disp.pct0("c")).collect()
    assert [r[0] for r in got] == [f"{v:.0%}" for v in vals]
    got1 = [r[0] for r in df.select(disp.pct1("c")).collect()]
    diffs = [(v, g) for v, g in zip(vals, got1) if g != f"{v:.1%}"]
    # exact-integer rounding may differ from Python's binary rounding by one tenth
    for v, g in diffs:
        assert abs(float(g[:-1]) - float(f"{v:.1%}"[:-1])) <= 0.1 + 1e-9


def pct1_rule(c):
    n = int(round(c * 10000))
    q, r = divmod(n, 10)
    t = q + (1 if r > 5 or (r == 5 and q % 2 == 1) else 0)
    return f"{t // 10}.{t % 10}%"


def test_templates_match_python(spark):
    rows = [("T", "Fake", 0.7345, "newsapi:X", "body " * 100), ("T2", "Real", 0.625, "", ""),
            ("T3", "fake", 0.99, None, None)]
    df = spark.createDataFrame(rows, "title string, label string, confidence double, source string, content string")
    got = df.select(disp.explanation_text(), disp.summary_text(), disp.explain_prompt(),
                    disp.summary_prompt()).collect()
    for (t, lab, c, s, body), r in zip(rows, got):
        tpl = disp.EXPLAIN_FAKE if lab.lower() == "fake" else disp.EXPLAIN_REAL
        assert r[0] == tpl.format(label=lab, pct=f"{c:.0%}", source=s or "")
        preview = body[:200] if body else t
        assert r[1] == disp.SUMMARY.format(title=t, source=s or "an unknown source", label=lab,
                                           pct=f"{c:.0%}", preview=preview)
        # ``:.1%`` follows the documented exact-decimal rule (<= 0.1 point from Python)
        assert r[2] == disp.EXPLAIN_PROMPT.format(label=lab, pct1=pct1_rule(c), source=s or "Unknown",
                                                  title=t, content800=(body or "")[:800])
        assert r[3] == disp.SUMMARY_PROMPT.format(title=t, content1500=(body or "")[:1500])


def test_truncate_and_lang(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("short",), ("漢字",)], "s string")
    got = df.select(truncate("s", 15), lang_guess("s")).collect()
    assert got[0][0] == "abcdefghijklmno..." and got[1][0] == "short"
    assert [r[1] for r in got] == ["en", "en", "other"]
