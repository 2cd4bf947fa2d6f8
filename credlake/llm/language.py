"""Operator 6: language identification by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior per row:

* the text: byte-trigram likelihoods, trained on a bounded sample of labelled
  rows of every language (about ``SAMPLE_ROWS`` each, those below a hash
  threshold set by the language's own count; every other number here is counted
  over all rows), against a flat model for no language (und);
* the language the markup declares, weighed by how often declarations of that
  value meet each text language over the whole table;
* the address suffix, weighed the same way;
* a host prior: counts of text languages per host, smoothed towards the
  host's domain, and that towards the whole table, leaving out the row itself.

The counts are grouped aggregations of integers (map-side combined, so a hot
host is one partial row per task) and the joins back are salted.

Edge cases: a null or empty text, or one without a single trigram, has no text
evidence: the rest decides, and with none of it the global prior; ``has_text``
says so.  Null declarations, hosts and suffixes are missing evidence, neither
for nor against.  Without labelled rows there is no language to name: every
row is 'und' with probability 1.  Repeated rows count as often as they appear.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import saved, spread_join
from credlake.llm.words import SLICE, groups, mix

SAMPLE_ROWS = 4000        # labelled rows of each language the text model is fitted on, about
BINS_LOG2 = 16            # hashed trigram bins
LEAST_LABELLED = 5        # a language needs so many labelled rows
TEMPER = 0.25             # trigrams overlap; their evidence counts this much each
CERTAIN = 60.0            # log odds beyond which text evidence grows no further
PULL = 8.0                # pseudo-rows a host takes from its domain, a domain from all
UND = "und"

# ---- fixed values: the two-letter language codes of ISO 639-1 ----
CODES = set("""
    aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu
    fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn
    ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os
    pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt
    tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu""".split())
# ---- end of fixed values ----

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32


def _bins(data: np.ndarray, lo: int, hi: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bin and row of every trigram starting in [lo, hi) within its text."""
    part = _FOLD[data[lo:hi + 2]]
    n = len(part) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = mix(part[:n] | part[1:n + 1] << np.uint64(8) | part[2:n + 2] << np.uint64(16))
    at = np.arange(lo, lo + n)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[row + 1]
    return (codes[inside] >> np.uint64(64 - BINS_LOG2)).astype(np.int64), row[inside]


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # [languages + und, bins] log probabilities


def _language_bins(languages: list[str]):
    place = {name: k for k, name in enumerate(languages)}

    def run(batches):
        counts = np.zeros(len(languages) << BINS_LOG2, dtype=np.int64)
        for part, data, offsets in groups(batches, "text"):
            of = np.array([place[x] for x in part.column("lang").to_pylist()])
            for lo in range(0, len(data), SLICE):
                bins, row = _bins(data, lo, min(len(data), lo + SLICE), offsets)
                cells, n = np.unique(of[row] << BINS_LOG2 | bins, return_counts=True)
                counts[cells] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used >> BINS_LOG2, pa.int32()), pa.array(used & (1 << BINS_LOG2) - 1, pa.int32()),
             pa.array(counts[used], pa.int64())], ["k", "bin", "n"])
    return run


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Text model from (id, text, lang) rows, about ``sample_rows`` of each language.

    Nulls, empty labels and texts without a trigram are left out.
    """
    labelled = labelled.filter("lang is not null and lang <> '' and octet_length(text) >= 3").select(
        "text", "lang", F.xxhash64("id", "text").alias("h"))
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).filter(
        F.col("n") >= LEAST_LABELLED).collect()
    if not found:
        return TextModel([], np.zeros((1, 1 << BINS_LOG2)))
    names = sorted(r["lang"] for r in found)
    top = (1 << 63) - 1
    last = [(r["lang"], top if r["n"] <= sample_rows else max(r["least"], (sample_rows << 64) // r["n"] - top - 1)) for r in found]
    last = labelled.sparkSession.createDataFrame(last, "lang string, last long")
    counted = (labelled.join(F.broadcast(last), "lang").filter("h <= last").select("text", "lang")
               .mapInArrow(_language_bins(names), "k int, bin int, n long")
               .groupBy("k", "bin").agg(F.sum("n").alias("n")).toArrow())  # bins x languages at most
    counts = np.zeros((len(names), 1 << BINS_LOG2))
    counts[counted["k"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
    flat = 1.0 / (1 << BINS_LOG2)
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    weights = np.log(np.r_[share, np.full((1, 1 << BINS_LOG2), flat)])
    return TextModel(names, weights.astype(np.float32))


def _score(model: TextModel):
    width = model.weights.shape[0]

    def run(batches):
        for part, data, offsets in groups(batches, "text"):
            total = np.zeros((part.num_rows, width))
            for lo in range(0, len(data), SLICE):
                bins, row = _bins(data, lo, min(len(data), lo + SLICE), offsets)
                for k in range(width):
                    total[:, k] += np.bincount(row, weights=model.weights[k][bins], minlength=part.num_rows)
            total = TEMPER * (total - total.max(axis=1, keepdims=True))
            total = np.maximum(total, -CERTAIN)
            best = total.argmax(axis=1)
            has = np.diff(offsets) >= 3
            flat = pa.array(total.ravel(), pa.float64())
            likelihood = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("row_id", "declared", "suffix", "host", "domain")),
                 pa.array(has), pa.array(best, pa.int32()), likelihood],
                ["row_id", "declared", "suffix", "host", "domain", "has_text", "guess", "likelihood"])
    return run


def _counts(rows: DataFrame, key: str, width: int, name: str) -> DataFrame:
    """key, array of text-language counts over the rows with text."""
    return (rows.filter(F.col(key).isNotNull() & F.col("has_text")).groupBy(key)
            .agg(F.array(*(F.count_if(F.col("guess") == k) for k in range(width))).alias(name)))


def _all(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Posterior language of every row.

    ``rows``: row_id (long, carried along), text, declared, suffix, host, domain.
    Returns row_id, host, declared, has_text, text_lang, lang, probability.
    """
    names, width = [*model.languages, UND], len(model.languages) + 1
    scored = saved(rows.select("row_id", *(F.col(c).cast("string").alias(c) for c in ("text", "declared", "suffix", "host", "domain")))
                   .mapInArrow(_score(model), "row_id long, declared string, suffix string, host string, domain string, "
                                              "has_text boolean, guess int, likelihood array<double>"), "text-scores")
    overall = [0] * width
    for r in scored.filter("has_text").groupBy("guess").count().collect():
        overall[r["guess"]] = r["count"]
    total = sum(overall)
    everywhere = F.array(*(F.lit((n + 1.0) / (total + width)) for n in overall))
    told = scored
    for key in ("declared", "suffix", "domain", "host"):
        told = spread_join(told, _counts(scored, key, width, f"{key}_counts"), [key], ["row_id"], "left")
    own = F.when(F.col("has_text"), F.col("guess")).otherwise(-1)
    seen = {k: F.coalesce(f"{k}_counts", F.array_repeat(F.lit(0).cast("long"), width)) for k in ("declared", "suffix", "domain", "host")}

    def without_self(counts: Column) -> Column:
        return F.transform(counts, lambda n, k: F.greatest(n - F.when(k == own, 1).otherwise(0), F.lit(0)))

    def pulled(counts: Column, towards: Column) -> Column:
        n = _all(counts)
        return F.zip_with(counts, towards, lambda c, p: (c + PULL * p) / (n + PULL))

    def told_by(counts: Column, present: Column) -> Column:
        """log P(value | language) - log P(value), from P(language | value) by Bayes' rule."""
        share = pulled(counts, everywhere)
        return F.when(present, F.zip_with(share, everywhere, lambda s, p: F.log(s / p))).otherwise(
            F.array_repeat(F.lit(0.0), width))

    told = told.withColumn("prior", pulled(without_self(seen["host"]), pulled(without_self(seen["domain"]), everywhere)))
    told = told.select("row_id", "host", "declared", "has_text", "guess", "likelihood", "prior",
                       told_by(without_self(seen["declared"]), F.col("declared").isNotNull()).alias("by_declared"),
                       told_by(without_self(seen["suffix"]), F.col("suffix").isNotNull()).alias("by_suffix"))
    score = F.transform(F.arrays_zip("likelihood", "prior", "by_declared", "by_suffix"),
                        lambda z: z["likelihood"] + F.log(z["prior"]) + z["by_declared"] + z["by_suffix"])
    weighed = told.withColumn("score", score).withColumn("top", F.array_max("score"))
    weight = F.aggregate(F.transform("score", lambda s: F.exp(s - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    known = F.array(*(F.lit(n) for n in names))
    return weighed.select(
        "row_id", "host", "declared", "has_text", F.when(F.col("has_text"), F.get(known, F.col("guess"))).alias("text_lang"),
        F.get(known, F.array_position("score", F.col("top")).cast("int") - 1).alias("lang"),
        (1.0 / weight).alias("probability"))


def names_a_language(label: Column) -> Column:
    """Whether a label's first part is a language's code or name: two letters
    in use, or more but not one of the codes for none, many or private ones."""
    first = F.regexp_extract(F.lower(label), "^([a-z]{2,})(?:[-_].*)?$", 1)
    special = first.rlike("^(und|zxx|mis|mul|q[a-t][a-z])$")
    return F.coalesce(first.isin(sorted(CODES)) | ((F.length(first) > 2) & ~special), F.lit(False))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence rows of web pages (page_id, url, html): markup taken off, the
    declared language, and the parts of the address.  Other columns are not read."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, "\\.")
    given = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id", bare.alias("text"), given(declared).alias("declared"), given(F.element_at(labels, -1)).alias("suffix"),
        given(host).alias("host"), given(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("domain"))
