"""Statistics over scored articles.

Every per-source figure comes from one grouping by source with partial
(map-side) aggregation, so a hot source is pre-reduced before the shuffle.
A1-A4 can share that one aggregate (:func:`source_summary`) instead of
rescanning the table four times.  Top-k reports end in sort+limit, which
Spark plans as ``TakeOrderedAndProject`` (per-task top-k, then a tiny merge).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.functions.text import truncate
from credlake.functions.times import hour_bucket, hour_label

FAKE, REAL = "Fake", "Real"


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def pct(part: Column, total: Column, digits: int = 1) -> Column:
    """Python ``round(part/total*100, digits)`` (half-even), 0 when total is 0."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), total) * 100, digits), F.lit(0.0))


def source_summary(sc: DataFrame) -> DataFrame:
    """One row per source (null source is its own group): total, fake, real."""
    return sc.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col("label") == FAKE).alias("fake"),
        _count_if(F.col("label") == REAL).alias("real"),
    )


def totals(sc: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """A1: total, fake, real, fake_pct, real_pct (1 decimal; 0 when empty)."""
    if summary is not None:
        base = summary.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"),
                           F.coalesce(F.sum("fake"), F.lit(0)).cast("long").alias("fake"),
                           F.coalesce(F.sum("real"), F.lit(0)).cast("long").alias("real"))
    else:
        base = sc.agg(F.count(F.lit(1)).alias("total"),
                      _count_if(F.col("label") == FAKE).alias("fake"),
                      _count_if(F.col("label") == REAL).alias("real"))
    return base.select("total", "fake", "real",
                       pct(F.col("fake"), F.col("total")).alias("fake_pct"),
                       pct(F.col("real"), F.col("total")).alias("real_pct"))


def label_counts_summary(counts: DataFrame) -> DataFrame:
    """Counts ``n`` per label (and more keys) in the form :func:`totals` sums up."""
    n = F.col("n")
    return counts.select(n.alias("total"), F.when(F.col("label") == FAKE, n).alias("fake"), F.when(F.col("label") == REAL, n).alias("real"))


def top_sources(sc: DataFrame, k: int = 10, summary: DataFrame | None = None) -> DataFrame:
    """A2: article count per source, largest first (source breaks ties)."""
    s = summary if summary is not None else sc.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return (s.select("source", F.col("total").alias("count"))
            .orderBy(F.col("count").desc(), F.col("source").asc_nulls_first()).limit(k))


def fake_rate(sc: DataFrame, min_total: int = 3, digits: int | None = None, k: int = 10,
              summary: DataFrame | None = None) -> DataFrame:
    """A3 (min_total=3, unrounded) / A3b (min_total=1, digits=3): fake share per source."""
    s = summary if summary is not None else source_summary(sc)
    rate = F.col("fake").cast("double") / F.col("total")
    if digits is not None:
        rate = F.bround(rate, digits)
    return (s.where(F.col("total") >= min_total)
            .select("source", "total", F.col("fake").alias("fake_count"), rate.alias("fake_rate"))
            .orderBy(F.col("fake_rate").desc(), F.col("source").asc_nulls_first()).limit(k))


def breakdown(sc: DataFrame, k: int = 10, real_mode: str = "label",
              summary: DataFrame | None = None) -> DataFrame:
    """A4 (real = label Real) / A4b (real_mode="rest": real = total - fake)."""
    s = summary if summary is not None else source_summary(sc)
    real = F.col("real") if real_mode == "label" else (F.col("total") - F.col("fake"))
    return (s.select("source", "total", "fake", real.alias("real"))
            .orderBy(F.col("total").desc(), F.col("source").asc_nulls_first()).limit(k))


def as_of_max(sc: DataFrame, col: str = "scored_at") -> Column:
    """Scalar subquery ``(select max(col) from sc)`` -- planned once, no join."""
    return sc.select(F.max(col)).scalar()


def as_of_literal(sc: DataFrame, col: str = "scored_at") -> Column:
    """The table's latest ``col`` as a constant: one narrow aggregate runs now.

    A bound built on a scalar subquery stays a post-scan filter; a constant
    folds into the predicate and reaches the Parquet scan as a pushed filter,
    so row groups whose ``col`` statistics lie entirely before the bound are
    skipped.  Carried as epoch microseconds (no Python datetime round trip).
    """
    micros = sc.agg(F.unix_micros(F.max(col)).alias("m")).first()["m"]
    return F.timestamp_micros(F.lit(micros).cast("long"))


def timeline(sc: DataFrame, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """A5: per UTC hour of ``scored_at`` within ``hours`` before ``as_of``:
    fake, real, total = fake + real.  Rows with any other label still open
    their hour but count in neither column; empty hours are absent.

    ``as_of`` replaces the wall clock (default: the table's latest scored_at,
    taken as a constant so the time bound is pushed to the scan).
    """
    if as_of is None:
        as_of = as_of_literal(sc)
    since = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = sc.where(F.col("scored_at") >= since)
    return (recent.groupBy(hour_bucket("scored_at").alias("hour"))
            .agg(_count_if(F.col("label") == FAKE).alias("fake"),
                 _count_if(F.col("label") == REAL).alias("real"))
            .withColumn("total", F.col("fake") + F.col("real"))
            .orderBy("hour"))


def kpi(sc: DataFrame, approx: bool = False) -> DataFrame:
    """Total, distinct sources, average confidence, latest scored_at."""
    distinct = F.approx_count_distinct("source") if approx else F.count_distinct("source")
    return sc.agg(F.count(F.lit(1)).alias("total"), distinct.alias("sources"),
                  F.avg("confidence").alias("avg_confidence"),
                  F.max("scored_at").alias("last_scored_at"))


SKETCH_BITS = 12  # 2**12 registers: a relative standard error of about 1.6 %


def daily_sketches(sc: DataFrame) -> DataFrame:
    """Per date: rows, a HyperLogLog sketch of its sources, confidence sum and count, latest time.

    Sketches of any days merge, so a table of them answers A11b over any range
    without the articles."""
    return sc.groupBy("date").agg(
        F.count(F.lit(1)).alias("total"), F.hll_sketch_agg("source", F.lit(SKETCH_BITS)).alias("sources"),
        F.count("confidence").alias("confident"), F.sum("confidence").alias("confidence"), F.max("scored_at").alias("last_scored_at"))


def sketch_kpi(sketches: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A11b from daily sketches, over all days or those from ``first`` to ``last``."""
    days = sketches
    if first is not None:
        days = days.where(F.col("date") >= first)
    if last is not None:
        days = days.where(F.col("date") <= last)
    return days.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
                    F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sources")), F.lit(0)).alias("sources"),
                    F.try_divide(F.sum("confidence"), F.sum("confident")).alias("avg_confidence"), F.max("last_scored_at").alias("last_scored_at"))


def chart_pie(sc: DataFrame) -> DataFrame:
    """A12 pie: two slices, Real then Fake, in percent."""
    t = totals(sc)
    return t.select(F.explode(F.array(
        F.struct(F.lit("Real News").alias("name"), F.col("real_pct").alias("value")),
        F.struct(F.lit("Fake News").alias("name"), F.col("fake_pct").alias("value")))).alias("s")
    ).select("s.*")


def chart_bars(sc: DataFrame) -> DataFrame:
    """A12 bars: breakdown top 7 with names cut to 20 chars."""
    return breakdown(sc, 10).limit(7).select(
        truncate("source", 20).alias("category"), "real", "fake", "total")


def chart_timeline(tl: DataFrame) -> DataFrame:
    """Timeline rows with the hour shown as ``HH:00``."""
    return tl.select(hour_label("hour").alias("hour"), "fake", "real", "total")


def source_analysis(sc: DataFrame, k: int = 5) -> DataFrame:
    """Top sources left-joined to their fake rate (x100, missing -> 0),
    first 5, name cut to 25; real share = 100 - fake share.

    Both sides are top-10 tables (10 rows each): the broadcast is bounded
    by the limit, not by the data.  The per-source aggregate is planned once
    and its exchange reused by both sides.
    """
    summary = source_summary(sc)
    top = top_sources(sc, 10, summary)
    rates = fake_rate(sc, 3, None, 10, summary)
    j = top.join(F.broadcast(rates.select("source", "fake_rate")), "source", "left")
    fr = F.coalesce(F.nullif(F.col("fake_rate"), F.lit(0.0)) * 100, F.lit(0.0))
    return (j.select(truncate("source", 25).alias("source"), "count", fr.alias("fake_rate_pct"),
                     (F.lit(100.0) - fr).alias("real_rate_pct"), F.col("source").alias("_s"))
            .orderBy(F.col("count").desc(), F.col("_s").asc_nulls_first()).limit(k).drop("_s"))


def landed(sc: DataFrame, ids: DataFrame) -> DataFrame:
    """How many of an expected id set arrived.

    The scored table is streamed through a left-semi join against the
    expected ids (the small side; AQE broadcasts it only when its measured
    size is under the threshold), then both counts come out of one
    aggregate over a two-way union -- no cross join.
    """
    exp = ids.select("id").distinct()
    found = sc.select("id").join(exp, "id", "left_semi").distinct()
    marks = exp.select(F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(
        found.select(F.lit(0).alias("e"), F.lit(1).alias("f")))
    return marks.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("expected"),
                     F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("found"))
