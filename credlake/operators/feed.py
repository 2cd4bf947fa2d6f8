"""Pages, lookups and live feeds over scored articles.

Sorting is fully specified (``fetched_at`` / ``scored_at`` then ``id``) so a
page is deterministic.  ``sort + limit`` is planned as a top-k
(``TakeOrderedAndProject``): every task keeps its local best rows, then one
small merge -- no full sort of the table.  Deep pages should use the keyset
form (:func:`page_after`), which stays a top-k however far the reader goes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credlake.functions.display import iso_columns
from credlake.operators.clean import retain

DEEPEST_ROW = 100_000
TIME_COLUMNS = ("published_at", "fetched_at", "scored_at")


def filter_label(df: DataFrame, label: str = "all") -> DataFrame:
    """Fake / Real / all."""
    return df if label in (None, "all") else df.where(F.col("label") == label)


def filter_source(df: DataFrame, source: str | None, match: str = "prefix") -> DataFrame:
    """P18 (case-insensitive prefix, matched literally) / P19 (substring)."""
    if not source:
        return df
    s = F.lower(F.col("source"))
    arg = F.lit(source.lower())
    return df.where(s.startswith(arg) if match == "prefix" else s.contains(arg))


def _filtered(sc: DataFrame, label: str, source: str | None, match: str) -> DataFrame:
    return filter_source(filter_label(sc, label), source, match)


def page(sc: DataFrame, label: str = "all", source: str | None = None, match: str = "prefix",
         page_no: int = 1, size: int = 20) -> DataFrame:
    """One page, newest fetch first (id breaks ties); size 1..100.

    A page is a top-k of all rows up to its end, so its cost grows with its
    depth; beyond ``DEEPEST_ROW`` the keyset form is required.
    """
    if page_no < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and 1 <= page_size <= 100")
    if page_no * size > DEEPEST_ROW:
        raise ValueError(f"pages end at row {DEEPEST_ROW}; go on from a cursor with page_after")
    f = _filtered(sc, label, source, match)
    ordered = f.orderBy(F.col("fetched_at").desc(), F.col("id").asc())
    skip = (page_no - 1) * size
    return (ordered.offset(skip) if skip else ordered).limit(size)


def page_info(sc: DataFrame, label: str = "all", source: str | None = None, match: str = "prefix",
              page_no: int = 1, size: int = 20) -> DataFrame:
    """Total, page, page_size, pages = max(1, ceil(total / size))."""
    f = _filtered(sc, label, source, match)
    return f.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page_no).alias("page"), F.lit(size).alias("page_size"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long").alias("pages"))


def page_after(sc: DataFrame, after_fetched_at: Column, after_id: Column, label: str = "all",
               source: str | None = None, match: str = "prefix", size: int = 20) -> DataFrame:
    """The ``size`` rows after a (fetched_at, id) cursor in page order."""
    f = _filtered(sc, label, source, match)
    after = (F.col("fetched_at") < after_fetched_at) | (
        (F.col("fetched_at") == after_fetched_at) & (F.col("id") > after_id))
    return f.where(after).orderBy(F.col("fetched_at").desc(), F.col("id").asc()).limit(size)


def article(sc: DataFrame, article_id) -> DataFrame:
    """Point lookup by id (empty when absent); pushed to the scan as a filter."""
    v = article_id if isinstance(article_id, Column) else F.lit(article_id)
    return sc.where(F.col("id") == v)


def feed(sc: DataFrame, since: Column, limit: int = 10, newest_first: bool = True) -> DataFrame:
    """Articles scored after ``since``.

    Newest first (T3, as the reference -- rows beyond ``limit`` are skipped
    by the next cursor) or oldest first (T3b: loss-free, the cursor only
    advances over what was sent).  Adds ``count`` (all new rows) and
    ``next_cursor``; timestamps leave as ISO text (P26).
    """
    new = sc.where(F.col("scored_at") > since)
    order = [F.col("scored_at").desc() if newest_first else F.col("scored_at").asc(), F.col("id").asc()]
    top = new.orderBy(*order).limit(limit)
    n_new = new.select(F.count(F.lit(1))).scalar()
    if newest_first:
        nxt = new.select(F.max("scored_at")).scalar()
    else:
        nxt = top.select(F.max("scored_at")).scalar()
    out = top.withColumn("count", n_new).withColumn("next_cursor", nxt)
    return out.select(*iso_columns(out, TIME_COLUMNS + ("next_cursor",)))


# -- pages with a found bound -------------------------------------------------

MOST_SOURCES = 1000  # so many source names reach the scan as a list


def hour_counts(sc: DataFrame, time: str = "fetched_at") -> DataFrame:
    """Rows per (label, source, hour of ``time``): small, additive, and enough to
    tell in which hour a page ends.  Kept as a table it is the source dictionary, too."""
    return sc.groupBy("label", "source", F.date_trunc("hour", time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hour_bound(counts: DataFrame, rows: int) -> Column | None:
    """Start of the hour that holds the ``rows``-th newest row, as a constant.

    None where there are not so many rows with a time: then nothing is cut off."""
    by_hour = counts.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.sum("n").alias("n"))
    upto = by_hour.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("hour"))))  # one row per hour
    found = upto.where(F.col("upto") >= rows).agg(F.unix_micros(F.max("hour"))).first()[0]
    return None if found is None else F.timestamp_micros(F.lit(found).cast("long"))


def source_names(counts: DataFrame, source: str, match: str = "prefix") -> list[str] | None:
    """The sources that a P18 / P19 argument means, from the dictionary; None if too many."""
    names = filter_source(counts.select("source").distinct(), source, match).limit(MOST_SOURCES + 1).collect()
    return None if len(names) > MOST_SOURCES else [r[0] for r in names]


def narrowed(sc: DataFrame, counts: DataFrame, rows: int, label: str = "all", source: str | None = None, match: str = "prefix",
             time: str = "fetched_at") -> DataFrame:
    """Rows that can be among the ``rows`` newest of a filter: label, source list and
    time bound are constants that reach the scan, so older row groups are skipped."""
    f = filter_label(sc, label)
    wanted = filter_label(counts, label)
    if source:
        names = source_names(counts, source, match)
        if names is None:
            f, wanted = filter_source(f, source, match), filter_source(wanted, source, match)
        else:
            f, wanted = f.where(F.col("source").isin(names)), wanted.where(F.col("source").isin(names))
    bound = hour_bound(wanted, rows)
    return f if bound is None else f.where(F.col(time) >= bound)


def bounded_page(sc: DataFrame, counts: DataFrame, label: str = "all", source: str | None = None, match: str = "prefix",
                 page_no: int = 1, size: int = 20) -> DataFrame:
    """T1 with a found bound: the same rows as :func:`page`, from the hours that can hold them."""
    return page(narrowed(sc, counts, page_no * size, label, source, match), page_no=page_no, size=size)


def bounded_retain(sc: DataFrame, counts: DataFrame, n: int = 500) -> DataFrame:
    """D4 with a found bound: the newest ``n`` rows by arrival."""
    return retain(narrowed(sc, counts, n), n)


def bounded_feed(sc: DataFrame, counts: DataFrame, since: Column, limit: int = 10) -> DataFrame:
    """T3 with a found bound; ``counts`` are those of ``scored_at``.

    The rows come from the hours that can hold them.  How many there are and the
    next cursor come from the counts, but for the hour of the cursor and the newest."""
    hour = F.date_trunc("hour", since)
    later = counts.where(F.col("hour") > hour).agg(F.coalesce(F.sum("n"), F.lit(0)), F.unix_micros(F.max("hour"))).first()
    edge = sc.where((F.col("scored_at") > since) & (F.col("scored_at") < hour + F.make_dt_interval(F.lit(0), F.lit(1))))
    n_edge, newest_edge = edge.agg(F.count(F.lit(1)), F.unix_micros(F.max("scored_at"))).first()
    newest = newest_edge
    if later[1] is not None:
        newest = sc.where(F.col("scored_at") >= F.timestamp_micros(F.lit(later[1]).cast("long"))).agg(F.unix_micros(F.max("scored_at"))).first()[0]
    rows = narrowed(sc, counts, limit, time="scored_at").where(F.col("scored_at") > since)
    out = (rows.orderBy(F.col("scored_at").desc(), F.col("id").asc()).limit(limit)
           .withColumn("count", F.lit(later[0] + n_edge).cast("long"))
           .withColumn("next_cursor", F.timestamp_micros(F.lit(newest).cast("long"))))
    return out.select(*iso_columns(out, TIME_COLUMNS + ("next_cursor",)))
