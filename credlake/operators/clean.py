"""Article building, silver cleaning and deduplication.

Deduplication keeps one row per key with ``min_by`` over a grouping, not a
window: the aggregate is computed partially on the map side, so a key that
holds a third of all rows is reduced before the shuffle instead of landing
whole in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.functions.ids import stable_id
from credlake.functions.text import lang_guess, strip_ws, title_present
from credlake.functions.times import parse_published, to_iso, try_date


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the row with the smallest ``order_by`` tuple.

    Give enough order columns to make the pick unique.  Works on batch
    DataFrames; for streams use :func:`dedupe_stream`.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    packed = F.struct(*[F.col(c) for c in others])
    out = df.groupBy(*keys).agg(F.min_by(packed, order).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


def dedupe_stream(df: DataFrame, key: str = "id") -> DataFrame:
    """D1 on a stream: whole-history first-arrival dedupe (unbounded state)."""
    return df.dropDuplicates([key])


def dedupe_within(df: DataFrame, key: str = "id", delay: str = "1 hour") -> DataFrame:
    """Bounded-state dedupe -- an id is remembered for ``delay`` after it
    arrived, and repeats arriving meanwhile are dropped.

    The clock is the arrival of the micro-batch, not a time in the data: every
    row is on time, so no first occurrence is ever taken for late, however the
    data's own times are mixed.  (The producers bound their memory by count,
    5000 ids; a stream bounds it by time.)
    """
    arrived = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("_arrived")


def build_article(df: DataFrame, source="source", title="title", content="content", url="url",
                  published_at="published_at", fetched_at="fetched_at",
                  drop_removed: bool = False) -> DataFrame:
    """Provider fields -> article record (all strings, ISO UTC text).

    Rows without url or title (null or empty) are dropped; the id hashes the
    untrimmed title; title and content are stripped (Unicode whitespace);
    unparsable published_at falls back to the fetch time.
    """
    def col(x):
        return F.col(x) if isinstance(x, str) else x

    fetched = col(fetched_at)
    fetched_ts = fetched if not isinstance(fetched_at, str) or dict(df.dtypes).get(fetched_at) != "string" \
        else F.try_to_timestamp(fetched)
    keep = (F.coalesce(col(url), F.lit("")) != "") & (F.coalesce(col(title), F.lit("")) != "")
    if drop_removed:
        keep = keep & (col(title) != "[Removed]")
    return df.where(keep).select(
        stable_id(col(url), col(title)).alias("id"),
        col(source).alias("source"),
        strip_ws(col(title)).alias("title"),
        strip_ws(F.coalesce(col(content), F.lit(""))).alias("content"),
        col(url).alias("url"),
        to_iso(parse_published(col(published_at), fetched_ts)).alias("published_at"),
        to_iso(fetched_ts).alias("fetched_at"),
    )


def silver_filter(df: DataFrame) -> DataFrame:
    """P6-P8 (no dedupe): one projection over the rows that have an English-looking title."""
    cleaned = {"title": F.trim(F.col("title")),
               "content": F.coalesce(F.trim(F.col("content")), F.lit("")),
               "lang_guess": lang_guess(F.trim(F.col("title")))}
    if "date" not in df.columns:
        cleaned["date"] = _date_of(df, "published_at")
    kept = [cleaned.pop(c).alias(c) if c in cleaned else F.col(c) for c in df.columns]
    named = df.where(title_present("title")).select(*kept, *[c.alias(n) for n, c in cleaned.items()])
    return named.where(F.col("lang_guess") == "en")


def _date_of(df: DataFrame, c: str) -> Column:
    t = dict(df.dtypes).get(c)
    return try_date(F.col(c)) if t == "string" else F.to_date(F.col(c))


def clean(df: DataFrame, order_by: Sequence[str] | None = ("kafka_ts", "fetched_at")) -> DataFrame:
    """Silver cleaning = P6 -> P7 -> P8 -> D1.

    Batch: one row per id, the smallest ``order_by`` (deterministic).
    Streaming: ``dropDuplicates(["id"])`` (first arrival wins).
    """
    out = silver_filter(df)
    if df.isStreaming or order_by is None:
        return dedupe_stream(out)
    order = [c for c in order_by if c in out.columns] or ["fetched_at"]
    return first_per_key(out, ["id"], order)


def new_articles(batches: Sequence[DataFrame], seen: DataFrame | None = None,
                 order_by: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """D3 + U1 + J3: union provider batches, keep the first row per id, and
    drop ids already seen (anti-join)."""
    u = batches[0]
    for b in batches[1:]:
        u = u.unionByName(b, allowMissingColumns=True)
    first = first_per_key(u, ["id"], list(order_by))
    if seen is not None:
        from credlake.operators.merge import new_only
        # the seen set grows without bound; stream it against the batch keys
        first = new_only(seen.select("id"), first, "id")
    return first


def retain(df: DataFrame, n: int = 500, order_col: str = "fetched_at") -> DataFrame:
    """Keep the newest ``n`` rows by arrival (id breaks ties).  A top-k:
    each task keeps its local best ``n`` before one small merge."""
    return df.orderBy(F.col(order_col).desc(), F.col("id").asc()).limit(n)


def normalise_times(df: DataFrame) -> DataFrame:
    """Wire-form (text) article times -> typed timestamps for the gold layer."""
    t = dict(df.dtypes)
    out = df
    if t.get("fetched_at") == "string":
        out = out.withColumn("fetched_at", F.try_to_timestamp(F.col("fetched_at")))
    if t.get("published_at") == "string":
        out = out.withColumn("published_at", parse_published(F.col("published_at"), F.col("fetched_at")))
    return out
