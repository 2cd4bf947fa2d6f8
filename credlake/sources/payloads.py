"""Provider payload normalisers.

A payload row holds one search-API response as JSON text plus the time it
was fetched.  Each normaliser parses with a fixed schema, explodes the
``articles`` array and builds article records -- a per-row projection that
scales with the number of payload files.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.functions.ids import stable_id
from credlake.functions.scoring import score_article
from credlake.functions.text import or_default, strip_ws
from credlake.functions.times import to_iso
from credlake.operators.clean import build_article
from credlake.schemas import PAYLOAD_SCHEMA

REMOVED_TITLE = "[Removed]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def explode_payloads(payloads: DataFrame, fetched_at="fetched_at", payload="payload",
                     require_ok: bool = False) -> DataFrame:
    p = F.from_json(_c(payload), PAYLOAD_SCHEMA)
    df = payloads.select(p.alias("_p"), _c(fetched_at).alias("_fetched_at"))
    if require_ok:
        df = df.where(F.col("_p.status") == "ok")
    return df.select(F.explode(F.col("_p.articles")).alias("a"), "_fetched_at")


def _body(a: str = "a") -> Column:
    # Python ``description or content``: empty description falls through
    return F.coalesce(F.nullif(F.col(f"{a}.description"), F.lit("")), F.col(f"{a}.content"))


def normalize_newsapi(payloads: DataFrame, fetched_at="fetched_at", payload="payload") -> DataFrame:
    """Status must be ``ok``; source ``newsapi:<name>`` (absent -> unknown)."""
    items = explode_payloads(payloads, fetched_at, payload, require_ok=True)
    items = items.select(
        F.concat(F.lit("newsapi:"), F.coalesce(F.col("a.source.name"), F.lit("unknown"))).alias("source"),
        F.col("a.title").alias("title"), _body().alias("content"), F.col("a.url").alias("url"),
        F.col("a.publishedAt").alias("published_at"), F.col("_fetched_at").alias("fetched_at"))
    return build_article(items)


def normalize_gnews(payloads: DataFrame, fetched_at="fetched_at", payload="payload") -> DataFrame:
    """S3: no status check; source ``gnews:<name>`` (null or empty -> unknown)."""
    items = explode_payloads(payloads, fetched_at, payload)
    items = items.select(
        F.concat(F.lit("gnews:"), or_default(F.col("a.source.name"), "unknown")).alias("source"),
        F.col("a.title").alias("title"), _body().alias("content"), F.col("a.url").alias("url"),
        F.col("a.publishedAt").alias("published_at"), F.col("_fetched_at").alias("fetched_at"))
    return build_article(items)


def normalize_live(payloads: DataFrame, provider: str = "newsapi", fetched_at="fetched_at",
                   payload="payload") -> DataFrame:
    """The live path -- strip title/url before hashing, skip empty ones,
    drop ``[Removed]`` (NewsAPI), bare source name (default ``Unknown``),
    author (NewsAPI: stripped, empty -> null), category ``News``,
    published_at passed through, classified with the hash scorer."""
    newsapi = provider == "newsapi"
    items = explode_payloads(payloads, fetched_at, payload, require_ok=newsapi)
    title = strip_ws(F.coalesce(F.col("a.title"), F.lit("")))
    url = strip_ws(F.coalesce(F.col("a.url"), F.lit("")))
    items = items.select(title.alias("title"), url.alias("url"), "a", "_fetched_at")
    keep = (F.col("title") != "") & (F.col("url") != "")
    if newsapi:
        keep = keep & (F.col("title") != REMOVED_TITLE)
    content = strip_ws(F.coalesce(_body(), F.lit("")))
    author = (F.nullif(strip_ws(F.coalesce(F.col("a.author"), F.lit(""))), F.lit("")) if newsapi
              else F.lit(None).cast("string"))
    fetched_iso = to_iso(F.col("_fetched_at"))
    out = items.where(keep).select(
        stable_id("url", "title").alias("id"), "title",
        F.coalesce(F.col("a.source.name"), F.lit("Unknown")).alias("source"), "url",
        author.alias("author"), content.alias("content"),
        F.coalesce(F.nullif(F.col("a.publishedAt"), F.lit("")), fetched_iso).alias("published_at"),
        fetched_iso.alias("fetched_at"), F.col("_fetched_at").alias("scored_at"),
        F.lit("News").alias("category"))
    s = score_article("title", "content")
    return out.withColumn("label", s["label"]).withColumn("confidence", s["confidence"])
