"""Fixed schemas of the article lake (raw, envelope, silver, gold, payloads)."""
from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

ARTICLE_FIELDS = ["id", "source", "title", "content", "url", "published_at", "fetched_at"]

# Wire form of one article: seven strings, timestamps as ISO-8601 text.
RAW_SCHEMA = StructType([StructField(c, StringType(), c != "id") for c in ARTICLE_FIELDS])

# A landed message of the raw topic (or a file stand-in for it).
ENVELOPE_SCHEMA = StructType([
    StructField("key", StringType()),
    StructField("value", StringType()),
    StructField("timestamp", TimestampType()),
])

PARSED_COLUMNS = ARTICLE_FIELDS + ["kafka_key", "kafka_ts", "date"]

# Silver is always read with this schema (never inferred): partition values
# such as "007" or "" would otherwise be re-typed on read.
SILVER_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ARTICLE_FIELDS]
    + [
        StructField("kafka_key", StringType()),
        StructField("kafka_ts", TimestampType()),
        StructField("lang_guess", StringType()),
        StructField("date", DateType()),
    ]
)

BRONZE_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ARTICLE_FIELDS]
    + [
        StructField("kafka_key", StringType()),
        StructField("kafka_ts", TimestampType()),
        StructField("date", DateType()),
    ]
)

PREDICTION_SCHEMA = StructType([
    StructField("label", StringType()),
    StructField("confidence", DoubleType()),
])

GOLD_COLUMNS = ["id", "source", "title", "content", "url", "published_at", "fetched_at",
                "date", "label", "confidence", "scored_at"]

# Scored articles: typed timestamps (compared as time, never as text).
GOLD_SCHEMA = StructType([
    StructField("id", StringType()),
    StructField("source", StringType()),
    StructField("title", StringType()),
    StructField("content", StringType()),
    StructField("url", StringType()),
    StructField("published_at", TimestampType()),
    StructField("fetched_at", TimestampType()),
    StructField("date", DateType()),
    StructField("label", StringType()),
    StructField("confidence", DoubleType()),
    StructField("scored_at", TimestampType()),
])

# Provider payloads (news search APIs).
PROVIDER_ARTICLE = StructType([
    StructField("source", StructType([
        StructField("id", StringType()),
        StructField("name", StringType()),
    ])),
    StructField("author", StringType()),
    StructField("title", StringType()),
    StructField("description", StringType()),
    StructField("content", StringType()),
    StructField("url", StringType()),
    StructField("publishedAt", StringType()),
])

PAYLOAD_SCHEMA = StructType([
    StructField("status", StringType()),
    StructField("articles", ArrayType(PROVIDER_ARTICLE)),
])

TRAINING_SCHEMA = StructType([
    StructField("text", StringType()),
    StructField("label", IntegerType()),
    StructField("source", StringType()),
])

COUNT_TYPE = LongType()
