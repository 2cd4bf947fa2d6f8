"""Corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and reads it again as the
next stage's documents.  All stages but the last return the columns of
documents.

Nulls and repeats: a document without a doc_id cannot be named as dropped and
is kept by the filtering stages; documents that share a doc_id share its
verdict; extra columns are carried along; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.llm import catalogue, decontaminate, jaccard_join, language, surrogates
from credlake.llm.common import saved, table, without

#: a document stays when its best language has at least this posterior
LEAST_PROBABILITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose evidence names no language: text like none of the
    trained languages, or no text and nothing else to go by.

    The lang column is what the source declares; the source is the host.  A text
    whose declared language had too few rows to train stays: nothing here can
    tell against it.
    """
    model = language.train(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    if not model.languages:
        return docs
    row = F.xxhash64("doc_id", "text", "lang", "source")
    rows = docs.select(row.alias("row_id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))
    judged = language.identify(rows, model)
    trained = F.col("declared").isin([name.lower() for name in model.languages])
    unheard = language.names_a_language(F.col("declared")) & ~F.coalesce(trained, F.lit(False))
    unlike = (F.col("lang") == language.UND) | (F.col("probability") < LEAST_PROBABILITY)
    rejected = judged.filter(unlike & ~unheard | ~F.col("has_text"))
    return without(docs, rejected.select("row_id"), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id stays."""
    joined = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    copies = joined.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("row_id")).distinct()
    repeated = saved(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():  # whole rows given twice are copies, too
        again = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(repeated, "doc_id", "left_anti").union(again.select(*docs.columns))
    return without(docs, copies, F.col("doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = found.filter("n_hit > 0").select(F.col("doc_id").alias("row_id")).distinct()
    return without(docs, leaks, F.col("doc_id"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the new text."""
    done = surrogates.replace_pii(docs, catalogue.SURROGATE_KEY, count_as="__replaced")
    counted = F.when(F.col("__replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", counted).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return catalogue.packed_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: byte-pair ids, components and surrogates are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
