"""Operator 4: token counts kept as additive totals, maintained by signed deltas.

A change is an insert, a delete or a revision of one document's count under
one tokenizer version.  Each batch of changes is reduced to one signed row per
(source, lang, tokenizer) and written to the batch's own folder of the rollup
table; totals are the sum over the committed folders.  A batch that is committed
already is left as it is, so a replay never counts twice and never takes a
folder away; one that was lost half-written is not read, and its retry replaces
it.  A hot source is pre-aggregated on the map side before the one narrow shuffle.

Edge cases: a null source, lang or tokenizer is a group of its own; a null
count is 0 tokens of one document; null text has no tokens; empty batches
leave an empty folder; repeated change rows count as often as they appear;
groups whose documents are all gone drop out of ``totals``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.sources.lake import _glob, exists

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("docs", "tokens", "bytes")
DELTA_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"

# tokenizer versions as patterns; every match is one token
TOKENIZERS = {
    "words_v1": "[^ \\t\\n\\x0B\\f\\r]+",
    "wordpunct_v1": "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]",
}


def count_tokens(text, tokenizer: str):
    """Token count of a text column under one of ``TOKENIZERS`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def signed(kind: str, prefix: str = ""):
    """The signed contribution of a change row's columns ``prefix + name``."""
    sign = {"add": 1, "remove": -1}[kind]
    return F.struct(
        *(F.col(prefix + k).alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"),
        *((sign * F.coalesce(F.col(prefix + m), F.lit(0)).cast("long")).alias(m) for m in MEASURES[1:]))


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row per group.

    ``changes``: op ('insert', 'delete' or 'revise') and, for the new state,
    source, lang, tokenizer, tokens, bytes; for the old state the same names
    with ``old_`` (read for deletes and revisions).  Other columns are ignored.
    """
    new, old = signed("add"), signed("remove", "old_")
    parts = (F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old))
             .when(F.col("op") == "revise", F.array(old, new)))
    return (changes.select(F.explode(parts).alias("d")).select("d.*").groupBy(*KEYS)
            .agg(*(F.sum(m).alias(m) for m in MEASURES))
            .filter(" or ".join(f"{m} <> 0" for m in MEASURES)))


def committed(spark: SparkSession, root: str) -> list[str]:
    """Folders of the batches that were written whole."""
    return [done.removesuffix("/_SUCCESS") for done in _glob(spark, f"{root}/batch=*/_SUCCESS")]


def commit(changes: DataFrame, root: str, batch: str) -> None:
    """Writes a batch's signed rows once; a committed batch given again changes nothing."""
    folder = f"{root}/batch={batch}"
    if not exists(changes.sparkSession, f"{folder}/_SUCCESS"):
        deltas(changes).write.mode("overwrite").parquet(folder)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """Current totals: the sum of all committed batches."""
    folders = committed(spark, root)
    rows = spark.read.schema(DELTA_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], DELTA_SCHEMA)
    return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter("docs <> 0")
