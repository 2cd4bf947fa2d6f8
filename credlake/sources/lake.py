"""Bronze / silver / gold Parquet layers and the merged serving table
(S6, S7, S8, S9, S12 storage, S18, A1 from footers, W1-W3, W5).

Layout decisions
----------------
* Layers are partitioned by ``date`` (gold: ``date``, ``label``).  ``source``
  has unbounded cardinality, so it stays a column instead of a partition
  level (which would shred each day into one tiny file per source).
* Layers are always read with their fixed schema: partition values such as
  ``007`` or ``""`` would otherwise be re-typed on read.

The serving table (one row per id, partitioned by date) is kept by
:mod:`credlake.sources.serving`.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from credlake.schemas import BRONZE_SCHEMA, GOLD_SCHEMA, SILVER_SCHEMA
from credlake.session import few_tasks, list_in_few_tasks

# A filter for lookups by id, of the size its file's ids need: without ``adaptive`` every file has one of 1 MB, however few its rows
ID_BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
NULL_DATE = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null partition value
LAYER_SCHEMAS = {"bronze": BRONZE_SCHEMA, "silver": SILVER_SCHEMA, "gold": GOLD_SCHEMA}
LAYER_PARTITIONS = {"bronze": ("date",), "silver": ("date",), "gold": ("date", "label")}
SCORE_FILES_PER_TRIGGER = 16
SCORE_BYTES_PER_TRIGGER = 1024 ** 3  # one score micro-batch takes at most this much silver
PUBLISH_BYTES_PER_TRIGGER = 8 * 1024 ** 3  # one publish micro-batch merges at most this much gold


def trigger_args(trigger: str | None) -> dict:
    """``None`` -> availableNow (drain and stop); else a processing-time interval."""
    return {"availableNow": True} if trigger in (None, "availableNow") else {"processingTime": trigger}


def refuse_fresh_checkpoint(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Raise when a layer's sink log is ahead of the query's checkpoint.

    The file sink skips batch ids that its log holds; a new checkpoint starts
    again at batch 0, so its first batches would be dropped without a word.
    """
    if _glob(spark, f"{path}/_spark_metadata/*") and not _glob(spark, f"{checkpoint}/offsets/*"):
        raise ValueError(f"{path} was written under another checkpoint than {checkpoint}; "
                         "go on with that checkpoint, or write to a new layer folder")


def write_layer(df: DataFrame, path: str, checkpoint: str, partition_by=("date",),
                trigger: str | None = None, query_name: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet layer with its own checkpoint."""
    refuse_fresh_checkpoint(df.sparkSession, path, checkpoint)
    list_in_few_tasks(df.sparkSession)
    w = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy(*partition_by)
         .outputMode("append").trigger(**trigger_args(trigger)))
    if query_name:
        w = w.queryName(query_name)
    return w.start()


def batch_layer_frame(df: DataFrame, layer: str, sort_by=("source", "published_at")) -> DataFrame:
    """A batch of a layer laid out for writing (see :func:`write_batch_layer`)."""
    parts = LAYER_PARTITIONS[layer]
    return (df.select(*LAYER_SCHEMAS[layer].fieldNames()).hint("rebalance", *parts)
            .sortWithinPartitions(*parts, *sort_by))


def write_batch_layer(df: DataFrame, path: str, layer: str, mode: str = "overwrite",
                      sort_by=("source", "published_at")) -> None:
    """Batch write of a layer (e.g. a backfill of gold).

    ``rebalance`` on the partition columns lets AQE merge small shuffle
    partitions and split a hot date across several tasks, so a day holding a
    third of all rows is not written by one task; rows are sorted within files
    by ``sort_by`` (source filters then skip row groups).
    """
    (batch_layer_frame(df, layer, sort_by).write.mode(mode)
     .options(**ID_BLOOM)  # point lookups by id (T2) skip row groups
     .partitionBy(*LAYER_PARTITIONS[layer]).parquet(path))


def write_by_date(df: DataFrame, path: str) -> None:
    """Batch write by date: without the ``rebalance`` every task would write a file into every date."""
    df.hint("rebalance", "date").write.partitionBy("date").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str, stream: bool = False,
               max_files_per_trigger: int | None = SCORE_FILES_PER_TRIGGER,
               max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Read a layer (batch or stream) with its fixed schema.

    A stream is rate-limited by files (the reference's setting) or, when
    ``max_bytes_per_trigger`` is given, by bytes -- the bound that keeps a
    micro-batch's size fixed whatever the file sizes are.
    """
    schema = LAYER_SCHEMAS[layer]
    list_in_few_tasks(spark)
    if stream:
        r = spark.readStream.schema(schema).format("parquet")
        if max_bytes_per_trigger:
            r = r.option("maxBytesPerTrigger", str(int(max_bytes_per_trigger)))
        elif max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return r.load(path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# -- file-system helpers (driver-side metadata calls only) -------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    return [] if st is None else [s.getPath().toString() for s in st]


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


# -- S18 ---------------------------------------------------------------------

def layer_inventory(spark: SparkSession, base: str, tiers=("bronze", "silver", "gold")) -> DataFrame:
    """Per tier -- exists, number of Parquet files, rows (one scan each, in few tasks:
    no column is read, and a layer may have files by the ten thousand)."""
    frames = []
    tasks = few_tasks(spark)
    for t in tiers:
        path = f"{base}/{t}"
        if exists(spark, path) and _glob(spark, f"{path}/*"):
            df = read_layer(spark, path, t) if t in LAYER_SCHEMAS else spark.read.parquet(path)
            per_file = df.select(F.col("_metadata.file_path").alias("f")).coalesce(tasks).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
            frames.append(per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
                          .select(F.lit(t).alias("tier"), F.lit(True).alias("exists"), "files", "rows"))
        else:
            frames.append(spark.range(1).select(F.lit(t).alias("tier"), F.lit(False).alias("exists"),
                                                F.lit(0).cast("long").alias("files"),
                                                F.lit(0).cast("long").alias("rows")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- answers from file footers (S18, A1) ---------------------------------------

def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose Parquet counts come from file footers.

    The settings that switch Spark's aggregate push-down on hold for a whole session,
    so the caller's own one is left as it is."""
    s = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        s.conf.set(name, spark.conf.get(name))
    v1 = [f for f in s.conf.get("spark.sql.sources.useV1SourceList").split(",") if f != "parquet"]
    s.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def footer_counts(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Rows of each partition of a layer (gold: date, label), summed over the footers:
    ``COUNT(*)`` grouped by all partition columns is what a footer answers without
    decoding a row.  Empty for a layer that is not there."""
    parts = LAYER_PARTITIONS[layer]
    s = footer_session(spark)
    if not _glob(s, f"{path}/*"):
        return s.createDataFrame([], LAYER_SCHEMAS[layer]).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    return s.read.schema(LAYER_SCHEMAS[layer]).parquet(path).groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


def footer_inventory(spark: SparkSession, base: str, tiers=("bronze", "silver", "gold")) -> DataFrame:
    """S18 from footers: tier, exists, files, rows, partitions, first and last date.

    The number of files comes from the listing that every read makes."""
    s = footer_session(spark)
    frames = []
    for tier in tiers:
        path = f"{base}/{tier}"
        there = bool(_glob(s, f"{path}/*"))
        counts = s.createDataFrame([], LAYER_SCHEMAS[tier])
        files = 0
        if there:
            counts = s.read.schema(LAYER_SCHEMAS[tier]).parquet(path)
            files = len(counts._jdf.inputFiles())  # counted in the JVM; the names stay there
        per_part = counts.groupBy(*LAYER_PARTITIONS[tier]).agg(F.count(F.lit(1)).alias("n"))
        frames.append(per_part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("partitions"),
                                   F.min("date").alias("first_date"), F.max("date").alias("last_date"))
                      .select(F.lit(tier).alias("tier"), F.lit(there).alias("exists"), F.lit(files).cast("long").alias("files"),
                              "rows", "partitions", "first_date", "last_date"))
    return reduce(DataFrame.unionByName, frames)


# -- serving table -----------------------------------------------------------

def read_serving(spark: SparkSession, table: str, schema: StructType = GOLD_SCHEMA) -> DataFrame:
    """The merged table (empty before its first merge)."""
    if not exists(spark, table):
        return spark.createDataFrame([], schema)
    list_in_few_tasks(spark)
    return spark.read.schema(schema).parquet(table).select(*schema.fieldNames())
