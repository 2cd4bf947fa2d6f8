"""Helpers shared by the training-data operators."""
from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.session import work_dir


#: rows of an Arrow batch: whole texts travel in batches of a few MB, on both sides
TEXT_BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage with a table every executor can reach: a lost executor
    costs its running tasks, never the work of earlier steps.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    path = work_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a scratch table of this run whose last reader is done."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Gives a Python worker's unused memory back; Spark keeps workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ordered_index(df: DataFrame, order: Sequence[Column], name: str, index: str) -> DataFrame:
    """``df`` with ``index``: each row's 0-based place in the total order ``order``.

    Rows are range-partitioned and sorted, so no key or group meets in one
    task; only one row per *partition* (its size) passes through the driver.
    Equal rows in the order take consecutive places.
    """
    spark = df.sparkSession
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id())
                   .withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"),
                                        F.min("_at").alias("first")).collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total - row["first"]))
        total += row["n"]
    shift = spark.createDataFrame(offsets, "_part int, _shift long")
    return (placed.join(F.broadcast(shift), "_part")
            .withColumn(index, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner",
                ways: int = 16) -> DataFrame:
    """Equi-join whose key may be hot on the ``many`` side.

    Rows of ``many`` are dealt over ``ways`` salts by the columns ``by``; the
    narrow side ``few`` is repeated once per salt, so no key meets in one task.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node it reaches.

    Labels spread to neighbours and then jump to their own label's label, so
    the rounds grow with the logarithm of the longest path; every round is a
    table in the shared folder.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = (spread_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], ["a"])
                .groupBy("a").agg(F.min("label").alias("near")))
        low = saved(labels.join(near, F.col("node") == F.col("a"))
                    .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{name}-low")
        roots = low.select("label").distinct().join(low.select(F.col("node").alias("label"), F.col("label").alias("root")), "label")
        labels = saved(spread_join(low, roots, ["label"], ["node"])
                       .select("node", "old", F.col("root").alias("label")), name)
        if labels.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``ids.row_id``; null keys stay.

    Up to BROADCAST_IDS counted ids (8 bytes each) are broadcast, so the texts
    stay where they are; beyond, both sides are shuffled by the key.
    """
    ids = saved(ids.select(F.col("row_id").alias("__dropped")).distinct(), "dropped")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    named = docs.withColumn("__key", key)
    return named.join(ids, F.col("__key") == F.col("__dropped"), "left_anti").drop("__key")
