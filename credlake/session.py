"""Session construction and shared-folder helpers."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every credlake job relies on: UTC for all time arithmetic and
# AQE so shuffle partition counts / skewed joins are re-planned at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state (D1's seen-id set, D2, W6/W7 aggregates) lives in RocksDB
    # off the JVM heap; changelog checkpoints upload only what a batch changed
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "credlake", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the credlake defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it (a path every executor can reach).  Where it is unset, a
    local master gets a folder of its own, as in tests; on a cluster, where no
    folder of this machine would do, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="credlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # pragma: no cover - connect sessions have no context
        pass
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/credlake/{name}-{uuid.uuid4().hex[:12]}"


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_in_few_tasks(spark: SparkSession) -> None:
    """Spark lists folders, and the files of a micro-batch, with a task a path up to 10,000.

    A few tasks a core list them in a fraction of the time; a caller's own setting stays."""
    if spark.conf.get(LISTING) == "10000":
        spark.conf.set(LISTING, str(few_tasks(spark)))


TASK_BYTES = 64 * 1024 ** 2


def few_tasks(spark: SparkSession, most_bytes: int = 0) -> int:
    """Tasks that keep every core busy, for work that has a task for every few small files
    otherwise; enough of them for ``most_bytes`` of files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, most_bytes // TASK_BYTES)


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
