"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC (oracle comparisons and hour partitions),
# AQE with skew-join splitting and runtime broadcast conversion (the size
# check for data-derived small sides), and no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to ~128-256 MB per
    partition of the largest shuffle (AQE coalesces downwards).
    """
    b = SparkSession.builder.appName(app_name)
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
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(largest_shuffle_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster, sized from the biggest shuffle of the job.

    Initial shuffle partitions = max(bytes / 256 MB, 3 x total cores); AQE
    then coalesces small ones and splits skewed ones.  Scan splits of 256 MB
    keep per-task input in memory budget while producing few large tasks.
    """
    cores = executors * cores_per_executor
    parts = max(3 * cores, -(-largest_shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder; we only pick our
    own when the setting is absent, which is the local test case.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")        # local mode only (tests, bench)
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables that cut lineage)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Like ``checkpoint()`` it cuts lineage and fixes non-deterministic columns
    (range ids, row indices) for every later use and across executor loss,
    but it computes the input once (an RDD checkpoint recomputes it after
    the counting job) and keeps columnar pruning for the readers.
    """
    spark = df.sparkSession
    path = shared_path(spark, "materialized", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A ``materialize`` whose tables are deleted when the block ends.

    Inside the block shuffle files are deleted too, as soon as the query that wrote
    them ends (Spark else waits until the driver's garbage is collected).  So
    every frame that shuffles is to be run once, or kept.
    """
    root = shared_path(spark, "materialized", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")

    def keep(df, what: str):
        path = os.path.join(root, f"{what}-{uuid.uuid4().hex}")
        df.write.mode("error").parquet(path)
        return spark.read.parquet(path)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield keep
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df, min_partitions: int | None = None):
    """Round-robin a scan that arrives in fewer splits than the cluster has cores.

    A single-row-group file is one scan task however large the cluster;
    spreading it lets the CPU-heavy projections after the scan (JSON parsing,
    regexes, generators) run on every core.  A no-op for inputs that are
    already split (the normal case at scale).  Filters and column pruning
    are still pushed below the repartition into the scan.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str):
    """Load one driver-generated parquet table (spread when under-split)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
