"""Session helpers: runtime options, the shared folder, and written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL options the jobs are designed around; all can be set on a live
#: session.  A skewed join may be split even when that costs one more shuffle,
#: and Arrow batches are bounded by bytes because a row holds a whole text.
#: Streaming state lives in RocksDB, outside the heap.
RUNTIME_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "siftwork", master: str | None = None,
                  options: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_OPTIONS, **(options or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to a session built elsewhere."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, per_partition: int = 256 << 20) -> int:
    """Start shuffles wide enough for an input of the given size.

    Adaptive execution merges small partitions but cannot split evenly large
    ones, so the starting number has to fit the data: about 256 MB each, never
    below the session's own setting.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(current, -(-input_bytes // per_partition))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's number, or the one `size_shuffles` set for the input."""
    wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(wide or 0))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a single-process local session without the setting, as in tests, gets a
    folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="siftwork-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared folder and continue from the files.

    Used where several branches read one expensive result.  The copy survives
    lost executors, and being parquet it keeps column pruning, filter pushdown
    and size statistics for the branches.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
