"""Incremental scans of a source tree as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.secrets import BUILTIN_PATTERNS
from ..plans.scan import scan
from ..schema import FINDING_COLUMNS
from ..session import materialise
from ..sources.cache import FindingCache
from ..sources.tree import read_listing, stream_listing


def start_scan_stream(spark: SparkSession, roots, out: str, checkpoint: str, *,
                      replies: DataFrame | None = None, cache: FindingCache | None = None,
                      use_static: bool = True, min_severity: str = "LOW", gate: str = "python",
                      patterns=BUILTIN_PATTERNS, settle_seconds: float = 2.0,
                      known_directories: str | None = None, **trigger) -> StreamingQuery:
    """Scan new and changed files of each micro-batch with the batch plan.

    Results go to `out/files/batch=N` and `out/findings/batch=N`; a retried batch
    overwrites its own folders.  With a cache, known contents are not analysed
    again, and the batch's results are stored under a run named after the query
    and batch id, so a retry changes nothing.  With `known_directories` (a folder all
    executors can write, of this query alone) a trigger lists changed directories only,
    which misses files written in place.
    """
    def run(listing: DataFrame, batch_id: int) -> None:
        files = materialise(read_listing(listing), "batch")
        if files.isEmpty():
            return
        result = scan(files, replies, cache, use_static=use_static,
                      min_severity=min_severity, gate=gate, patterns=patterns)
        # Results are written before the cache changes: a retry that finds its
        # own contents cached reports the same findings.
        result.files.write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")
        (result.findings.select("file_path", "file_hash", "language", *FINDING_COLUMNS)
         .write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}"))
        if cache:
            cache.put(result.fresh_entries, result.fresh_findings, f"{checkpoint}#{batch_id}")

    return (stream_listing(spark, roots, settle_seconds=settle_seconds, known_directories=known_directories).writeStream
            .option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**trigger).start())


def latest_scan_results(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Files and findings of the last batch that saw each path."""
    files = spark.read.parquet(f"{out}/files")
    newest = files.groupBy("file_path").agg(F.max("batch").alias("batch"))
    keys = ["file_path", "batch"]
    findings = spark.read.parquet(f"{out}/findings")
    return (files.join(newest, keys, "left_semi").drop("batch"),
            findings.join(newest, keys, "left_semi").drop("batch"))
