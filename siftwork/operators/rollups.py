"""Per-file and per-run aggregates.

All are partial-then-final aggregations on small fixed-width state, so a file
with very many findings shrinks to one row per task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import labels

SEVERITY_COLUMNS = [s.lower() for s in fixed.SEVERITY_SCORES]


def severity_count_columns(severity: str = "severity") -> list[Column]:
    return [F.count_if(F.col(severity) == s).alias(s.lower()) for s in fixed.SEVERITY_SCORES]


def finding_rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Severity counts, risk score, total and worst score of each key that has findings."""
    return findings.groupBy(*keys).agg(
        *severity_count_columns(),
        F.sum("severity_score").cast("bigint").alias("risk_score"),
        F.count(F.lit(1)).alias("findings"),
        F.max("severity_score").alias("_worst"))


def dense(rolled: DataFrame) -> DataFrame:
    """Zeros instead of nulls where a file has no findings."""
    counts = [*SEVERITY_COLUMNS, "risk_score", "findings"]
    others = [c for c in rolled.columns if c not in counts and c != "_worst"]
    return rolled.select(
        *others,
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        labels.severity_of(F.col("_worst")).alias("worst_severity"))


def file_rollup(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per file, clean files included.  Both sides are one row per path."""
    return dense(files.join(finding_rollup(findings, "file_path"), "file_path", "left"))


def run_severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*severity_count_columns())


def run_rollup(files: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """One row for the run from the per-file rollup.

    Ties for the riskiest file go to the smallest path; without files it is null.
    """
    failing = [s.lower() for s, score in fixed.SEVERITY_SCORES.items()
               if score >= fixed.SEVERITY_SCORES[fail_on]]
    breaches = sum((F.col(c) for c in failing[1:]), F.col(failing[0])) > 0
    zero = F.lit(0).cast("bigint")
    return files.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.coalesce(F.sum("findings"), zero).alias("total_vulnerabilities"),
        F.count_if(F.col("from_cache")).alias("cache_hits"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in SEVERITY_COLUMNS],
        F.min_by("file_path", F.struct(-F.col("risk_score"), F.col("file_path"))).alias("riskiest_file"),
        F.coalesce(F.bool_or(breaches), F.lit(False)).alias("breached"))


def riskiest_file(files: DataFrame) -> DataFrame:
    """The file with the highest risk score, even if that is zero."""
    return files.orderBy(F.col("risk_score").desc(), "file_path").limit(1)


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """Whether any finding reaches the fail-on severity."""
    reached = F.col("severity_score") >= fixed.SEVERITY_SCORES[fail_on]
    return findings.agg(F.coalesce(F.bool_or(reached), F.lit(False)).alias("breached"))


def worst_severity(findings: DataFrame, *keys: str) -> DataFrame:
    return (findings.groupBy(*keys).agg(F.max("severity_score").alias("_worst"))
            .select(*keys, labels.severity_of(F.col("_worst")).alias("worst_severity")))


def distinct_contents(files: DataFrame) -> DataFrame:
    """One representative path (the smallest) and the number of copies per content hash."""
    return files.groupBy("file_hash").agg(
        F.min("file_path").alias("file_path"), F.count(F.lit(1)).alias("copies"))


def file_status(rollup: DataFrame) -> DataFrame:
    """One status line per file: error, worst severity with count, or clean."""
    count = F.when(F.col("from_cache"), "cached").otherwise(
        F.concat(F.col("findings").cast("string"), F.lit(" finding(s)")))
    failed = F.coalesce("error", F.lit("")) != ""
    return rollup.select(
        "file_path",
        F.when(failed, "error").when(F.col("findings") > 0, "findings").otherwise("clean").alias("status"),
        F.when(failed, F.col("error"))
        .when(F.col("findings") > 0, F.concat(F.col("worst_severity"), F.lit(" · "), count))
        .otherwise(F.concat(F.lit("clean ("), count, F.lit(")"))).alias("detail"))


def result_cards(files: DataFrame) -> DataFrame:
    """Files worst severity first; skipped files are left out, clean ones sort last."""
    position = {s: i for i, s in enumerate(fixed.SEVERITY_SCORES)}
    rank = None
    for name, value in position.items():
        rank = (F if rank is None else rank).when(F.coalesce("severity", F.lit("INFO")) == name, value)
    return (files.where("status <> 'skip'").withColumn("severity_rank", rank)
            .orderBy("severity_rank", "file_path"))
