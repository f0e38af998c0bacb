"""Merging findings of the two analysers, and filtering what was merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions import labels
from .skew import spread_join


def uncovered(replies: DataFrame, static: DataFrame, *keys: str) -> DataFrame:
    """Reply findings whose type the static pass did not report for the same file.

    Lines play no part, and reply findings are never compared with each other.
    """
    keyed = replies.withColumn("_type_key", labels.type_key(F.col("type")))
    covered = static.select(*keys, labels.type_key(F.col("type")).alias("_type_key")).distinct()
    return spread_join(keyed, covered, [*keys, "_type_key"], "left_anti", ["ordinal"]).drop("_type_key")


def merge_findings(static: DataFrame, replies: DataFrame, *keys: str) -> DataFrame:
    """All static findings plus the uncovered reply findings."""
    return static.unionByName(uncovered(replies, static, *keys))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings at or above a severity.

    Apply after merging: a static finding below the threshold still covers a
    reply finding above it.
    """
    return findings.where(F.col("severity_score") >= fixed.SEVERITY_SCORES[severity])


def complete_findings(df: DataFrame) -> DataFrame:
    """Fill what a raw findings table may leave out: score, category, confidence, source."""
    have = set(df.columns)
    owasp = F.col("owasp") if "owasp" in have else F.lit(None).cast("string")
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in have else F.lit(1.0)
    source = F.coalesce("source", F.lit("llm")) if "source" in have else F.lit("llm")
    return (df.withColumn("severity_score", labels.severity_score(F.col("severity")))
            .withColumn("owasp", labels.fill_owasp(owasp, F.col("type")))
            .withColumn("confidence", confidence)
            .withColumn("source", source))
