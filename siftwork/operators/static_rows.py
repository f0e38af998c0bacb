"""Narrow hits of the static pass to full findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels
from ..schema import finding_rows


def static_rows(hits: DataFrame, message: dict[str, Column], *keys: str) -> DataFrame:
    """Rows of (keys, ordinal, line_number, ...) with their label and text columns."""
    described = hits.select(*keys, "ordinal", "line_number", *[c.alias(name) for name, c in message.items()])
    full = described.select(
        "*",
        labels.severity_score(F.col("severity")).alias("severity_score"),
        labels.infer_owasp(F.col("type")).alias("owasp"),
        F.lit("static").alias("source"))
    return finding_rows(full, *keys)
