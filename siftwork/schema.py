"""Row shapes shared by every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

#: One finding inside a nested document or a cached JSON value.
FINDING_JSON = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("fix", T.StringType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("owasp", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

FINDING_FIELDS = FINDING_JSON.fieldNames()

#: Columns of a findings table besides the key of the file it belongs to.
FINDING_COLUMNS = [
    "ordinal", "severity", "severity_score", "type", "description", "impact",
    "fix", "line_number", "owasp", "confidence", "source",
]

# An ordinal packs (stage, position, sub) so that arrival order survives an
# unordered engine: risky calls, then secrets, then reply blocks.
SUB_BITS = 20
STAGE_BITS_AT = 56
STAGE_CALL, STAGE_SECRET, STAGE_REPLY = 0, 1, 2
MAX_PATTERNS = 1 << SUB_BITS


def stage_base(stage: int) -> int:
    return stage << STAGE_BITS_AT


def finding_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Project to key columns plus the standard finding columns."""
    return df.select(*keys, *FINDING_COLUMNS)
