"""Small builders shared by the tests."""

from pyspark.sql import functions as F

from siftwork.functions import labels
from siftwork.schema import FINDING_COLUMNS


def texts(spark, mapping):
    """(file_path, text) rows; the path doubles as key."""
    return spark.createDataFrame(list(mapping.items()), "file_path string, text string")


def findings(spark, rows, key="file_path"):
    """Findings from (key, ordinal, severity, type, line, confidence, source) tuples."""
    df = spark.createDataFrame(
        rows, f"{key} string, ordinal bigint, severity string, type string, line_number bigint, "
              "confidence double, source string")
    return df.select(
        key, "ordinal", "severity", labels.severity_score(F.col("severity")).alias("severity_score"), "type",
        F.concat(F.lit("about "), "type").alias("description"), F.lit("bad").alias("impact"),
        F.lit("mend \"it\"").alias("fix"), "line_number", labels.infer_owasp(F.col("type")).alias("owasp"),
        "confidence", "source").select(key, *FINDING_COLUMNS)


def values(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
