"""Tables that enter a scan: decoded texts, change listings, payloads, saved replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import detect_language, is_scannable
from ..functions.text import decode_utf8, fingerprint, is_blank
from ..operators.skew import first_wins

REPLY_SCHEMA = "file_hash string, response_text string, error string"
LISTING_SCHEMA = "filename string, status string"


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("text", decode_utf8(F.col(content))).drop(content)


def with_identity(files: DataFrame) -> DataFrame:
    """Adds content hash and language; files that could not be read get neither."""
    failed = F.coalesce("error", F.lit("")) != ""
    return (files
            .withColumn("file_hash", F.when(failed, "").otherwise(fingerprint(F.col("text"))))
            .withColumn("language", F.when(failed, "unknown").otherwise(detect_language(F.col("file_path")))))


def with_read_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Every path of a manifest, with an error where no content could be read."""
    joined = manifest.select("file_path").distinct().join(files, "file_path", "left")
    have = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    missing = F.when(F.col("text").isNull(), F.coalesce(have, F.lit("file not found or not readable")))
    return joined.withColumn("error", missing)


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Scannable files named in a change listing."""
    scoped = files.where(is_scannable(F.col("file_path")))
    return scoped.join(changed.select("file_path").distinct(), "file_path", "left_semi")


def scannable_changes(listing: DataFrame, path: str = "file_path") -> DataFrame:
    """Changed files that still exist and can be scanned; a missing status counts as present."""
    return listing.where(is_scannable(F.col(path)) & ~F.col("status").eqNullSafe("removed"))


def read_pr_listing(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pull-request file listings reduced to what is scanned: saved pages (a JSON
    array per file) or JSON lines.  All pages of a listing are read."""
    listing = spark.read.schema(LISTING_SCHEMA).json(path, multiLine=not lines)
    return scannable_changes(listing, "filename").withColumnRenamed("filename", "file_path")


def decode_payload(payloads: DataFrame) -> DataFrame:
    """Contents of changed files to text: base64 (`encoding`, `content`), else the raw `text` column.

    Code hosts send large files with another encoding and no content; their raw
    text, where the table has it, is taken as it is.  Nothing at all gives "".
    """
    raw = F.col("text") if "text" in payloads.columns else F.lit(None).cast("string")
    # White space needs no cleaning, and a pattern on every character costs more than all the rest of a scan.
    packed = F.regexp_replace("content", "[^A-Za-z0-9+/=]", "")
    binary = F.coalesce(F.try_to_binary("content", F.lit("base64")), F.try_to_binary(packed, F.lit("base64")))
    content = F.when(F.col("encoding") == "base64", binary)
    return (payloads.withColumn("text", F.coalesce(decode_utf8(content), raw, F.lit("")))
            .drop("encoding", "content"))


def mark_blank(files: DataFrame) -> DataFrame:
    """Adds `skipped`: true for texts of white space only."""
    return files.withColumn("skipped", is_blank(F.col("text")))


def drop_blank(files: DataFrame) -> DataFrame:
    return files.where(~is_blank(F.col("text")))


def one_reply_each(replies: DataFrame) -> DataFrame:
    """One reply per content hash: usable ones before failed ones, then the smallest text."""
    failed = F.col("error").isNotNull() | F.col("response_text").isNull()
    return first_wins(replies, ["file_hash"], failed, "response_text", "error")


def read_replies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved model replies; `one_reply_each` picks one where a content has several."""
    return spark.read.format(fmt).schema(REPLY_SCHEMA).load(path)
