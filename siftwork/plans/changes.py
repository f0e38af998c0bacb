"""Scan of a change set: a file listing and the contents of the changed files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import is_scannable
from ..sources.inputs import decode_payload, mark_blank, scannable_changes
from .scan import ScanResult, scan


@dataclass
class ChangeScan:
    """`result` covers the scanned files; `skipped` names files without content."""

    result: ScanResult
    skipped: DataFrame


def listing_counts(listing: DataFrame) -> DataFrame:
    """How many files a listing names, and how many of them are scanned."""
    scanned = is_scannable(F.col("file_path")) & ~F.col("status").eqNullSafe("removed")
    return listing.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(scanned).alias("scannable_files"))


def scan_changes(listing: DataFrame, payloads: DataFrame, replies: DataFrame | None = None, **options) -> ChangeScan:
    """Scan the changed files of `listing` (file_path, status) with their base64
    `payloads` (file_path, encoding, content).

    No cache is used, a failed reply gives no finding but a row of `result.failed_replies`, and files
    whose content is missing or blank are skipped rather than reported.
    """
    wanted = scannable_changes(listing).select("file_path").distinct()
    files = mark_blank(decode_payload(wanted.join(payloads, "file_path", "left")))
    scanned = files.where(~F.col("skipped")).select("file_path", "text")
    return ChangeScan(scan(scanned, replies, None, report_failed_replies=False, **options),
                      files.where("skipped").select("file_path"))
