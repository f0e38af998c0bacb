"""Result cache: findings of contents scanned before, keyed by content hash.

Two plain parquet tables, one row per content (`entries`) and one per finding
(`findings`), so that nothing is nested and an empty result is an entry without
findings.  Both are partitioned by the first digits of the hash, so a batch reads the
partitions of its hashes only.  Runs append; the last run that stored a hash wins when it is read.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import labels
from ..operators.skew import first_wins
from ..schema import FINDING_FIELDS, FINDING_JSON, finding_rows

ENTRY_SCHEMA = "file_hash string, file_path string, language string, scanned_at timestamp, passes string"
#: The passes an entry may stand for, joined by "+" in `passes`; null stands for all.
STATIC_PASS, REPLY_PASS = "static", "replies"
FINDING_SCHEMA = (
    "file_hash string, ordinal bigint, severity string, severity_score int, type string, description string, "
    "impact string, fix string, line_number bigint, owasp string, confidence double, source string")
#: What a run adds to its rows, and the partition column.
_STORED = "run string, stored_at bigint, prefix string"

FINDINGS_TYPE = T.ArrayType(FINDING_JSON)


@dataclass
class CacheTables:
    entries: DataFrame
    findings: DataFrame


def upsert_cache(cache: DataFrame, new: DataFrame, *order) -> DataFrame:
    """New rows replace cached rows of the same hash; the last of several new ones wins."""
    latest = first_wins(new, ["file_hash"], *(order or (F.col("scanned_at").desc(), F.col("file_path").asc())))
    return cache.join(latest.select("file_hash"), "file_hash", "left_anti").unionByName(latest)


def cache_lookup(hashes: DataFrame, entries: DataFrame, needed: list[str] = ()) -> DataFrame:
    """Distinct hashes with `from_cache`; both sides hold a hash once.

    An entry that lacks one of the `needed` passes does not count.
    """
    if "passes" in entries.columns:
        for name in needed:
            entries = entries.where(F.col("passes").isNull() | F.array_contains(F.split("passes", "[+]"), name))
    known = entries.select("file_hash", F.lit(True).alias("_hit"))
    return (hashes.join(known, "file_hash", "left")
            .withColumn("from_cache", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("cached_files"),
                       F.min("scanned_at").alias("oldest"), F.max("scanned_at").alias("newest"))


def findings_to_json(findings: DataFrame, *keys: str) -> DataFrame:
    """Each finding as one JSON text, nulls kept."""
    return findings.select(*keys, "ordinal", F.to_json(
        F.struct(*FINDING_FIELDS), {"ignoreNullFields": "false"}).alias("finding"))


def findings_from_json(rows: DataFrame, *keys: str, column: str = "vulnerabilities") -> DataFrame:
    """Typed findings from a JSON array text per content, with defaults filled in.

    A text that is no such array fails the job: it must not pass for a clean content.
    """
    each = rows.select(*keys, F.posexplode(F.from_json(column, FINDINGS_TYPE, {"mode": "FAILFAST"})).alias("_pos", "v"))
    typed = each.select(*keys, F.col("_pos").cast("bigint").alias("ordinal"), "v.*")
    typed = (typed.withColumn("severity_score", labels.severity_score(F.col("severity")))
             .withColumn("owasp", labels.fill_owasp(F.col("owasp"), F.col("type")))
             .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
             .withColumn("source", F.coalesce("source", F.lit("llm"))))
    return finding_rows(typed, *keys)


class FindingCache:
    """The tables `entries` and `findings` below a folder, partitioned by the first `digits` digits of the hash."""

    def __init__(self, spark: SparkSession, root: str, digits: int = 2):
        self.spark, self.root, self.digits = spark, root.rstrip("/"), digits

    def _prefix(self) -> Column:
        return F.concat(F.lit("h"), F.left("file_hash", F.lit(self.digits)))

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, {_STORED}").parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, {_STORED}")

    def read(self, only: DataFrame | None = None) -> CacheTables:
        """Current entries and findings: per hash, those of the run that stored it last.

        With `only` (a table with `file_hash`) just these hashes are looked at: the partitions that
        hold none of them, by at most 16 ** digits names, are not read.
        """
        entries, findings = self._read("entries", ENTRY_SCHEMA), self._read("findings", FINDING_SCHEMA)
        if only is not None:
            wanted = [r.p for r in only.select(self._prefix().alias("p")).distinct().collect()]
            entries = (entries.where(F.col("prefix").isin(wanted))
                       .join(only.select("file_hash").distinct(), "file_hash", "left_semi"))
            findings = findings.where(F.col("prefix").isin(wanted))
        latest = first_wins(entries, ["file_hash"], F.col("stored_at").desc(), F.col("run").desc())
        # A run that was repeated may have stored its findings twice.
        found = (findings.join(latest.select("file_hash", "run"), ["file_hash", "run"], "left_semi")
                 .dropDuplicates(["file_hash", "ordinal"]))
        return CacheTables(latest.drop("run", "stored_at", "prefix"), found.drop("run", "stored_at", "prefix"))

    def _append(self, table: str, rows: DataFrame, run: str) -> None:
        stored = rows.select("*", F.lit(run).alias("run"), F.lit(time.time_ns()).alias("stored_at"), self._prefix().alias("prefix"))
        # One file a partition, more where one would be large.
        stored.hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{self.root}/{table}")

    def put(self, entries: DataFrame, findings: DataFrame, run: str | None = None) -> str:
        """Append results of newly scanned contents; one row per hash in `entries`.  Returns the name of the run.

        Findings come first: they count once an entry of their run is there, so a writer that is lost in
        between leaves nothing visible, and a run repeated under its name changes nothing.
        """
        run = run or uuid.uuid4().hex
        if "passes" not in entries.columns:
            entries = entries.withColumn("passes", F.lit(None).cast("string"))
        self._append("findings", finding_rows(findings, "file_hash"), run)
        self._append("entries", entries.select("file_hash", "file_path", "language", "scanned_at", "passes"), run)
        return run

    def clear(self) -> int:
        """Forget everything; returns the number of contents forgotten."""
        count = self.read().entries.count()
        for table, schema in (("entries", ENTRY_SCHEMA), ("findings", FINDING_SCHEMA)):
            nothing = self.spark.createDataFrame([], f"{schema}, {_STORED}")
            nothing.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.root}/{table}")
        return count

    def stats(self) -> DataFrame:
        return cache_stats(self.read().entries)
