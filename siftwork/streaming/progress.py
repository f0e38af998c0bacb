"""Scan progress: typed events folded to file, scan and run status.

The folds are order-independent aggregates over sequence numbers that can be merged,
so the same expressions serve batch tables, micro-batches and what is stored between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..functions import labels
from ..functions.text import progress_pct
from ..operators.ordering import rank_in_file, with_position
from ..operators.rollups import SEVERITY_COLUMNS
from ..schema import FINDING_JSON, finding_rows
from ..session import materialise

FINDING_LIST = f"array<{FINDING_JSON.simpleString()}>"
EVENT_SCHEMA = (
    "scan_id bigint, seq bigint, type string, level string, text string, detail string, "
    "file string, language string, `index` bigint, total bigint, findings bigint, severity string, "
    "title string, repo string, pr_num bigint, branch string, author string, avatar string, pr_url string, "
    "total_files bigint, scannable_files bigint, sha string, total_findings bigint, "
    "severity_counts map<string,bigint>, vulns " + FINDING_LIST
)


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event lines (one JSON object each) as one wide table; `type` tells the kind."""
    return lines.select(F.from_json(F.col(column), EVENT_SCHEMA).alias("e")).select("e.*")


def event_findings(events: DataFrame) -> DataFrame:
    """Findings that results of files carry (`vulns` of file_done), one row each with the event's seq."""
    each = events.where("type = 'file_done'").select(
        "scan_id", "file", "seq", F.posexplode("vulns").alias("_pos", "v"))
    typed = each.select("scan_id", "file", "seq", F.col("_pos").cast("bigint").alias("ordinal"), "v.*")
    typed = (typed.withColumn("severity_score", labels.severity_score(F.col("severity")))
             .withColumn("owasp", labels.fill_owasp(F.col("owasp"), F.col("type")))
             .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
             .withColumn("source", F.coalesce("source", F.lit("llm"))))
    return finding_rows(typed, "scan_id", "file", "seq")


#: Findings that one event carries at most.  A file with more has several results, each with the file's totals.
EVENT_FINDINGS = 1_000
#: Sequence numbers a file of a finished scan has: its start, a warning, its results.
SEQ_BITS = 24


def scan_result_events(scan_id: int, files: DataFrame, findings: DataFrame, failed_replies: DataFrame | None = None) -> DataFrame:
    """A finished scan as the events of a running one: per file a start with its place, a warning if its
    reply failed, then its results, worst finding first, or a skip if it could not be read; completion last.

    `failed_replies` has file_path and error.  Files are numbered by path without gathering them, and no
    event holds more than EVENT_FINDINGS findings.
    """
    placed = materialise(with_position(files.select(
        "file_path", "language", "findings", "worst_severity",
        (F.coalesce("error", F.lit("")) != "").alias("failed"), *SEVERITY_COLUMNS).orderBy("file_path"))
        .withColumn("index", F.col("position") - 1).withColumn("_seq", F.shiftleft(F.col("position") - 1, SEQ_BITS)), "event-files")
    total = F.lit(placed.count()).cast("bigint")
    scan = F.lit(scan_id).cast("bigint").alias("scan_id")

    def of(rows: DataFrame, kind: str, seq: Column, *columns) -> DataFrame:
        return rows.select(scan, seq.alias("seq"), F.lit(kind).alias("type"), F.col("file_path").alias("file"), *columns)

    start = of(placed, "file_start", F.col("_seq"), "language", "index", total.alias("total"))
    skip = of(placed.where("failed"), "file_skip", F.col("_seq") + 2)
    part = F.floor((F.col("rank_in_file") - 1) / EVENT_FINDINGS)
    vulns = (rank_in_file(findings.select("file_path", "severity_score", "ordinal", *FINDING_JSON.fieldNames()), "file_path")
             .groupBy("file_path", part.alias("_part")).agg(F.array_sort(F.collect_list(
                 F.struct("rank_in_file", F.struct(*FINDING_JSON.fieldNames()).alias("v")))).alias("_v")))
    done = of(placed.where("not failed").join(vulns, "file_path", "left"), "file_done",
              F.col("_seq") + 2 + F.coalesce("_part", F.lit(0)), "language", F.col("findings").cast("bigint").alias("findings"),
              F.col("worst_severity").alias("severity"),
              F.coalesce(F.transform("_v", lambda x: x["v"]), F.array().cast(FINDING_LIST)).alias("vulns"))
    zero = F.lit(0).cast("bigint")
    complete = placed.where("not failed").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("findings"), zero).alias("total_findings"),
        F.create_map(*[x for name, c in zip(fixed.SEVERITY_SCORES, SEVERITY_COLUMNS)
                       for x in (F.lit(name), F.coalesce(F.sum(c), zero))]).alias("severity_counts")).select(
        scan, F.shiftleft(total, SEQ_BITS).alias("seq"), F.lit("complete").alias("type"), "total_files", "total_findings", "severity_counts")
    parts = [start, skip, done, complete]
    if failed_replies is not None:
        warned = placed.join(failed_replies.select("file_path", "error"), "file_path")
        text = F.concat(F.lit("LLM failed for "), F.col("file_path"), F.lit(": "), F.coalesce("error", F.lit("empty reply")))
        parts.append(of(warned, "log", F.col("_seq") + 1, F.lit("warning").alias("level"), text.alias("text")))
    events = files.sparkSession.createDataFrame([], EVENT_SCHEMA)
    for rows in parts:
        events = events.unionByName(rows, allowMissingColumns=True)
    return events


def error_event(spark: SparkSession, scan_id: int, seq: int, text: str, detail: str | None = None) -> DataFrame:
    """The event with which a scan that could not go on ends."""
    return spark.createDataFrame([(scan_id, seq, "error", text, detail)],
                                 "scan_id bigint, seq bigint, type string, text string, detail string")


#: What is known of a (scan, file): merged by minima and maxima, in any order and any number of times.
_FOLD = {
    "first_start": F.min, "start": F.max, "done": F.max, "skip": F.max, "complete": F.max, "failed": F.max,
}
FOLD_SCHEMA = (
    "scan_id bigint, file string, first_start bigint, "
    "start struct<seq: bigint, language: string, `index`: bigint, total: bigint>, "
    "done struct<seq: bigint, findings: bigint, severity: string>, skip bigint, "
    "complete struct<seq: bigint, total_files: bigint>, failed bigint"
)


def _fold(events: DataFrame) -> DataFrame:
    """Newest start, result and skip per (scan, file), and how the scan ended.

    Completion and failure carry no file and form a group of their own.
    """
    kind, seq = F.col("type"), F.col("seq")

    def newest(name, *columns):
        return F.max(F.when(kind == name, F.struct(seq, *columns)))
    return (events.where(kind.isin("file_start", "file_done", "file_skip", "complete", "error"))
            .groupBy("scan_id", F.when(~kind.isin("complete", "error"), F.col("file")).alias("file")).agg(
                F.min(F.when(kind == "file_start", seq)).alias("first_start"),
                newest("file_start", "language", "index", "total").alias("start"),
                newest("file_done", "findings", "severity").alias("done"),
                F.max(F.when(kind == "file_skip", seq)).alias("skip"),
                newest("complete", "total_files").alias("complete"),
                F.max(F.when(kind == "error", seq)).alias("failed")))


def _merged(folds: DataFrame) -> DataFrame:
    return folds.groupBy("scan_id", "file").agg(*[keep(c).alias(c) for c, keep in _FOLD.items()])


def _state(folded: DataFrame) -> DataFrame:
    """Latest status of folded files: scanning, clean, done or skip.

    Results and skips before the first start of a file are ignored; a new start
    resets what was known.
    """
    fresh_done = F.coalesce(F.col("done.seq") > F.col("start.seq"), F.lit(False))
    skipped = F.coalesce((F.col("skip") > F.col("start.seq"))
                         & (F.col("skip") > F.coalesce(F.col("done.seq"), F.lit(-1))), F.lit(False))
    found = F.when(fresh_done, F.col("done.findings")).otherwise(0)
    return folded.select(
        "scan_id", "file",
        F.col("start.language").alias("language"),
        F.when(F.col("first_start").isNull(), None).when(skipped, "skip").when(~fresh_done, "scanning")
        .when(found > 0, "done").otherwise("clean").alias("status"),
        found.cast("bigint").alias("findings"),
        F.when(fresh_done, F.col("done.severity")).alias("severity"),
        F.greatest(F.col("start.seq"), F.col("done.seq"), F.col("skip")).alias("last_seq"),
        # Where the progress bar stood at this file's start, or at completion.
        F.when(F.col("complete").isNotNull(), F.struct(
            F.col("complete.seq").alias("seq"), F.col("complete.total_files").alias("done"),
            F.col("complete.total_files").alias("total")))
        .when(F.col("start").isNotNull(), F.struct(
            F.col("start.seq").alias("seq"), F.col("start.index").alias("done"), F.col("start.total").alias("total")))
        .alias("bar"))


def file_states(events: DataFrame) -> DataFrame:
    """State per (scan, file) with the bar position; what a stream stores."""
    return _state(_fold(events)).where("bar is not null")


def file_progress(events: DataFrame) -> DataFrame:
    """Latest status per (scan, file)."""
    return file_states(events).where("status is not null").drop("bar")


def scan_totals(states: DataFrame) -> DataFrame:
    """Per scan, the latest bar percentage and counts over the latest file states.

    Files listed include skipped ones, files reported do not.
    """
    status = F.col("status")
    return states.groupBy("scan_id").agg(
        F.max("bar").alias("bar"),
        F.count(status).alias("files_listed"),
        F.count_if(status != "skip").alias("files_reported"),
        F.count_if(status.isin("clean", "done", "skip")).alias("files_finished"),
        F.coalesce(F.sum(F.when(status != "skip", F.col("findings"))), F.lit(0).cast("bigint"))
        .alias("findings_so_far"),
    ).select("scan_id", progress_pct(F.col("bar.done"), F.col("bar.total")).alias("pct"),
             "files_listed", "files_reported", "files_finished", "findings_so_far")


def scan_progress(events: DataFrame) -> DataFrame:
    """Totals of every scan that moved its bar; two aggregations over one read of the events."""
    return scan_totals(file_states(events))


def completion_counts(events: DataFrame) -> DataFrame:
    """Severity counts a scan reported on completion (missing kinds as zero)."""
    last = events.where("type = 'complete'").groupBy("scan_id").agg(
        F.max(F.struct("seq", "total_files", "total_findings")).alias("c"),
        F.max_by("severity_counts", "seq").alias("counts"))

    def count_of(name):
        return F.coalesce(F.try_element_at("counts", F.lit(name)), F.lit(0).cast("bigint")).alias(name.lower())
    return last.select("scan_id", "c.total_files", "c.total_findings",
                       *[count_of(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")])


def scan_status(events: DataFrame) -> DataFrame:
    """Per scan: running, complete or error, with the text of the last terminal event."""
    ends = F.col("type").isin("complete", "error")
    folded = events.groupBy("scan_id").agg(
        F.max(F.when(ends, F.struct("seq", "type", "text"))).alias("last"),
        F.max("seq").alias("last_seq"))
    return folded.select(
        "scan_id", F.coalesce("last.type", F.lit("running")).alias("status"),
        F.when(F.col("last.type") == "error", F.col("last.text")).alias("message"), "last_seq")


def start_file_progress(events: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the folds of a stream of events current; the stream itself holds no state.

    Each micro-batch folds its own events and merges them into `out/open`, the folds of scans that
    have not ended, so a batch costs what it brings and what is open.  A scan that completes or fails
    leaves: its folds go to `out/ended` once.  Events that come after their scan ended are folded
    beside it, and readers merge again, so the order of arrival never matters.  A batch replaces its
    own folders when it is retried and reads those of earlier batches only; of `open` the last two are kept.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _batches(spark, f"{out}/open") if b < batch_id]
        ended_before = [b for b in _batches(spark, f"{out}/ended") if b < batch_id]
        _merged(_folds(spark, f"{out}/open", before[-1:]).unionByName(_fold(batch))).write.mode("overwrite").parquet(f"{out}/batch")
        folds = spark.read.schema(FOLD_SCHEMA).parquet(f"{out}/batch")
        ending = folds.where(_ENDS).select("scan_id").unionByName(
            _folds(spark, f"{out}/ended", ended_before).where(_ENDS).select("scan_id")
            .join(folds.select("scan_id").distinct(), "scan_id", "left_semi")).distinct()
        leaving = folds.join(ending, "scan_id", "left_semi")
        if not leaving.isEmpty():
            leaving.write.mode("overwrite").parquet(f"{out}/ended/batch={batch_id}")
        folds.join(ending, "scan_id", "left_anti").write.mode("overwrite").parquet(f"{out}/open/batch={batch_id}")
        for old in before[:-1]:
            _path(spark, f"{out}/open/batch={old}", delete=True)

    return (events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store).trigger(**trigger).start())


_ENDS = "file is null and (complete is not null or failed is not null)"


def _path(spark: SparkSession, uri: str, delete: bool = False) -> list[str]:
    """Names in a folder of the store, whatever file system holds it; deletes a folder that was replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        system.delete(path, True)
        return []
    return [entry.getPath().getName() for entry in system.listStatus(path)] if system.exists(path) else []


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Batches that were written whole, in order."""
    numbers = [int(name[6:]) for name in _path(spark, folder) if name.startswith("batch=")]
    return sorted(n for n in numbers if "_SUCCESS" in _path(spark, f"{folder}/batch={n}"))


def _folds(spark: SparkSession, folder: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], FOLD_SCHEMA)
    return spark.read.schema(FOLD_SCHEMA).parquet(*[f"{folder}/batch={b}" for b in batches])


def open_file_states(spark: SparkSession, out: str) -> DataFrame:
    """States of the scans that still run: what the last batch left open, whatever came before."""
    return _state(_folds(spark, f"{out}/open", _batches(spark, f"{out}/open")[-1:])).where("bar is not null")


def current_file_states(spark: SparkSession, out: str) -> DataFrame:
    """State per (scan, file) of all scans, ended ones included.

    `scan_totals` of it gives the scans' progress.
    """
    ended = _folds(spark, f"{out}/ended", _batches(spark, f"{out}/ended"))
    last = _folds(spark, f"{out}/open", _batches(spark, f"{out}/open")[-1:])
    return _state(_merged(ended.unionByName(last))).where("bar is not null")


def current_file_progress(spark: SparkSession, out: str) -> DataFrame:
    return current_file_states(spark, out).where("status is not null").drop("bar")
