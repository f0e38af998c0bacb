"""Event folds (as tables and as streams) and incremental scans."""

from pyspark.sql import functions as F

from siftwork.plans.scan import CacheTables  # noqa: F401  (re-exported for tests)
from siftwork.session import fresh_path
from siftwork.sources.cache import FindingCache
from siftwork.streaming import progress
from siftwork.streaming.scan_stream import latest_scan_results, start_scan_stream

from . import registry as r
from .q_detection import PATTERNS, _secrets_cte
from .q_relational import ROLLED, rolled, typed
from .q_sources import export_tree
from .registry import query
from .views import corpus, load_tables, view


PLAIN_FIELDS = ["scan_id", "seq", "type", "level", "text", "detail", "file", "language", "total", "findings", "severity", "title",
                "repo", "pr_num", "branch", "author", "avatar", "pr_url", "total_files", "scannable_files", "sha", "total_findings"]


def event_lines(spark, d):
    """The event view as JSON lines with all fields of every kind of event."""
    events = view(spark, d, "scan_events").select(
        *PLAIN_FIELDS, F.col("idx").alias("index"),
        F.when(F.col("type") == "complete", F.create_map(F.lit("HIGH"), F.col("n_high"), F.lit("LOW"), F.col("n_low"))).alias("severity_counts"),
        F.when(F.col("findings") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("findings")), lambda i: F.struct(
            F.lit("HIGH").alias("severity"), F.lit("SQL Injection").alias("type"), F.concat(F.lit("d"), i).alias("description"),
            i.alias("line_number"), F.lit(0.9).alias("confidence")))).alias("vulns"))
    return events.select(F.to_json(F.struct("*")).alias("value"))


def events(spark, d):
    return progress.parse_events(event_lines(spark, d))


@query("t3_parse_events", f"""
SELECT {', '.join(c for c in PLAIN_FIELDS if c not in ('total', 'findings'))}, CAST(idx AS BIGINT) AS index, CAST(total AS BIGINT) AS total,
       CAST(findings AS BIGINT) AS findings, n_high, n_low, CAST(CASE WHEN findings > 0 THEN findings END AS BIGINT) AS n_vulns
FROM scan_events""")
def t3(spark, d):
    count = lambda name: F.try_element_at("severity_counts", F.lit(name))
    return events(spark, d).select(*PLAIN_FIELDS, "index", count("HIGH").alias("n_high"), count("LOW").alias("n_low"),
                                   F.when(F.col("vulns").isNotNull(), F.size("vulns")).cast("bigint").alias("n_vulns"))


@query("t3_result_events", f"""
WITH {ROLLED},
placed AS (SELECT *, row_number() OVER (ORDER BY file_path) - 1 AS idx, count(*) OVER () AS total FROM rolled),
parts AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil(findings / {progress.EVENT_FINDINGS}.0) AS BIGINT)))) AS part
          FROM placed WHERE coalesce(error, '') = '')
SELECT idx << {progress.SEQ_BITS} AS seq, 'file_start' AS type, file_path AS file, idx AS index, total, NULL::BIGINT AS findings,
       NULL AS severity, NULL::BIGINT AS n_vulns, NULL::BIGINT AS total_files, NULL::BIGINT AS total_findings, NULL::BIGINT AS n_high FROM placed
UNION ALL SELECT (idx << {progress.SEQ_BITS}) + 2, 'file_skip', file_path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM placed WHERE coalesce(error, '') <> ''
UNION ALL SELECT (idx << {progress.SEQ_BITS}) + 2 + part, 'file_done', file_path, NULL, NULL, findings, worst_severity,
       least({progress.EVENT_FINDINGS}, findings - part * {progress.EVENT_FINDINGS}), NULL, NULL, NULL FROM parts
UNION ALL SELECT (SELECT count(*) FROM placed) << {progress.SEQ_BITS}, 'complete', NULL, NULL, NULL, NULL, NULL, NULL,
       count(*), CAST(coalesce(sum(findings), 0) AS BIGINT), CAST(coalesce(sum(high), 0) AS BIGINT) FROM placed WHERE coalesce(error, '') = ''""")
def t3_results(spark, d):
    """A finished run told as events, through their JSON lines and back."""
    told = progress.scan_result_events(7, rolled(spark, d), typed(spark, d))
    told = progress.parse_events(told.select(F.to_json(F.struct("*")).alias("value")))
    return told.select("seq", "type", "file", "index", "total", "findings", "severity",
                       F.when(F.col("vulns").isNotNull(), F.size("vulns")).cast("bigint").alias("n_vulns"), "total_files",
                       "total_findings", F.try_element_at("severity_counts", F.lit("HIGH")).alias("n_high"))


@query("t3_event_findings", """
SELECT scan_id, file, seq, CAST(i - 1 AS BIGINT) AS ordinal, 'HIGH' AS severity, 'SQL Injection' AS type, 'd' || i AS description,
       CAST(i AS BIGINT) AS line_number, 0.9::DOUBLE AS confidence, 'llm' AS source
FROM (SELECT *, unnest(range(1, findings + 1)) AS i FROM scan_events WHERE type = 'file_done' AND findings > 0) e""")
def t3_findings(spark, d):
    found = progress.event_findings(events(spark, d))
    return found.select("scan_id", "file", "seq", "ordinal", "severity", "type", "description", "line_number", "confidence", "source")


# The oracle replays events in order with windows, unlike the order-free fold.
_STATUS = """
started AS (SELECT *, min(CASE WHEN type = 'file_start' THEN seq END) OVER (PARTITION BY scan_id, file) AS first_start
            FROM scan_events WHERE type IN ('file_start', 'file_done', 'file_skip')),
effective AS (SELECT * FROM started WHERE seq >= first_start),
latest AS (SELECT * FROM effective QUALIFY row_number() OVER (PARTITION BY scan_id, file ORDER BY seq DESC) = 1),
known AS (SELECT * FROM effective WHERE type <> 'file_skip'
          QUALIFY row_number() OVER (PARTITION BY scan_id, file ORDER BY seq DESC) = 1),
progress AS (
  SELECT l.scan_id, l.file, 'Python' AS language,
    CASE WHEN l.type = 'file_start' THEN 'scanning' WHEN l.type = 'file_skip' THEN 'skip'
         WHEN l.findings > 0 THEN 'done' ELSE 'clean' END AS status,
    CAST(CASE WHEN k.type = 'file_done' THEN k.findings ELSE 0 END AS BIGINT) AS findings,
    CASE WHEN k.type = 'file_done' AND k.findings > 0 THEN 'HIGH' END AS severity,
    l.seq AS last_seq
  FROM latest l JOIN known k USING (scan_id, file))"""


@query("t4_file_progress", f"WITH {_STATUS} SELECT scan_id, file, language, status, findings, severity FROM progress")
def t4(spark, d):
    return progress.file_progress(events(spark, d)).drop("last_seq")


@query("t4_file_progress_stream", f"WITH {_STATUS} SELECT scan_id, file, language, status, findings, severity FROM progress")
def t4_stream(spark, d):
    return progress.current_file_progress(spark, _streamed(spark, d)).drop("last_seq")


def _streamed(spark, d):
    """The folder of a stream over files of event lines, several micro-batches long."""
    folder = fresh_path(spark, "events")
    event_lines(spark, d).repartition(4).write.text(f"{folder}/in")
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    running = progress.start_file_progress(progress.parse_events(lines), f"{folder}/out", f"{folder}/ckpt", availableNow=True)
    running.awaitTermination()
    return f"{folder}/out"


_PROGRESS = f"""WITH {_STATUS},
bar AS (SELECT scan_id, CASE WHEN type = 'complete' THEN CASE WHEN total_files > 0 THEN 100 ELSE 0 END
                             WHEN total > 0 THEN CAST(round(100.0 * idx / total) AS BIGINT) ELSE 0 END AS pct
        FROM scan_events WHERE type IN ('file_start', 'complete') QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY seq DESC) = 1)
SELECT b.scan_id, CAST(any_value(b.pct) AS BIGINT) AS pct, CAST(count(p.file) AS BIGINT) AS files_listed,
  CAST(count(*) FILTER (WHERE status <> 'skip') AS BIGINT) AS files_reported,
  CAST(count(*) FILTER (WHERE status <> 'scanning') AS BIGINT) AS files_finished,
  CAST(coalesce(sum(CASE WHEN status <> 'skip' THEN findings END), 0) AS BIGINT) AS findings_so_far
FROM bar b LEFT JOIN progress p USING (scan_id) GROUP BY b.scan_id"""


@query("t5_scan_progress", _PROGRESS)
def t5(spark, d):
    return progress.scan_progress(events(spark, d))


@query("t5_scan_progress_stream", _PROGRESS)
def t5_stream(spark, d):
    """Totals from the store of a stream; scans end in one batch and get late results in others."""
    return progress.scan_totals(progress.current_file_states(spark, _streamed(spark, d)))


@query("t5_completion_counts", """
SELECT scan_id, arg_max(total_files, seq) AS total_files, arg_max(total_findings, seq) AS total_findings, 0::BIGINT AS critical,
       arg_max(n_high, seq) AS high, 0::BIGINT AS medium, arg_max(n_low, seq) AS low, 0::BIGINT AS info
FROM scan_events WHERE type = 'complete' GROUP BY scan_id""")
def t5_completion(spark, d):
    return progress.completion_counts(events(spark, d))


@query("t6_scan_status", """
SELECT user_id AS scan_id, coalesce(arg_max(kind, event_id), 'running') AS status,
       CASE WHEN arg_max(kind, event_id) = 'error' THEN arg_max('failed at ' || CAST(event_id AS VARCHAR), event_id) FILTER (WHERE kind IS NOT NULL) END AS message,
       max(event_id) AS last_seq
FROM (SELECT *, CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'error'
                     WHEN event_type = 'signup' AND event_id % 9 = 1 THEN 'complete' END AS kind FROM events) e
GROUP BY user_id""")
def t6(spark, d):
    load_tables(spark, d)
    raw = spark.table("events").select(
        F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "error")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 9 == 1), "complete").otherwise("log").alias("type"),
        F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("text"))
    return progress.scan_status(progress.parse_events(raw.select(F.to_json(F.struct("*")).alias("value"))))


_FOUND = _secrets_cte("corpus", "file_path", "content",
                      where=r.scannable("file_path") + " AND NOT contains(file_path, '/node_modules/')")


@query("t1_scan_stream", f"WITH {_FOUND} SELECT file_path, type, line_number, severity FROM secret_findings")
def t1(spark, d):
    folder, root = fresh_path(spark, "scan"), export_tree(spark, corpus(spark, d))
    start_scan_stream(spark, [root], f"{folder}/out", f"{folder}/ckpt", gate="none", patterns=PATTERNS,
                      settle_seconds=0, availableNow=True).awaitTermination()
    _, findings = latest_scan_results(spark, f"{folder}/out")
    return findings.select(F.replace("file_path", F.lit(f"{root}/"), F.lit("")).alias("file_path"),
                           "type", "line_number", "severity")


@query("t2_scan_stream_cache", f"""
SELECT file_path, {r.language('file_path')} AS language, content IN (SELECT content FROM scan_cache) AS from_cache
FROM corpus WHERE {r.scannable('file_path')} AND NOT contains(file_path, '/node_modules/')""")
def t2(spark, d):
    folder, root = fresh_path(spark, "scan"), export_tree(spark, corpus(spark, d))
    store = FindingCache(spark, f"{folder}/cache", digits=1)
    known = view(spark, d, "scan_cache").select(
        F.sha2("content", 256).alias("file_hash"), F.lit("seen before").alias("file_path"),
        F.lit("Python").alias("language"), F.current_timestamp().alias("scanned_at"))
    nothing = spark.createDataFrame([], store.read().findings.schema)
    store.put(known, nothing)
    start_scan_stream(spark, [root], f"{folder}/out", f"{folder}/ckpt", cache=store, gate="none", patterns=PATTERNS,
                      settle_seconds=0, availableNow=True).awaitTermination()
    files, _ = latest_scan_results(spark, f"{folder}/out")
    return files.select(F.replace("file_path", F.lit(f"{root}/"), F.lit("")).alias("file_path"), "language", "from_cache")
