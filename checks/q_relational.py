"""Joins, aggregates, windows and unions over files and findings."""

from pyspark.sql import functions as F

from siftwork import fixed
from siftwork.functions import labels
from siftwork.operators import merge, ordering, rollups, skew
from siftwork.plans import reports
from siftwork.sources import cache as cache_ops, inputs

from . import registry as r
from .registry import query
from .views import corpus, load_tables, view


def typed(spark, d):
    return merge.complete_findings(view(spark, d, "findings"))


def files(spark, d):
    return view(spark, d, "files")


def rolled(spark, d):
    return rollups.file_rollup(files(spark, d), typed(spark, d))


FINDING_COLS = ("ordinal, file_path, severity, CAST(severity_score AS INTEGER) AS severity_score, type, description, "
                "impact, fix, line_number, owasp, confidence, source")
OUT = [c.split(" AS ")[-1].strip() for c in FINDING_COLS.replace("CAST(severity_score AS INTEGER) AS ", "").split(",")]

FIRST = f"""{r.TYPED},
firsts AS (SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY file_path, type, line_number ORDER BY ordinal) = 1)"""
MERGED = f"""{r.TYPED},
statics AS (SELECT * FROM typed WHERE source = 'static'
            QUALIFY row_number() OVER (PARTITION BY file_path, type, line_number ORDER BY ordinal) = 1),
merged AS (SELECT * FROM statics UNION ALL
           SELECT * FROM typed l WHERE source = 'llm' AND NOT EXISTS (
             SELECT 1 FROM statics s WHERE s.file_path = l.file_path
               AND {r.type_key('s.type')} = {r.type_key('l.type')}))"""
ROLLED = f"""{r.TYPED},
rolled AS (SELECT f.file_path, f.language, f.file_hash, f.from_cache, f.error,
             {', '.join(f"CAST(count(*) FILTER (WHERE t.severity = '{s}') AS BIGINT) AS {s.lower()}" for s in fixed.SEVERITY_SCORES)},
             CAST(coalesce(sum(t.severity_score), 0) AS BIGINT) AS risk_score,
             CAST(count(t.ordinal) AS BIGINT) AS findings,
             {r.severity_of('max(t.severity_score)')} AS worst_severity
           FROM files f LEFT JOIN typed t ON t.file_path = f.file_path
           GROUP BY ALL)"""
SUMS = ", ".join(f"CAST(coalesce(sum({s.lower()}), 0) AS BIGINT) AS {s.lower()}" for s in fixed.SEVERITY_SCORES)
RUN = f"""SELECT CAST(count(*) AS BIGINT) AS files_scanned,
  CAST(coalesce(sum(findings), 0) AS BIGINT) AS total_vulnerabilities,
  CAST(count(*) FILTER (WHERE from_cache) AS BIGINT) AS cache_hits, {SUMS},
  (SELECT file_path FROM rolled ORDER BY risk_score DESC, file_path LIMIT 1) AS riskiest_file,
  coalesce(bool_or(critical + high > 0), false) AS breached
FROM rolled"""


def merged(spark, d):
    every = typed(spark, d)
    statics = skew.first_wins(every.where("source = 'static'"), ["file_path", "type", "line_number"], "ordinal")
    return merge.merge_findings(statics, every.where("source = 'llm'"), "file_path")


@query("w1_first_wins", f"WITH {FIRST} SELECT {FINDING_COLS} FROM firsts")
def w1(spark, d):
    return skew.first_wins(typed(spark, d), ["file_path", "type", "line_number"], "ordinal").select(*OUT)


@query("j1_uncovered", f"WITH {MERGED} SELECT {FINDING_COLS} FROM merged WHERE source = 'llm'")
def j1(spark, d):
    every = typed(spark, d)
    statics = skew.first_wins(every.where("source = 'static'"), ["file_path", "type", "line_number"], "ordinal")
    return merge.uncovered(every.where("source = 'llm'"), statics, "file_path").select(*OUT)


@query("u2_merge", f"WITH {MERGED} SELECT {FINDING_COLS} FROM merged")
def u2(spark, d):
    return merged(spark, d).select(*OUT)


@query("p3_min_severity", f"WITH {MERGED} SELECT {FINDING_COLS} FROM merged WHERE severity_score >= 2")
def p3(spark, d):
    return merge.at_least(merged(spark, d), "MEDIUM").select(*OUT)


@query("w2_rank_in_file", f"""WITH {r.TYPED}
SELECT {FINDING_COLS}, row_number() OVER (PARTITION BY file_path
  ORDER BY severity_score DESC, confidence DESC, ordinal) AS rank_in_file FROM typed""")
def w2(spark, d):
    return ordering.rank_in_file(typed(spark, d), "file_path").select(*OUT, "rank_in_file")


@query("w2_sorted", f"""WITH {r.TYPED}
SELECT {FINDING_COLS}, row_number() OVER (ORDER BY file_path, severity_score DESC, confidence DESC, ordinal) AS position FROM typed""")
def w2_sorted(spark, d):
    return ordering.with_position(ordering.sort_findings(typed(spark, d), "file_path")).select(*OUT, "position")


@query("j7_file_rollup", f"WITH {ROLLED} SELECT * FROM rolled")
def j7(spark, d):
    return rolled(spark, d)


@query("a1_severity_counts", f"WITH {r.TYPED} SELECT file_path, {r.COUNTS} FROM typed GROUP BY file_path")
def a1(spark, d):
    return typed(spark, d).groupBy("file_path").agg(*rollups.severity_count_columns())


@query("a2_risk_score", f"WITH {ROLLED} SELECT file_path, risk_score FROM rolled")
def a2(spark, d):
    return rolled(spark, d).select("file_path", "risk_score")


@query("a3_run_severity_counts", f"WITH {r.TYPED} SELECT {r.COUNTS} FROM typed")
def a3(spark, d):
    return rollups.run_severity_counts(typed(spark, d))


@query("a4_run_rollup", f"WITH {ROLLED} {RUN}")
def a4(spark, d):
    return rollups.run_rollup(rolled(spark, d))


@query("a5_riskiest_file", f"WITH {ROLLED} SELECT file_path, risk_score FROM rolled ORDER BY risk_score DESC, file_path LIMIT 1")
def a5(spark, d):
    return rollups.riskiest_file(rolled(spark, d)).select("file_path", "risk_score")


@query("a6_gate", f"WITH {r.TYPED} SELECT coalesce(bool_or(severity_score >= 4), false) AS breached FROM typed")
def a6(spark, d):
    return rollups.gate(typed(spark, d), "CRITICAL")


@query("a7_worst_severity", f"""WITH {r.TYPED}
SELECT file_path, {r.severity_of('max(severity_score)')} AS worst_severity FROM typed GROUP BY file_path""")
def a7(spark, d):
    return rollups.worst_severity(typed(spark, d), "file_path")


@query("a8_cache_stats", """
SELECT CAST(count(*) AS BIGINT) AS cached_files, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events""")
def a8(spark, d):
    load_tables(spark, d)
    entries = spark.table("events").select(F.col("ts").alias("scanned_at"))
    stats = cache_ops.cache_stats(entries)
    return stats.select("cached_files", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest", "newest")])


RULES = f"""rules AS (
  SELECT rule_id, replace(type, ' ', '') AS name, type AS short_description, description AS full_description,
         'Fix: ' || fix AS help_text, '**Fix:** `' || fix || '`' AS help_markdown,
         {r.sql_case('severity', fixed.SARIF_LEVELS)} AS level,
         CASE WHEN confidence >= 0.9::DOUBLE THEN 'high' ELSE 'medium' END AS "precision",
         {r.sql_case('severity', fixed.SARIF_SECURITY_SEVERITY)} AS security_severity,
         'security,' || source AS tags
  FROM (SELECT *, {r.rule_id('type')} AS rule_id FROM typed t
        WHERE file_path NOT IN (SELECT file_path FROM files WHERE coalesce(error, '') <> '')) x
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY file_path, severity_score DESC, confidence DESC, ordinal) = 1)"""
RESULTS = f"""results AS (
  SELECT {r.rule_id('type')} AS rule_id, {r.sql_case('severity', fixed.SARIF_LEVELS)} AS level,
         description || ' — ' || impact AS message, file_path AS uri,
         CASE WHEN coalesce(line_number, 0) = 0 THEN 1 ELSE line_number END AS start_line,
         coalesce(owasp, '') AS owasp, confidence, source, ordinal, CAST(severity_score AS INTEGER) AS severity_score
  FROM typed WHERE file_path NOT IN (SELECT file_path FROM files WHERE coalesce(error, '') <> ''))"""


def _reportable(spark, d):
    return reports.reportable(typed(spark, d), files(spark, d))


@query("a9_sarif_rules", f"WITH {r.TYPED}, {RULES} SELECT * FROM rules")
def a9(spark, d):
    return reports.sarif_rules(_reportable(spark, d)).withColumn("tags", F.array_join("tags", ","))


@query("p5_sarif_results", f"WITH {r.TYPED}, {RESULTS} SELECT * FROM results")
def p5(spark, d):
    return reports.sarif_results(_reportable(spark, d))


@query("p8_reportable", f"""WITH {r.TYPED} SELECT {FINDING_COLS} FROM typed
WHERE file_path NOT IN (SELECT file_path FROM files WHERE coalesce(error, '') <> '')""")
def p8(spark, d):
    return _reportable(spark, d).select(*OUT)


@query("j8_results_with_rules", f"""WITH {r.TYPED}, {RULES}, {RESULTS}
SELECT uri, ordinal, rule_id, name AS rule_name, "precision", security_severity, message
FROM results JOIN rules USING (rule_id)""")
def j8(spark, d):
    good = _reportable(spark, d)
    joined = reports.results_with_rules(reports.sarif_results(good), reports.sarif_rules(good))
    return joined.select("uri", "ordinal", "rule_id", "rule_name", "precision", "security_severity", "message")


VULN_STRUCT = ("struct_pack(severity := severity, type := type, description := description, impact := impact, "
               "fix := fix, line_number := line_number, owasp := owasp, confidence := confidence, source := source)")
VULN_JSON = f"to_json({VULN_STRUCT})"
LISTS = """lists AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY severity_score DESC, confidence DESC, ordinal) AS rank
  FROM typed)"""


@query("a10_findings_list", f"WITH {r.TYPED}, {LISTS} SELECT file_path, rank AS rank_in_file, CAST({VULN_JSON} AS VARCHAR) AS vulnerability FROM lists")
def a10(spark, d):
    lists = reports.findings_list(typed(spark, d), "file_path")
    return lists.withColumn("vulnerability", F.to_json("vulnerability", reports.KEEP_NULLS))


SEV_JSON = "struct_pack(" + ", ".join(f'"{s}" := {s.lower()}' for s in fixed.SEVERITY_SCORES) + ")"


@query("snk1_json_report", f"""WITH {ROLLED}, {LISTS}
SELECT file_path, 0::BIGINT AS rank, CAST(to_json(struct_pack(file_path := file_path, language := language,
  file_hash := left(file_hash, 12) || '…', from_cache := from_cache, risk_score := risk_score,
  severity_counts := {SEV_JSON}, error := error)) AS VARCHAR) AS document FROM rolled
UNION ALL SELECT file_path, rank, CAST(to_json(struct_pack(file_path := file_path, rank := rank, vulnerability := {VULN_STRUCT})) AS VARCHAR)
FROM lists""")
def snk1(spark, d):
    return reports.json_report(rolled(spark, d), typed(spark, d))


@query("snk1_json_summary", f"""WITH {ROLLED}, run AS ({RUN})
SELECT CAST(to_json(struct_pack(files_scanned := files_scanned, total_vulnerabilities := total_vulnerabilities,
  severity_counts := {SEV_JSON}, cache_hits := cache_hits)) AS VARCHAR) AS summary FROM run""")
def snk1_summary(spark, d):
    return reports.json_summary(rolled(spark, d))


@query("n4_finding_json", f"WITH {r.TYPED} SELECT file_path, ordinal, CAST({VULN_JSON} AS VARCHAR) AS finding FROM typed")
def n4(spark, d):
    return cache_ops.findings_to_json(typed(spark, d), "file_path")


@query("a11_distinct_contents", """
SELECT sha256(content) AS file_hash, min(file_path) AS file_path, CAST(count(*) AS BIGINT) AS copies
FROM corpus GROUP BY content""")
def a11(spark, d):
    return rollups.distinct_contents(inputs.with_identity(corpus(spark, d).withColumn("error", F.lit(None).cast("string"))))


@query("w3_result_cards", f"""WITH {ROLLED}
SELECT file_path, status, severity, CAST({r.sql_case("coalesce(severity, 'INFO')", {s: i for i, s in enumerate(fixed.SEVERITY_SCORES)})} AS INTEGER) AS severity_rank
FROM (SELECT file_path, worst_severity AS severity,
        CASE WHEN error IS NOT NULL THEN 'skip' WHEN findings > 0 THEN 'done' ELSE 'clean' END AS status FROM rolled) x
WHERE status <> 'skip'""")
def w3(spark, d):
    cards = rolled(spark, d).select(
        "file_path",
        F.when(F.col("error").isNotNull(), "skip").when(F.col("findings") > 0, "done").otherwise("clean").alias("status"),
        F.col("worst_severity").alias("severity"))
    return rollups.result_cards(cards)


@query("p10_file_status", f"""WITH {ROLLED}
SELECT file_path,
  CASE WHEN coalesce(error, '') <> '' THEN 'error' WHEN findings > 0 THEN 'findings' ELSE 'clean' END AS status,
  CASE WHEN coalesce(error, '') <> '' THEN error
       WHEN findings > 0 THEN worst_severity || ' · ' || CASE WHEN from_cache THEN 'cached' ELSE findings || ' finding(s)' END
       ELSE 'clean (' || CASE WHEN from_cache THEN 'cached' ELSE findings || ' finding(s)' END || ')' END AS detail
FROM rolled""")
def p10(spark, d):
    return rollups.file_status(rolled(spark, d))
