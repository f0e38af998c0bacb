"""Sources, sinks, cache and change listings."""

import os
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftwork.functions.paths import detect_language
from siftwork.functions.text import split_lines
from siftwork.operators import rollups
from siftwork.operators.ordering import with_position
from siftwork.operators.skew import spread_join
from siftwork.plans import changes, reports
from siftwork.session import fresh_path
from siftwork.sources import cache as cache_ops, inputs, tree
from siftwork.sources.cache import FindingCache

from . import registry as r
from .q_relational import FINDING_COLS, OUT, RESULTS, RULES, typed
from .registry import query
from .views import corpus, view


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _write_files(root):
    def run(batches):
        for batch in batches:
            for path, text in zip(batch["file_path"], batch["text"]):
                target = f"{root}/{path}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as handle:
                    handle.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})
    return run


def export_tree(spark, files) -> str:
    """Write files of a table below a new folder, from the executors."""
    root = fresh_path(spark, "tree")
    os.makedirs(root, exist_ok=True)
    files.select("file_path", "text").mapInPandas(_write_files(root), "n bigint").agg(F.sum("n")).collect()
    return root


_IN_SCOPE = f"{r.scannable('file_path')} AND NOT contains(file_path, '/node_modules/')"


@query("src1_source_tree", f"""
SELECT file_path, {r.language('file_path')} AS language, sha256(content) AS file_hash FROM corpus WHERE {_IN_SCOPE}""")
def src1(spark, d):
    root = export_tree(spark, corpus(spark, d))
    files = inputs.with_identity(inputs.decode_text(tree.read_source_tree(spark, [root])))
    return files.select(F.col("relative_path").alias("file_path"), "language", "file_hash")


@query("src1_source_pieces", f"""
SELECT file_path, sha256(content) AS file_hash, octet_length(encode(content))::BIGINT AS text_bytes,
       (len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) OR content = '' THEN 1 ELSE 0 END)::BIGINT AS n_lines
FROM corpus WHERE {_IN_SCOPE}""")
def src1_pieces(spark, d):
    """Files read 512 bytes at a time: what the pieces add up to."""
    root = export_tree(spark, corpus(spark, d))
    pieces = tree.read_pieces(spark, [root], piece_bytes=512)
    lines = F.size(split_lines(F.col("text")))
    return pieces.groupBy(F.col("relative_path").alias("file_path")).agg(
        F.max("file_hash").alias("file_hash"), F.sum(F.octet_length("text")).cast("long").alias("text_bytes"),
        F.max(F.when(F.col("last"), F.col("first_line") + lines - 1)).alias("n_lines"))


@query("src2_source_files", """
SELECT file_path, CASE WHEN file_id % 10 = 9 THEN '' ELSE sha256(content) END AS file_hash, file_id % 10 = 9 AS failed
FROM corpus""")
def src2(spark, d):
    files = corpus(spark, d)
    root = export_tree(spark, files.where("file_id % 10 <> 9"))
    named = files.select(F.concat(F.lit(f"{root}/"), "file_path").alias("file_path"))
    found = inputs.with_identity(inputs.decode_text(tree.read_source_files(spark, named)))
    return found.select(F.replace("file_path", F.lit(f"{root}/"), F.lit("")).alias("file_path"), "file_hash",
                        F.col("error").isNotNull().alias("failed"))


@query("u3_dirs_and_files", """
SELECT file_path, sha256(content) AS file_hash FROM corpus WHERE ({}) OR file_path LIKE '%.md'""".format(_IN_SCOPE))
def u3(spark, d):
    files = corpus(spark, d)
    root = export_tree(spark, files)
    named = files.where("file_path like '%.md' or file_id % 2 = 0 and file_path not like '%node_modules%'").select(
        F.concat(F.lit(f"{root}/"), "file_path").alias("file_path"))
    found = inputs.with_identity(inputs.decode_text(tree.read_sources(spark, [root], named)))
    return found.select(F.replace("file_path", F.lit(f"{root}/"), F.lit("")).alias("file_path"), "file_hash")


@query("src3_decode_text", """
SELECT file_id, sha256(replace(content, chr(10), chr(10) || chr(10)) || chr(65533) || 'end') AS file_hash FROM corpus""")
def src3(spark, d):
    # Line ends become CRLF followed by CR, and a stray byte is added before decoding.
    raw = corpus(spark, d).select("file_id", F.concat(
        F.regexp_replace("text", "\n", "\r\n\r").cast("binary"), F.unhex(F.lit("FF")), F.lit("end").cast("binary"))
        .alias("content"))
    return inputs.decode_text(raw).select("file_id", F.sha2("text", 256).alias("file_hash"))


@query("src4_read_errors", """
SELECT file_path, CASE WHEN file_id % 11 = 0 THEN 'file not found or not readable' END AS error FROM corpus""")
def src4(spark, d):
    files = corpus(spark, d)
    return inputs.with_read_errors(files, files.where("file_id % 11 <> 0").select("file_path", "text")).select(
        "file_path", "error")


@query("src5_changed_only", f"""
SELECT file_path, sha256(content) AS file_hash FROM corpus
WHERE {r.scannable('file_path')} AND file_path IN (SELECT file_path FROM changed)""")
def src5(spark, d):
    changed = view(spark, d, "changed")
    return inputs.only_changed(corpus(spark, d), changed).select("file_path", F.sha2("text", 256).alias("file_hash"))


@query("j3_changed_semi", f"""
SELECT file_id, file_path FROM corpus
WHERE {r.scannable('file_path')} AND file_path IN (SELECT file_path FROM changed)""")
def j3(spark, d):
    return inputs.only_changed(view(spark, d, "corpus"), view(spark, d, "changed")).select("file_id", "file_path")


@query("p7_scannable_changes", f"""
SELECT file_path, status FROM changed WHERE {r.scannable('file_path')} AND status IS DISTINCT FROM 'removed'""")
def p7(spark, d):
    return inputs.scannable_changes(view(spark, d, "changed"))


@query("src6_pr_listing", f"""
SELECT file_path, status FROM changed WHERE {r.scannable('file_path')} AND status IS DISTINCT FROM 'removed'""")
def src6(spark, d):
    path = fresh_path(spark, "listing")
    view(spark, d, "changed").withColumnRenamed("file_path", "filename").write.json(path)
    return inputs.read_pr_listing(spark, path, lines=True)


@query("src7_payloads", """
SELECT file_id, sha256(CASE WHEN file_id % 9 IN (0, 1) THEN '' ELSE content END) AS text_hash FROM corpus""")
def src7(spark, d):
    packed = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    payloads = corpus(spark, d).select(
        "file_id",
        F.when(F.col("file_id") % 9 == 0, "none").otherwise("base64").alias("encoding"),
        F.when(F.col("file_id") % 9 == 1, "A").otherwise(packed).alias("content"))
    return inputs.decode_payload(payloads).select("file_id", F.sha2("text", 256).alias("text_hash"))


@query("p6_blank_files", f"""
SELECT file_id, CASE WHEN file_id % 5 = 0 THEN true ELSE {r.strip('content')} = '' END AS skipped FROM corpus""")
def p6(spark, d):
    blank = F.when(F.col("file_id") % 5 == 0, F.lit(" \t\n ")).otherwise(F.col("text"))
    return inputs.mark_blank(corpus(spark, d).withColumn("text", blank)).select("file_id", "skipped")


# ------------------------------------------------------------------ cache

def _hashed(spark, d):
    return corpus(spark, d).select("file_id", "file_path", F.sha2("text", 256).alias("file_hash"))


def _entries(spark, d):
    return spread_cache(spark, d).select(
        "file_hash", F.concat(F.lit("old"), F.col("first_id").cast("string")).alias("file_path"),
        F.lit("Python").alias("language"), F.timestamp_seconds(F.col("first_id")).alias("scanned_at"))


def spread_cache(spark, d):
    return view(spark, d, "scan_cache").select(F.sha2("content", 256).alias("file_hash"), "first_id", "copies")


@query("j2_cache_lookup", """
SELECT sha256(c.content) AS file_hash, min(c.file_path) AS file_path, CAST(count(*) AS BIGINT) AS copies,
       c.content IN (SELECT content FROM scan_cache) AS from_cache FROM corpus c GROUP BY c.content""")
def j2(spark, d):
    distinct = rollups.distinct_contents(_hashed(spark, d))
    return cache_ops.cache_lookup(distinct, _entries(spark, d))


@query("j6_fan_back", """
SELECT c.file_path, sha256(c.content) AS file_hash, s.first_id, CAST(s.copies AS BIGINT) AS copies
FROM corpus c JOIN scan_cache s ON s.content = c.content""")
def j6(spark, d):
    paths = _hashed(spark, d).select("file_path", "file_hash")
    return spread_join(paths, spread_cache(spark, d), ["file_hash"], "inner", ["file_path"]).select(
        "file_path", "file_hash", "first_id", "copies")


@query("snk3_cache_upsert", """
WITH old AS (SELECT sha256(html) AS file_hash, 'page' || CAST(min(page_id) AS VARCHAR) AS file_path, min(page_id) AS seen_at FROM pages GROUP BY html
             UNION ALL SELECT sha256(content), 'old' || CAST(first_id AS VARCHAR), first_id FROM scan_cache),
new AS (SELECT sha256(text) AS file_hash, 'new' || CAST(max(doc_id) AS VARCHAR) AS file_path, max(doc_id) AS seen_at FROM documents GROUP BY text)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE file_hash NOT IN (SELECT file_hash FROM new)""")
def snk3(spark, d):
    """A store that holds all pages and the labelled documents, then gets all documents."""
    store = FindingCache(spark, fresh_path(spark, "cache"), digits=1)
    nothing = spark.createDataFrame([], cache_ops.FINDING_SCHEMA)

    def entries(label, hashed, number):
        return hashed.groupBy("file_hash").agg(number.alias("at")).select(
            "file_hash", F.concat(F.lit(label), F.col("at").cast("string")).alias("file_path"), F.lit("Python").alias("language"),
            F.timestamp_seconds("at").alias("scanned_at"))

    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.sha2("html", 256).alias("file_hash"), F.col("page_id").alias("id"))
    labelled = view(spark, d, "scan_cache").select(F.sha2("content", 256).alias("file_hash"), F.col("first_id").alias("id"))
    store.put(entries("page", pages, F.min("id")).unionByName(entries("old", labelled, F.min("id"))), nothing)
    store.put(entries("new", _hashed(spark, d), F.max("file_id")), nothing)
    return store.read().entries.select("file_hash", "file_path", F.unix_timestamp("scanned_at").alias("seen_at"))


def _stored(spark, d):
    """A cache folder holding the findings view by file, stored by two runs."""
    store = FindingCache(spark, fresh_path(spark, "cache"), digits=1)
    keyed = typed(spark, d).withColumn("file_hash", F.sha2("file_path", 256))
    for part in (keyed, keyed.where("severity = 'CRITICAL'")):
        entries = part.groupBy("file_hash").agg(F.min("file_path").alias("file_path")).select(
            "*", F.lit("Python").alias("language"), F.current_timestamp().alias("scanned_at"))
        store.put(entries, part)
    return store


@query("snk3_cache_latest", f"""
WITH {r.TYPED}, again AS (SELECT DISTINCT file_path FROM typed WHERE severity = 'CRITICAL')
SELECT {FINDING_COLS.replace('file_path', 'sha256(file_path) AS file_hash')} FROM typed
WHERE severity = 'CRITICAL' OR file_path NOT IN (SELECT file_path FROM again)""")
def snk3_latest(spark, d):
    return _stored(spark, d).read().findings.select("file_hash", *[c for c in OUT if c != "file_path"])


@query("snk4_clear_cache", "SELECT CAST(count(DISTINCT file_path) AS BIGINT) AS removed, 0::BIGINT AS remaining FROM findings")
def snk4(spark, d):
    store = _stored(spark, d)
    removed = store.clear()
    return store.read().entries.agg(F.count(F.lit(1)).alias("remaining")).select(
        F.lit(removed).cast("bigint").alias("removed"), "remaining")


@query("src9_cache_json", f"""
WITH {r.TYPED} SELECT ordinal AS entry, CAST(0 AS BIGINT) AS ordinal, severity,
  CAST(severity_score AS INTEGER) AS severity_score, type, description, impact, fix, line_number, owasp,
  CASE WHEN ordinal % 3 = 0 THEN 1.0::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN ordinal % 3 = 0 THEN 'llm' ELSE source END AS source FROM typed""")
def src9(spark, d):
    raw = view(spark, d, "findings")
    missing = F.col("ordinal") % 3 == 0
    one = F.struct("severity", "type", "description", "impact", "fix", "line_number",
                   F.when(~missing, F.col("confidence")).alias("confidence"),
                   F.when(~missing, F.col("source")).alias("source"))
    rows = raw.select(F.col("ordinal").alias("entry"), F.to_json(F.array(one)).alias("vulnerabilities"))
    return cache_ops.findings_from_json(rows, "entry")


@query("snk5_findings_table", f"""
WITH {r.TYPED} SELECT {FINDING_COLS}, {r.language('file_path')} AS language FROM typed""")
def snk5(spark, d):
    path = fresh_path(spark, "findings")
    reports.write_findings(typed(spark, d).withColumn("language", detect_language(F.col("file_path"))), path)
    return spark.read.parquet(path).select(*OUT, "language")


@query("snk2_sarif_document", f"""
WITH {r.TYPED}, good AS (SELECT * FROM typed WHERE file_path NOT IN (SELECT file_path FROM files WHERE coalesce(error, '') <> ''))
SELECT CAST((SELECT count(DISTINCT {r.rule_id('type')}) FROM good) AS BIGINT) AS rules,
       CAST((SELECT count(*) FROM good) AS BIGINT) AS results, 5::BIGINT AS sections""")
def snk2(spark, d):
    good = reports.reportable(typed(spark, d), view(spark, d, "files"))
    return reports.sarif_document_lines(good, "run").agg(
        F.count_if(F.col("section") == 1).alias("rules"), F.count_if(F.col("section") == 3).alias("results"),
        F.count_distinct("section").alias("sections"))


@query("snk2_sarif_lines", f"""WITH {r.TYPED}, {RULES}, {RESULTS},
rule_lines AS (SELECT *, row_number() OVER (ORDER BY rule_id) AS n FROM rules),
result_lines AS (SELECT *, row_number() OVER (ORDER BY uri, severity_score DESC, confidence DESC, ordinal) AS n FROM results)
SELECT 1 + n AS position, 1 AS section, n > 1 AS follows, rule_id, level, full_description AS text, help_text AS other,
       "precision" || ' ' || security_severity || ' ' || tags AS properties, NULL AS uri, NULL::BIGINT AS start_line, NULL::DOUBLE AS confidence FROM rule_lines
UNION ALL SELECT 2 + (SELECT count(*) FROM rules) + n, 3, n > 1, rule_id, level, message, owasp, source, uri, CAST(start_line AS BIGINT), confidence
FROM result_lines""")
def snk2_lines(spark, d):
    """Every line of the document between its fixed ones, at its place, with the fields its JSON holds."""
    good = reports.reportable(typed(spark, d), view(spark, d, "files"))
    lines = with_position(reports.sarif_document_lines(good, "run").orderBy("section", "k", "rank")).where("section in (1, 3)")
    is_rule, body = F.col("section") == 1, F.ltrim(F.col("line"), F.lit(","))

    def at(of_rule, of_result):
        return F.when(is_rule, F.get_json_object(body, of_rule) if of_rule else None).otherwise(F.get_json_object(body, of_result))
    place = "$.locations[0].physicalLocation"
    tags = F.array_join(F.from_json(F.get_json_object(body, "$.properties.tags"), "array<string>"), ",")
    of_rule = F.concat_ws(" ", F.get_json_object(body, "$.properties.precision"), F.get_json_object(body, "$.properties.security-severity"), tags)
    return lines.select(
        "position", "section", F.startswith("line", F.lit(",")).alias("follows"), at("$.id", "$.ruleId").alias("rule_id"),
        at("$.defaultConfiguration.level", "$.level").alias("level"), at("$.fullDescription.text", "$.message.text").alias("text"),
        at("$.help.text", "$.properties.owasp").alias("other"),
        F.when(is_rule, of_rule).otherwise(F.get_json_object(body, "$.properties.source")).alias("properties"),
        at(None, f"{place}.artifactLocation.uri").alias("uri"), at(None, f"{place}.region.startLine").cast("bigint").alias("start_line"),
        at(None, "$.properties.confidence").cast("double").alias("confidence"))


@query("p7_listing_counts", f"""
SELECT CAST(count(*) AS BIGINT) AS total_files,
       CAST(count(*) FILTER (WHERE {r.scannable('file_path')} AND status IS DISTINCT FROM 'removed') AS BIGINT) AS scannable_files
FROM changed""")
def p7_counts(spark, d):
    return changes.listing_counts(view(spark, d, "changed"))
