"""Report tables and documents (JSON and SARIF 2.1.0).

Tables are the scalable product.  Documents are written by a distributed sort of
text lines: the part files, concatenated in name order, form one valid document,
and no task or driver ever holds more than its share of lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions import labels
from ..functions.text import hash_prefix
from ..operators.ordering import rank_in_file, worst_first
from ..operators.rollups import run_rollup
from ..operators.skew import first_wins, spread_join
from ..schema import FINDING_FIELDS

KEEP_NULLS = {"ignoreNullFields": "false"}
DEFAULT_TOOL = ("siftwork", "1.0.0", "https://example.org/siftwork")


# --------------------------------------------------------------------------- nested JSON

def findings_list(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank_in_file, vulnerability): the ordered list of each key, one row per finding.

    Rows and not arrays, because one file may hold any number of findings.
    """
    return rank_in_file(findings, *keys).select(*keys, "rank_in_file", F.struct(*FINDING_FIELDS).alias("vulnerability"))


def _counts_struct() -> Column:
    return F.struct(*[F.col(s.lower()).alias(s) for s in fixed.SEVERITY_SCORES])


def json_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_path, rank, document): one JSON text per file (rank 0), clean files included, and one per finding (from 1).

    Every file has this shape, whatever the number of its findings; texts of a file follow each other
    in the order of (file_path, rank).
    """
    opened = files.select("file_path", F.lit(0).cast("bigint").alias("rank"), F.to_json(F.struct(
        "file_path", "language", hash_prefix(F.col("file_hash")).alias("file_hash"), "from_cache",
        "risk_score", _counts_struct().alias("severity_counts"), "error"), KEEP_NULLS).alias("document"))
    listed = findings_list(findings, "file_path").select("file_path", F.col("rank_in_file").alias("rank"), F.to_json(
        F.struct("file_path", F.col("rank_in_file").alias("rank"), "vulnerability"), KEEP_NULLS).alias("document"))
    return opened.unionByName(listed)


def json_summary(files: DataFrame) -> DataFrame:
    run = run_rollup(files)
    return run.select(F.to_json(F.struct(
        "files_scanned", "total_vulnerabilities", _counts_struct().alias("severity_counts"), "cache_hits",
    ), KEEP_NULLS).alias("summary"))


def write_json_report(files: DataFrame, findings: DataFrame, path: str) -> None:
    """`files/` holds the texts of `json_report`, one per line and in order, `summary/` the run summary."""
    json_report(files, findings).orderBy("file_path", "rank").select("document").write.text(f"{path}/files")
    json_summary(files).write.text(f"{path}/summary")


def _write_lines(lines: DataFrame, path: str, *order: str) -> None:
    lines.orderBy(*order).select("line").write.text(path)


def _object_fields(struct: Column) -> Column:
    """A JSON object text without its closing brace, ready for one more field."""
    text = F.to_json(struct, KEEP_NULLS)
    return F.substring(text, F.lit(1), F.length(text) - 1)


def json_document_lines(files: DataFrame, findings: DataFrame, generated_at: str) -> DataFrame:
    """Lines of the single-document JSON report with their sort keys.

    Every finding is a line of its own, so even one huge file is spread by the
    sort.  Files and findings write their comma in front, except the first.
    """
    first_path = files.agg(F.min("file_path").alias("p")).first()["p"]
    summary = json_summary(files).first()["summary"]
    head = json.dumps({"generated_at": generated_at})[:-1] + f', "summary": {summary}, "files": ['
    spark, no_rank = files.sparkSession, F.lit(0).cast("bigint")

    def fixed_line(section: int, text: str) -> DataFrame:
        return spark.range(1).select(
            F.lit(section).alias("section"), F.lit("").alias("file_path"), F.lit(0).alias("kind"),
            no_rank.alias("rank"), F.lit(text).alias("line"))

    comma = F.when(F.col("file_path") == first_path, "").otherwise(",")
    opened = files.select(
        F.lit(1).alias("section"), "file_path", F.lit(0).alias("kind"), no_rank.alias("rank"),
        F.concat(comma, _object_fields(F.struct(
            "file_path", "language", hash_prefix(F.col("file_hash")).alias("file_hash"), "from_cache",
            "risk_score", _counts_struct().alias("severity_counts"), "error")),
            F.lit(',"vulnerabilities":[')).alias("line"))
    listed = rank_in_file(findings, "file_path").select(
        F.lit(1).alias("section"), "file_path", F.lit(1).alias("kind"), F.col("rank_in_file").alias("rank"),
        F.concat(F.when(F.col("rank_in_file") > 1, ",").otherwise(""),
                 F.to_json(F.struct(*FINDING_FIELDS), KEEP_NULLS)).alias("line"))
    closed = files.select(F.lit(1).alias("section"), "file_path", F.lit(2).alias("kind"), no_rank.alias("rank"),
                          F.lit("]}").alias("line"))
    return (fixed_line(0, head).unionByName(opened).unionByName(listed).unionByName(closed)
            .unionByName(fixed_line(2, "]}")))


def write_json_document(files: DataFrame, findings: DataFrame, path: str, generated_at: str) -> None:
    _write_lines(json_document_lines(files, findings, generated_at), path, "section", "file_path", "kind", "rank")


# --------------------------------------------------------------------------- SARIF

def reportable(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of files that were read without error (an empty error counts as none)."""
    broken = files.where(F.coalesce("error", F.lit("")) != "").select("file_path")
    return spread_join(findings, broken, ["file_path"], "left_anti", ["ordinal"])


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per id; its metadata comes from the first finding in reported order: path, then worst first."""
    keyed = findings.select(
        labels.rule_id(F.col("type")).alias("rule_id"), "file_path", "ordinal", "type", "description", "fix",
        "severity", "severity_score", "confidence", "source")
    first = first_wins(keyed, ["rule_id"], "file_path", *worst_first())
    return first.select(
        "rule_id",
        labels.rule_name(F.col("type")).alias("name"),
        F.col("type").alias("short_description"),
        F.col("description").alias("full_description"),
        F.concat(F.lit("Fix: "), F.col("fix")).alias("help_text"),
        F.concat(F.lit("**Fix:** `"), F.col("fix"), F.lit("`")).alias("help_markdown"),
        labels.sarif_level(F.col("severity")).alias("level"),
        labels.precision(F.col("confidence")).alias("precision"),
        labels.security_severity(F.col("severity")).alias("security_severity"),
        F.array(F.lit("security"), F.col("source")).alias("tags"))


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select(
        labels.rule_id(F.col("type")).alias("rule_id"),
        labels.sarif_level(F.col("severity")).alias("level"),
        F.concat(F.col("description"), F.lit(" — "), F.col("impact")).alias("message"),
        F.col("file_path").alias("uri"),
        F.coalesce(F.nullif("line_number", F.lit(0).cast("bigint")), F.lit(1).cast("bigint")).alias("start_line"),
        F.coalesce("owasp", F.lit("")).alias("owasp"),
        "confidence", "source", "ordinal", "severity_score")


def results_with_rules(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Each result with the metadata of its rule; few rules may hold most results."""
    about = rules.select("rule_id", F.col("name").alias("rule_name"), "precision", "security_severity")
    return spread_join(results, about, ["rule_id"], "inner", ["uri", "ordinal"])


def _rule_json() -> Column:
    def text_of(name):
        return F.struct(F.col(name).alias("text"))
    return F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name",
        text_of("short_description").alias("shortDescription"),
        text_of("full_description").alias("fullDescription"),
        F.lit(fixed.SARIF_HELP_URI).alias("helpUri"),
        F.struct(F.col("help_text").alias("text"), F.col("help_markdown").alias("markdown")).alias("help"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct("tags", "precision", F.col("level").alias("problem.severity"),
                 F.col("security_severity").alias("security-severity")).alias("properties"),
    ), KEEP_NULLS)


def _result_json() -> Column:
    place = F.struct(F.struct(
        F.struct(F.col("uri"), F.lit(fixed.SARIF_URI_BASE).alias("uriBaseId")).alias("artifactLocation"),
        F.struct(F.col("start_line").alias("startLine")).alias("region"),
    ).alias("physicalLocation"))
    return F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct("owasp", "confidence", "source").alias("properties"),
    ), KEEP_NULLS)


def sarif_document_lines(findings: DataFrame, run_id: str, tool=DEFAULT_TOOL) -> DataFrame:
    """Lines of one SARIF document with their sort keys; rules and results are a line each."""
    name, version, uri = tool
    rules, results = sarif_rules(findings), sarif_results(findings)
    first_rule = rules.agg(F.min("rule_id").alias("r")).first()["r"]
    head = json.dumps({"version": fixed.SARIF_VERSION, "$schema": fixed.SARIF_SCHEMA})[:-1]
    driver = json.dumps({"name": name, "version": version, "informationUri": uri})[:-1]
    spark, zero = findings.sparkSession, F.lit(0).cast("bigint")

    def fixed_line(section: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(section).alias("section"), F.lit("").alias("k"), zero.alias("rank"),
                                     F.lit(text).alias("line"))

    first_uri = findings.agg(F.min("file_path").alias("p")).first()["p"]
    rule_lines = rules.select(
        F.lit(1).alias("section"), F.col("rule_id").alias("k"), zero.alias("rank"),
        F.concat(F.when(F.col("rule_id") == first_rule, "").otherwise(","), _rule_json()).alias("line"))
    ranked = rank_in_file(results.withColumn("file_path", F.col("uri")), "file_path")
    is_first = (F.col("uri") == first_uri) & (F.col("rank_in_file") == 1)
    result_lines = ranked.select(
        F.lit(3).alias("section"), F.col("uri").alias("k"), F.col("rank_in_file").alias("rank"),
        F.concat(F.when(is_first, "").otherwise(","), _result_json()).alias("line"))
    return (fixed_line(0, f'{head}, "runs": [{{"tool": {{"driver": {driver}, "rules": [')
            .unionByName(rule_lines)
            .unionByName(fixed_line(2, ']}}, "results": ['))
            .unionByName(result_lines)
            .unionByName(fixed_line(4, f'], "automationDetails": {json.dumps({"id": run_id})}}}]}}')))


def write_sarif(files: DataFrame, findings: DataFrame, path: str, run_id: str, tool=DEFAULT_TOOL) -> None:
    """`rules/` and `results/` tables, and `document/` whose parts concatenate to one SARIF file."""
    good = reportable(findings, files)
    sarif_rules(good).write.json(f"{path}/rules")
    sarif_results(good).write.json(f"{path}/results")
    _write_lines(sarif_document_lines(good, run_id, tool), f"{path}/document", "section", "k", "rank")


def write_findings(findings: DataFrame, path: str) -> None:
    """Append to a findings table laid out by language and severity.

    Rows are dealt by the folder they go to before they are written: tasks of about the session's
    advisory size, large folders split and small ones joined, so a folder gets few files.
    """
    (findings.hint("rebalance", "language", "severity")
     .write.mode("append").partitionBy("language", "severity").parquet(path))
