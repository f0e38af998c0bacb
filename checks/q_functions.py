"""Scalar functions and projections."""

from pyspark.sql import functions as F

from siftwork import fixed
from siftwork.functions import labels, paths, text as tx
from siftwork.operators.merge import complete_findings
from siftwork.operators.replies import reply_blocks

from . import registry as r
from .registry import query
from .views import corpus, view


def _typed(spark, d):
    return complete_findings(view(spark, d, "findings"))


def _paths(spark, d):
    return view(spark, d, "corpus").select("file_path")


@query("f1_file_suffix", f"SELECT file_path, {r.suffix('file_path')} AS suffix FROM corpus")
def f1(spark, d):
    return _paths(spark, d).select("file_path", paths.file_suffix(F.col("file_path")).alias("suffix"))


@query("f2_detect_language", f"SELECT file_path, {r.language('file_path')} AS language FROM corpus")
def f2(spark, d):
    return _paths(spark, d).select("file_path", paths.detect_language(F.col("file_path")).alias("language"))


@query("j5_language_table", f"SELECT file_path, {r.language('file_path')} AS language FROM corpus")
def j5(spark, d):
    table = spark.createDataFrame(list(fixed.SUFFIX_LANGUAGES.items()), "suffix string, language string")
    return paths.with_language_table(_paths(spark, d), table).select("file_path", "language")


@query("p1_is_scannable", f"SELECT file_path FROM corpus WHERE {r.scannable('file_path')}")
def p1(spark, d):
    return _paths(spark, d).where(paths.is_scannable(F.col("file_path")))


@query("p2_in_skip_dir", """
SELECT file_path, list_has_any(string_split(file_path, '/'), [{}]) AS skipped FROM corpus
""".format(", ".join(map(r.sql_text, fixed.SKIP_DIRS))))
def p2(spark, d):
    return _paths(spark, d).select("file_path", paths.in_skip_dir(F.col("file_path")).alias("skipped"))


@query("f3_fingerprint", "SELECT file_path, sha256(content) AS file_hash FROM corpus")
def f3(spark, d):
    return corpus(spark, d).select("file_path", tx.fingerprint(F.col("text")).alias("file_hash"))


@query("f4_severity_score", f"SELECT ordinal, CAST({r.score('severity')} AS INTEGER) AS severity_score FROM findings")
def f4(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.severity_score(F.col("severity")).alias("severity_score"))


@query("f5_type_key", f"SELECT ordinal, {r.type_key('type')} AS type_key FROM findings")
def f5(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.type_key(F.col("type")).alias("type_key"))


# Blocks of all usable replies, numbered from zero: the oracle twin of the block splitter.
BLOCKS = f"""
usable AS (SELECT resp_id, string_split_regex(chr(10) || {r.strip('response_text')} || chr(10), '\\n-{{3,}}\\n') AS parts
           FROM responses WHERE error IS NULL AND response_text IS NOT NULL
             AND NOT contains(upper(response_text), 'NO_VULNERABILITIES')),
blocks AS (SELECT resp_id, block_idx, {r.strip('block')} AS block FROM (
             SELECT resp_id, unnest(range(len(parts))) AS block_idx, unnest(parts) AS block FROM usable) u
           WHERE {r.strip('block')} <> '')"""


def _blocks(spark, d):
    return reply_blocks(view(spark, d, "responses"), "resp_id")


@query("n1_split_blocks", f"WITH {BLOCKS} SELECT resp_id, CAST(block_idx AS INTEGER) AS block_idx, block FROM blocks")
def n1(spark, d):
    return _blocks(spark, d)


@query("f8_extract_field", f"WITH {BLOCKS} SELECT resp_id, CAST(block_idx AS INTEGER) AS block_idx, "
       + ", ".join(f"{r.field('block', n)} AS {n.lower()}_text" for n in fixed.REPLY_FIELDS) + " FROM blocks")
def f8(spark, d):
    return _blocks(spark, d).select("resp_id", "block_idx", *[
        tx.extract_field(F.col("block"), n).alias(f"{n.lower()}_text") for n in fixed.REPLY_FIELDS])


@query("f6_parse_severity", f"""
SELECT resp_id, {r.parsed_severity("regexp_extract(response_text, 'SEVERITY:([^\\n]*)', 1)")} AS severity
FROM responses WHERE response_text IS NOT NULL""")
def f6(spark, d):
    raw = F.regexp_extract("response_text", r"SEVERITY:([^\n]*)", 1)
    return view(spark, d, "responses").where("response_text is not null").select(
        "resp_id", tx.parse_severity(raw).alias("severity"))


@query("f7_parse_line", f"""
SELECT resp_id, {r.parsed_line("regexp_extract(response_text, 'LINE:([^\\n]*)', 1)")} AS line_number
FROM responses WHERE response_text IS NOT NULL""")
def f7(spark, d):
    raw = F.regexp_extract("response_text", r"LINE:([^\n]*)", 1)
    return view(spark, d, "responses").where("response_text is not null").select(
        "resp_id", tx.parse_line(raw).alias("line_number"))


@query("f9_infer_owasp", f"""
SELECT ordinal, coalesce(CASE WHEN ordinal % 11 = 0 THEN '' END, {r.owasp('type')}) AS owasp FROM findings""")
def f9(spark, d):
    given = F.when(F.col("ordinal") % 11 == 0, "")
    return view(spark, d, "findings").select("ordinal", labels.fill_owasp(given, F.col("type")).alias("owasp"))


@query("f10_rule_id", f"SELECT ordinal, {r.rule_id('type')} AS rule_id FROM findings")
def f10(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.rule_id(F.col("type")).alias("rule_id"))


@query("f11_rule_name", "SELECT ordinal, replace(type, ' ', '') AS rule_name FROM findings")
def f11(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.rule_name(F.col("type")).alias("rule_name"))


@query("f12_sarif_level", f"SELECT ordinal, {r.sql_case('severity', fixed.SARIF_LEVELS)} AS level FROM findings")
def f12(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.sarif_level(F.col("severity")).alias("level"))


@query("f13_security_severity",
       f"SELECT ordinal, {r.sql_case('severity', fixed.SARIF_SECURITY_SEVERITY)} AS security_severity FROM findings")
def f13(spark, d):
    return view(spark, d, "findings").select(
        "ordinal", labels.security_severity(F.col("severity")).alias("security_severity"))


@query("f14_precision",
       "SELECT ordinal, CASE WHEN confidence >= 0.9::DOUBLE THEN 'high' ELSE 'medium' END AS \"precision\" FROM findings")
def f14(spark, d):
    return view(spark, d, "findings").select("ordinal", labels.precision(F.col("confidence")).alias("precision"))


@query("f15_hash_prefix", "SELECT file_path, left(sha256(content), 12) || '…' AS hash_prefix FROM corpus")
def f15(spark, d):
    return corpus(spark, d).select("file_path", tx.hash_prefix(tx.fingerprint(F.col("text"))).alias("hash_prefix"))


@query("f16_owasp_short", f"""WITH {r.TYPED}
SELECT ordinal, CASE WHEN coalesce(owasp, '') = '' THEN '—' ELSE trim(split_part(owasp, '–', 1)) END AS owasp_short
FROM typed""")
def f16(spark, d):
    return _typed(spark, d).select("ordinal", labels.owasp_short(F.col("owasp")).alias("owasp_short"))


_LINK = r"^https?://github\.com/([^/]+)/([^/]+)/pull/([0-9]+)"


@query("f17_parse_pr_url", f"""
SELECT page_id, CASE WHEN ok THEN regexp_extract(u, '{_LINK}', 1) END AS owner,
       CASE WHEN ok THEN regexp_extract(u, '{_LINK}', 2) END AS repo,
       CASE WHEN ok THEN CAST(regexp_extract(u, '{_LINK}', 3) AS BIGINT) END AS number
FROM (SELECT page_id, {r.strip('pr_url')} AS u, regexp_matches({r.strip('pr_url')}, '{_LINK}') AS ok FROM pr_links) x""")
def f17(spark, d):
    return view(spark, d, "pr_links").select("page_id", tx.parse_pr_link(F.col("pr_url")).alias("p")).select(
        "page_id", "p.owner", "p.repo", "p.number")


@query("f18_split_lines", """
SELECT file_path, CAST(n AS BIGINT) AS lines, sha256(array_to_string(lines[1:n], '|')) AS lines_hash FROM (
  SELECT file_path, lines, len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS n
  FROM (SELECT file_path, string_split(content, chr(10)) AS lines FROM corpus) a) b""")
def f18(spark, d):
    lines = tx.split_lines(F.col("text"))
    return corpus(spark, d).select(
        "file_path", F.size(lines).cast("bigint").alias("lines"), F.sha2(F.array_join(lines, "|"), 256).alias("lines_hash"))


@query("f19_progress_pct", """
SELECT seq, CASE WHEN total > 0 THEN CAST(round(100.0 * idx / total) AS BIGINT) ELSE 0 END AS pct FROM scan_events""")
def f19(spark, d):
    return view(spark, d, "scan_events").select("seq", tx.progress_pct(F.col("idx"), F.col("total")).alias("pct"))


@query("f20_strip_ws", f"""
SELECT file_id, {r.strip("chr(9) || ' ' || content || chr(10) || chr(31)")} AS stripped FROM corpus""")
def f20(spark, d):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n\x1f"))
    return corpus(spark, d).select("file_id", tx.strip_ws(padded).alias("stripped"))
