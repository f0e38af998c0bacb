"""Replies, secrets, risky calls and the whole scan."""

from pyspark.sql import Window, functions as F

from siftwork import fixed
from siftwork.operators import callsites, pattern_index, replies as reply_ops, rollups, rules, secrets
from siftwork.functions import labels
from siftwork.functions.paths import in_skip_dir
from siftwork.operators.secrets import BUILTIN_PATTERNS, SecretPattern
from siftwork.plans import prompts
from siftwork.plans.changes import scan_changes
from siftwork.plans.scan import scan, static_findings
from siftwork.schema import STAGE_REPLY, STAGE_SECRET, SUB_BITS, stage_base
from siftwork.sources import inputs
from siftwork.sources.cache import CacheTables

from . import registry as r
from .q_functions import BLOCKS
from .registry import query
from .views import corpus, load_tables, py_corpus, view

#: A user-supplied pattern: the corpus holds such tokens, the built-in patterns rarely hit it.
TOKEN = SecretPattern('(?i)token\\s*=\\s*"[0-9a-f]{40}"', "Hardcoded Token", "HIGH")
PATTERNS = (*BUILTIN_PATTERNS, TOKEN)

_FIELDS = ("ordinal, severity, CAST(severity_score AS INTEGER) AS severity_score, type, description, impact, fix, "
           "line_number, owasp, confidence, source")


# ------------------------------------------------------------------ replies

REPLY_FINDINGS = f"""{BLOCKS},
fields AS (SELECT resp_id, block_idx, {', '.join(f"{r.field('block', n)} AS {n.lower()}_text" for n in fixed.REPLY_FIELDS)}
           FROM blocks),
reply_findings AS (
  SELECT resp_id, CAST({stage_base(STAGE_REPLY)} + block_idx * {1 << SUB_BITS} AS BIGINT) AS ordinal,
         {r.parsed_severity('severity_text')} AS severity, type_text AS type, description_text AS description,
         impact_text AS impact, fix_text AS fix, {r.parsed_line('line_text')} AS line_number,
         {r.owasp('type_text')} AS owasp, 80 / 100.0::DOUBLE AS confidence, 'llm' AS source
  FROM fields WHERE severity_text <> '' AND type_text <> ''),
reply_errors AS (
  SELECT resp_id, CAST({stage_base(STAGE_REPLY)} AS BIGINT) AS ordinal, 'INFO' AS severity,
         {r.sql_text(fixed.REPLY_ERROR_TYPE)} AS type,
         {r.sql_text(fixed.REPLY_ERROR_DESCRIPTION_PREFIX)} || coalesce(error, 'empty reply') AS description,
         {r.sql_text(fixed.REPLY_ERROR_IMPACT)} AS impact, {r.sql_text(fixed.REPLY_ERROR_FIX)} AS fix,
         CAST(NULL AS BIGINT) AS line_number, CAST(NULL AS VARCHAR) AS owasp, 1.0::DOUBLE AS confidence, 'llm' AS source
  FROM responses WHERE error IS NOT NULL OR response_text IS NULL)"""


def _out(key):
    return f"SELECT {key}, {_FIELDS} FROM (SELECT *, {r.score('severity')} AS severity_score FROM"


@query("n2_parse_replies", f"WITH {REPLY_FINDINGS} {_out('resp_id')} reply_findings) x")
def n2(spark, d):
    return reply_ops.parse_replies(view(spark, d, "responses"), "resp_id")


@query("n3_none_sentinel", """
SELECT resp_id FROM responses WHERE contains(upper(response_text), 'NO_VULNERABILITIES')""")
def n3(spark, d):
    replies = view(spark, d, "responses").where("response_text is not null")
    used = reply_ops.reply_blocks(replies, "resp_id").select("resp_id").distinct()
    return replies.select("resp_id").join(used, "resp_id", "left_anti")


@query("p11_reply_errors", f"WITH {REPLY_FINDINGS} {_out('resp_id')} reply_errors) x")
def p11(spark, d):
    return reply_ops.reply_errors(view(spark, d, "responses"), "resp_id")


@query("src8_reply_findings", f"""WITH {REPLY_FINDINGS}
{_out('resp_id')} (SELECT * FROM reply_findings UNION ALL SELECT * FROM reply_errors) y) x""")
def src8(spark, d):
    return reply_ops.reply_findings(view(spark, d, "responses"), "resp_id")


@query("p9_prompts", f"""
SELECT file_path AS file_hash, sha256({r.sql_text(prompts.PROMPT_HEAD)} || {r.language('file_path')} ||
  {r.sql_text(prompts.PROMPT_FORMAT)} || content || {r.sql_text(prompts.PROMPT_TAIL)}) AS prompt_hash FROM corpus""")
def p9(spark, d):
    files = corpus(spark, d).select(F.col("file_path").alias("file_hash"), "text",
                                    inputs.detect_language(F.col("file_path")).alias("language"))
    return prompts.build_prompts(files).select("file_hash", F.sha2("prompt", 256).alias("prompt_hash"))


# ------------------------------------------------------------------ secrets

_SQL_PATTERNS = [(p, t, s) for p, t, s in fixed.SECRET_PATTERNS] + [(TOKEN.pattern, TOKEN.type, TOKEN.severity)]


def _patterns_cte(count):
    rows = ", ".join(f"({i}, {r.sql_text(p)}, {r.sql_text(t)}, {r.sql_text(s)})"
                     for i, (p, t, s) in enumerate(_SQL_PATTERNS[:count]))
    return f"patterns AS (SELECT * FROM (VALUES {rows}) AS p(pattern_idx, pattern, type, severity))"


def _secrets_cte(source, key, text, where="true", count=6):
    hits = " UNION ALL ".join(
        f"SELECT {key}, line_number, {i} AS pattern_idx FROM lines WHERE regexp_matches(line, {r.sql_text(p)})"
        for i, (p, _, _) in enumerate(_SQL_PATTERNS[:count]))
    return f"""
{_patterns_cte(count)},
lines AS (SELECT {key}, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line
          FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {source} WHERE {where}) s),
hits AS ({hits}),
secret_findings AS (
  SELECT {key}, CAST({stage_base(STAGE_SECRET)} + line_number * {1 << SUB_BITS} + pattern_idx AS BIGINT) AS ordinal,
         severity, type,
         replace({r.sql_text(fixed.SECRET_DESCRIPTION)}, '{{type}}', type) AS description,
         {r.sql_text(fixed.SECRET_IMPACT)} AS impact, {r.sql_text(fixed.SECRET_FIX)} AS fix, line_number,
         {r.owasp('type')} AS owasp, 0.88::DOUBLE AS confidence, 'static' AS source
  FROM hits JOIN patterns USING (pattern_idx)
  QUALIFY row_number() OVER (PARTITION BY {key}, type, line_number ORDER BY pattern_idx) = 1)"""


@query("n5_explode_lines", f"""WITH {_secrets_cte('corpus', 'file_id', 'content')}
SELECT file_id, line_number, sha256(line) AS line_hash FROM lines l
WHERE NOT (line = '' AND line_number = (SELECT len(string_split(content, chr(10))) FROM corpus c WHERE c.file_id = l.file_id))""")
def n5(spark, d):
    return secrets.explode_lines(corpus(spark, d), "file_id").select(
        "file_id", "line_number", F.sha2("line", 256).alias("line_hash"))


@query("j4_lines_by_patterns", f"""WITH {_secrets_cte('py_corpus', 'file_id', 'text')}
SELECT file_id, line_number, CAST(pattern_idx AS INTEGER) AS pattern_idx FROM hits""")
def j4(spark, d):
    return secrets.secret_hits(py_corpus(spark, d), "file_id", patterns=PATTERNS)


@query("r13_user_patterns", f"WITH {_secrets_cte('corpus', 'file_path', 'content')} {_out('file_path')} secret_findings) x")
def r13(spark, d):
    return secrets.secret_findings(corpus(spark, d), "file_path", patterns=PATTERNS)


@query("r13_many_patterns", """
WITH wanted AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
words AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS pattern_idx FROM wanted WHERE length(word) >= 4),
lines AS (SELECT file_path, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line
          FROM (SELECT file_path, string_split(content, chr(10)) AS parts FROM corpus) s)
SELECT file_path, line_number, word AS type, CAST(pattern_idx AS INTEGER) AS pattern_idx
FROM lines JOIN words ON contains(lower(line), word) WHERE regexp_matches(line, '(?i)' || word || '[a-z]+ [^,.]')""")
def r13_many(spark, d):
    """Every word of the benchmark, with an ending, as a user pattern of its own."""
    words = (spark.read.parquet(f"{d}/benchmark.parquet")
             .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
             .where("length(word) >= 4").distinct())
    table = words.select(F.row_number().over(Window.orderBy("word")).alias("pattern_idx"),
                         F.concat(F.lit("(?i)"), "word", F.lit("[a-z]+ [^,.]")).alias("pattern"), F.col("word").alias("type"), F.lit("LOW").alias("severity"))
    patterns = secrets.patterns_from_table(table)
    hits = pattern_index.indexed_hits(corpus(spark, d), "file_path", patterns=patterns)
    kinds = spark.createDataFrame([(i, p.type) for i, p in enumerate(patterns)], "pattern_idx int, type string")
    return hits.join(F.broadcast(kinds), "pattern_idx").select("file_path", "line_number", "type", "pattern_idx")


# One line per built-in pattern is planted in a share of the documents, next to
# a near miss of each, so that every rule has hits and misses on real texts.
PLANTED = """planted AS (
SELECT doc_id AS file_id, concat(text, chr(10), CASE doc_id % 10
  WHEN 0 THEN 'PassWd = "s3cretvalue"' WHEN 1 THEN 'pwd = "abc"'
  WHEN 2 THEN 'api_key = ''0123456789abcdef''' WHEN 3 THEN 'auth_token = "short"'
  WHEN 4 THEN 'use(sk-abcdefghij0123456789XYZ)' WHEN 5 THEN 'use(sk-tooshort)'
  WHEN 6 THEN 'AWS_SECRET_ACCESS_KEY="wJalrXUtnFEMI"' WHEN 7 THEN '-----BEGIN EC PRIVATE KEY-----'
  WHEN 8 THEN '-----BEGIN DSA PRIVATE KEY-----' ELSE 'password == "abcdef"' END) AS text
FROM documents)"""


def _planted(spark, d):
    load_tables(spark, d)
    return spark.sql(f"WITH {PLANTED} SELECT * FROM planted")


def _secret_rule(name, index):
    kind = fixed.SECRET_PATTERNS[index][1]

    @query(name, f"""WITH {PLANTED}, {_secrets_cte('planted', 'file_id', 'text', count=5)}
{_out('file_id')} secret_findings) x WHERE type = {r.sql_text(kind)}""")
    def run(spark, d):
        found = secrets.secret_findings(_planted(spark, d), "file_id", patterns=[BUILTIN_PATTERNS[index]])
        shifted = F.col("ordinal") + F.lit(index)  # ordinals count patterns from this one
        return found.withColumn("ordinal", shifted)


for _name, _index in (("r8_hardcoded_password", 0), ("r9_hardcoded_api_key", 1), ("r10_provider_key", 2),
                      ("r11_aws_secret", 3), ("r12_private_key", 4)):
    _secret_rule(_name, _index)


# ------------------------------------------------------------------ risky calls

_CALLS = """calls AS (SELECT p.file_id, p.file_path, CAST(s.call_seq AS BIGINT) AS call_seq,
  CAST(p.head + s.line_offset AS BIGINT) AS line_number, s.func_kind, s.base_name, s.func_name, s.arg0_kind,
  s.kw_names, s.kw_true, s.rule FROM py_corpus p JOIN snippet_calls s USING (t))"""

_messages = []
for _idx, (_rule, (_sev, _type, _desc, _impact, _fix, _)) in enumerate(fixed.CALL_MESSAGES.items()):
    _messages.append(f"({r.sql_text(_rule)}, {_idx}, {r.sql_text(_sev)}, {r.sql_text(_type)}, {r.sql_text(_desc)}, "
                     f"{r.sql_text(_impact)}, {r.sql_text(_fix)})")
_SQL_DESC = " ".join(f"WHEN arg0_kind = '{k}' THEN {r.sql_text(t)}" for k, (t, _) in fixed.SQL_DESCRIPTIONS.items())
_SQL_CONF = " ".join(f"WHEN arg0_kind = '{k}' THEN {c}" for k, (_, c) in fixed.SQL_DESCRIPTIONS.items())
_CALL_FINDINGS = f"""{_CALLS},
messages AS (SELECT * FROM (VALUES {', '.join(_messages)}) AS m(rule, rule_idx, severity, type, description, impact, fix)),
call_findings AS (
  SELECT file_id, file_path, call_seq * {1 << SUB_BITS} + rule_idx AS ordinal, severity, type,
         CASE WHEN rule = 'sql_injection' THEN CASE {_SQL_DESC} END
              ELSE replace(description, '{{name}}', func_name) END AS description,
         impact, fix, line_number, {r.owasp('type')} AS owasp,
         CAST(CASE rule WHEN 'code_injection' THEN 0.97 WHEN 'command_injection' THEN CASE WHEN arg0_kind = 'fstring' THEN 0.98 ELSE 0.80 END
              WHEN 'shell_true' THEN 0.92 WHEN 'sql_injection' THEN CASE {_SQL_CONF} END WHEN 'weak_hash' THEN 0.88
              WHEN 'pickle_loads' THEN 0.92 ELSE 0.95 END AS DOUBLE) AS confidence,
         'static' AS source, rule
  FROM calls JOIN messages USING (rule))"""


@query("x1_call_sites", f"""WITH {_CALLS}
SELECT file_id, call_seq, line_number, func_kind, base_name, func_name, arg0_kind, kw_names, kw_true FROM calls""")
def x1(spark, d):
    sites = callsites.call_sites(py_corpus(spark, d), "file_id").where("call_seq >= 0")
    return sites.select("file_id", "call_seq", "line_number", "func_kind", "base_name", "func_name", "arg0_kind",
                        F.array_join("kw_names", ",").alias("kw_names"), F.array_join("kw_true", ",").alias("kw_true"))


@query("x1_parse_errors", "SELECT file_id FROM py_corpus WHERE t = 11")
def x1_errors(spark, d):
    sites = callsites.call_sites(py_corpus(spark, d), "file_id")
    return sites.where("parse_error is not null").select("file_id")


def _call_rule(name, rule):
    @query(name, f"WITH {_CALL_FINDINGS} {_out('file_id')} call_findings) x WHERE rule = '{rule}'")
    def run(spark, d):
        sites = callsites.call_sites(py_corpus(spark, d), "file_id", only_names=rules.WATCHED_NAMES)
        return rules.call_findings(sites, "file_id", rules=[rule])


for _name, _rule in (("r1_code_injection", "code_injection"), ("r2_command_injection", "command_injection"),
                     ("r3_shell_true", "shell_true"), ("r4_sql_injection", "sql_injection"),
                     ("r5_weak_hash", "weak_hash"), ("r6_pickle_loads", "pickle_loads"),
                     ("r7_yaml_load", "yaml_load")):
    _call_rule(_name, _rule)

STATIC = f"""{_CALL_FINDINGS}, {_secrets_cte('py_corpus', 'file_path', 'text', where='t <> 11', count=5)},
static_findings AS (
  SELECT * FROM (SELECT file_path, ordinal, severity, type, description, impact, fix, line_number, owasp, confidence, source
                 FROM call_findings
                 UNION ALL SELECT file_path, ordinal, severity, type, description, impact, fix, line_number, owasp,
                                  confidence, source FROM secret_findings) u
  QUALIFY row_number() OVER (PARTITION BY file_path, type, line_number ORDER BY ordinal) = 1)"""


@query("r14_static_findings", f"WITH {STATIC} {_out('file_path')} static_findings) x")
def r14(spark, d):
    return static_findings(py_corpus(spark, d), "file_path")


@query("u1_calls_and_secrets", f"WITH {STATIC} SELECT file_path, type, line_number FROM static_findings")
def u1(spark, d):
    return static_findings(py_corpus(spark, d), "file_path").select("file_path", "type", "line_number")


# ------------------------------------------------------------------ whole scan

# Contents of the snippet corpus are distinct per document unless two documents
# share text and snippet; the oracle works per content like the scan does.
_SCAN = f"""
py_files AS (SELECT file_id, t, file_path, text, sha256(text) AS file_hash, {r.language('file_path')} AS language FROM py_corpus),
reps AS (SELECT file_hash, min(file_path) AS rep_path FROM py_files GROUP BY file_hash),
cached AS (SELECT DISTINCT file_hash FROM py_files WHERE file_id % 6 = 5),
fresh AS (SELECT r.file_hash, r.rep_path, f.language, f.file_id FROM reps r JOIN py_files f ON f.file_path = r.rep_path
          WHERE r.file_hash NOT IN (SELECT file_hash FROM cached)),
{STATIC}, {REPLY_FINDINGS},
static_fresh AS (SELECT fr.file_hash, s.* EXCLUDE (file_path) FROM static_findings s JOIN fresh fr ON s.file_path = fr.rep_path
                 WHERE fr.language = 'Python'),
reply_fresh AS (SELECT fr.file_hash, x.* EXCLUDE (resp_id)
                FROM (SELECT * FROM reply_findings UNION ALL SELECT * FROM reply_errors) x
                JOIN fresh fr ON x.resp_id = fr.file_id),
merged AS (SELECT * FROM static_fresh UNION ALL
           SELECT * FROM reply_fresh l WHERE NOT EXISTS (SELECT 1 FROM static_fresh s
             WHERE s.file_hash = l.file_hash AND {r.type_key('s.type')} = {r.type_key('l.type')})
           UNION ALL
           SELECT file_hash, 0, 'HIGH', 'Path Traversal', 'remembered', 'i', 'f', 7, {r.owasp("'Path Traversal'")}, 0.5::DOUBLE, 'llm'
           FROM cached),
by_hash AS (SELECT *, {r.score('severity')} AS severity_score FROM merged WHERE {r.score('severity')} >= 1)"""


def _scan(spark, d, use_cache=True, **options):
    files = py_corpus(spark, d).select("file_id", "file_path", "text")
    hashed = files.select("file_id", "file_path", F.sha2("text", 256).alias("file_hash"))
    # A reply belongs to the smallest path of its content.
    reps = hashed.groupBy("file_hash").agg(F.min_by("file_id", "file_path").alias("resp_id"))
    replies = view(spark, d, "responses").join(reps, "resp_id").select("file_hash", "response_text", "error")
    known = hashed.where("file_id % 6 = 5").select("file_hash").distinct()
    remembered = known.select(
        "file_hash", F.lit(0).cast("bigint").alias("ordinal"), F.lit("HIGH").alias("severity"),
        F.lit(3).alias("severity_score"), F.lit("Path Traversal").alias("type"), F.lit("remembered").alias("description"),
        F.lit("i").alias("impact"), F.lit("f").alias("fix"), F.lit(7).cast("bigint").alias("line_number"),
        labels.infer_owasp(F.lit("Path Traversal")).alias("owasp"), F.lit(0.5).alias("confidence"),
        F.lit("llm").alias("source"))
    cache = CacheTables(known, remembered) if use_cache else None
    return scan(files.select("file_path", "text"), replies, cache, **options)


@query("r15_scan_findings", f"""WITH {_SCAN}
SELECT f.file_path, f.file_hash, f.language, {_FIELDS} FROM by_hash b JOIN py_files f USING (file_hash)""")
def r15_findings(spark, d):
    return _scan(spark, d).findings


@query("p4_toggles", f"""WITH
py_files AS (SELECT file_id, file_path, sha256(text) AS file_hash FROM py_corpus), {REPLY_FINDINGS},
reps AS (SELECT file_hash, arg_min(file_id, file_path) AS resp_id FROM py_files GROUP BY file_hash)
SELECT f.file_path, f.file_hash, {_FIELDS}
FROM (SELECT *, {r.score('severity')} AS severity_score
      FROM (SELECT * FROM reply_findings UNION ALL SELECT * FROM reply_errors) u) x
JOIN reps USING (resp_id) JOIN py_files f USING (file_hash) WHERE severity_score >= 3""")
def p4(spark, d):
    """A scan without static pass and cache, at a raised threshold."""
    return _scan(spark, d, use_cache=False, use_static=False, min_severity="HIGH").findings.drop("language")


_R15_FILES = f"""{_SCAN},
rolled AS (
SELECT f.file_path, f.file_hash, f.language, f.file_hash IN (SELECT file_hash FROM cached) AS from_cache,
  {', '.join(f"CAST(count(*) FILTER (WHERE b.severity = '{s}') AS BIGINT) AS {s.lower()}" for s in fixed.SEVERITY_SCORES)},
  CAST(coalesce(sum(b.severity_score), 0) AS BIGINT) AS risk_score, CAST(count(b.ordinal) AS BIGINT) AS findings,
  {r.severity_of('max(b.severity_score)')} AS worst_severity
FROM py_files f LEFT JOIN by_hash b USING (file_hash) GROUP BY ALL)"""


@query("r15_scan_files", f"WITH {_R15_FILES} SELECT * FROM rolled")
def r15_files(spark, d):
    return _scan(spark, d).files.drop("error")


@query("r15_scan_run", f"""WITH {_R15_FILES} SELECT CAST(count(*) AS BIGINT) AS files_scanned,
  CAST(sum(findings) AS BIGINT) AS total_vulnerabilities, CAST(count(*) FILTER (WHERE from_cache) AS BIGINT) AS cache_hits,
  {', '.join(f"CAST(sum({s.lower()}) AS BIGINT) AS {s.lower()}" for s in fixed.SEVERITY_SCORES)},
  (SELECT file_path FROM rolled ORDER BY risk_score DESC, file_path LIMIT 1) AS riskiest_file,
  bool_or(critical + high > 0) AS breached FROM rolled""")
def r15_run(spark, d):
    return _scan(spark, d).run()


_SLICE = f"""{_secrets_cte('corpus', 'file_path', 'content', where=r.scannable('file_path') + " AND NOT contains(file_path, '/node_modules/')")},
scoped AS (SELECT file_path, sha256(content) AS file_hash, {r.language('file_path')} AS language FROM corpus
           WHERE {r.scannable('file_path')} AND NOT contains(file_path, '/node_modules/'))
SELECT c.file_path, c.file_hash, c.language, CAST(NULL AS VARCHAR) AS error, false AS from_cache,
  {', '.join(f"CAST(count(*) FILTER (WHERE s.severity = '{s}') AS BIGINT) AS {s.lower()}" for s in fixed.SEVERITY_SCORES)},
  CAST(coalesce(sum({r.score('s.severity')}), 0) AS BIGINT) AS risk_score, CAST(count(s.ordinal) AS BIGINT) AS findings,
  {r.severity_of(f"max({r.score('s.severity')})")} AS worst_severity
FROM scoped c LEFT JOIN secret_findings s USING (file_path) GROUP BY ALL"""


@query("flagship_corpus_rollup", f"WITH {_SLICE}")
def flagship(spark, d):
    """Secret findings per severity for every file of a corpus, clean files included."""
    in_scope = corpus(spark, d).where(
        inputs.is_scannable(F.col("file_path")) & ~in_skip_dir(F.col("file_path")))
    result = scan(in_scope.select("file_path", "text"), gate="none", patterns=PATTERNS)
    return result.files.select("file_path", "file_hash", "language", "error", "from_cache",
                               *rollups.SEVERITY_COLUMNS, "risk_score", "findings", "worst_severity")


_CHANGED = f"{r.scannable('file_path')} AND file_path IN (SELECT file_path FROM changed WHERE status IS DISTINCT FROM 'removed')"


@query("r15_scan_changes", f"""WITH {_secrets_cte('corpus', 'file_path', 'content', where=_CHANGED + ' AND file_id % 7 <> 0')},
scoped AS (SELECT file_path, file_id % 7 = 0 AS skipped FROM corpus WHERE {_CHANGED})
SELECT c.file_path, c.skipped, CAST(count(s.ordinal) AS BIGINT) AS findings
FROM scoped c LEFT JOIN secret_findings s USING (file_path) GROUP BY ALL""")
def r15_changes(spark, d):
    """A change set with base64 payloads, a seventh of them blank."""
    files = corpus(spark, d)
    payloads = files.select("file_path", F.lit("base64").alias("encoding"),
                            F.base64(F.when(F.col("file_id") % 7 == 0, F.lit(" ")).otherwise(F.col("text")).cast("binary"))
                            .alias("content"))
    done = scan_changes(view(spark, d, "changed"), payloads, gate="none", patterns=PATTERNS)
    return (done.result.files.select("file_path", F.lit(False).alias("skipped"), "findings")
            .unionByName(done.skipped.select("file_path", F.lit(True).alias("skipped"), F.lit(0).cast("bigint").alias("findings"))))
