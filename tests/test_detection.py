"""Risky calls, secrets, gates and replies."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import texts, values
from siftwork import fixed
from siftwork.operators.callsites import call_sites
from siftwork.operators.replies import parse_replies, reply_errors, reply_findings
from siftwork.operators.secrets import (
    BUILTIN_PATTERNS, SecretPattern, _may_prefilter, patterns_from_table, secret_findings, text_may_hit)
from siftwork.plans.scan import static_findings

# source -> findings as (type, line, confidence)
RULE_CASES = {
    # code injection
    "x = 1\neval(data)": [("Code Injection (eval/exec)", 2, 0.97)],
    "exec(data)": [("Code Injection (eval/exec)", 1, 0.97)],
    "builtins.eval(data)": [],
    "ast.literal_eval(data)": [],
    "run = eval\nrun(data)": [],
    # command injection
    "import os\nos.system(f'rm {x}')": [("Command Injection", 2, 0.98)],
    "os.popen(cmd)": [("Command Injection", 1, 0.80)],
    "os.system()": [("Command Injection", 1, 0.80)],
    "from os import system\nsystem(cmd)": [],
    "self.os.system(cmd)": [],
    # shell=True
    "subprocess.run(c, shell=True)": [("Command Injection (shell=True)", 1, 0.92)],
    "subprocess.Popen(c,\n  shell=True)": [("Command Injection (shell=True)", 1, 0.92)],
    "subprocess.run(c, shell=flag)": [],
    "subprocess.run(c, shell=1)": [],
    "sp.run(c, shell=True)": [],
    "subprocess.check_call(c, shell=True)": [],
    # SQL
    "cur.execute(f'select {x}')": [("SQL Injection", 1, 0.98)],
    "a.b().execute('select %s' % x)": [("SQL Injection", 1, 0.90)],
    "cur.execute('select {}'.format(x))": [("SQL Injection", 1, 0.90)],
    "q = f'select {x}'\ncur.execute(q)": [],
    "cur.execute('select ' + x)": [],
    "cur.execute(sql=f'{x}')": [],
    "execute(f'{x}')": [],
    "cur.executemany(f'{x}', r)": [],
    # hashes
    "hashlib.md5(x).hexdigest()": [("Weak Cryptographic Hash", 1, 0.88)],
    "hashlib.sha1()": [("Weak Cryptographic Hash", 1, 0.88)],
    "hashlib.sha256(x)": [],
    "from hashlib import md5\nmd5(x)": [],
    # deserialisation
    "pickle.loads(b)": [("Insecure Deserialization", 1, 0.92)],
    "pickle.load(f)": [],
    "import pickle as p\np.loads(b)": [],
    "yaml.load(f)": [("Insecure YAML Deserialization", 1, 0.95)],
    "yaml.load(f, SafeLoader)": [("Insecure YAML Deserialization", 1, 0.95)],
    "yaml.load(f, Loader=SafeLoader)": [],
    "yaml.load(f, **options)": [("Insecure YAML Deserialization", 1, 0.95)],
    "yaml.safe_load(f)": [],
    # one per type and line; nested calls keep source order
    "eval(a); eval(b)": [("Code Injection (eval/exec)", 1, 0.97)],
    "eval(exec(a))\nos.system(c); os.popen(f'{c}')": [
        ("Code Injection (eval/exec)", 1, 0.97), ("Command Injection", 2, 0.80)],
    # secrets need a text that parses
    "password = 'hunter22'": [("Hardcoded Password", 1, 0.88)],
    "password = 'hunter22'\ndef broken(:": [],
    "\ufeffpassword = 'hunter22'": [],
    "password = 'hunter22'\x00": [],
    "if x:\n  pwd=\"abcd\"; API_KEY = 'abcdefgh'": [("Hardcoded API Key", 2, 0.88), ("Hardcoded Password", 2, 0.88)],
    "": [],
}


def test_static_rules(spark):
    cases = {f"f{i}.py": source for i, source in enumerate(RULE_CASES)}
    got = {}
    for row in static_findings(texts(spark, cases), "file_path").collect():
        got.setdefault(row["file_path"], []).append((row["type"], row["line_number"], row["confidence"]))
    for path, source in cases.items():
        assert sorted(got.get(path, [])) == sorted(RULE_CASES[source]), source


def test_first_call_on_a_line_supplies_the_text(spark):
    row = static_findings(texts(spark, {"a.py": "os.popen(f'{x}'); os.system(y)"}), "file_path").first()
    assert row["description"].startswith("os.popen()") and row["confidence"] == 0.98
    assert row["owasp"].startswith("A03") and row["source"] == "static"


def test_odd_sources_do_not_fail_the_job(spark):
    deep = "(" * 5000 + ")" * 5000
    long_chain = "x = " + "-" * 20000 + "1"
    sites = call_sites(texts(spark, {"deep.py": deep, "chain.py": long_chain, "nul.py": "a\0b", "ok.py": "f(g())"}), "file_path")
    rows = values(sites.where("call_seq >= 0"), "file_path", "func_name", "call_seq")
    assert rows == [("ok.py", "f", 0), ("ok.py", "g", 1)]
    bad = {r[0] for r in values(sites.where("parse_error is not null"), "file_path")}
    assert {"deep.py", "nul.py"} <= bad


def secret_twin(text):
    found = set()
    for number, line in enumerate(text.splitlines(), 1):
        for pattern, kind, _ in fixed.SECRET_PATTERNS:
            if re.search(pattern, line):
                found.add((kind, number))
    return found


def test_secret_patterns_match_the_python_dialect(spark):
    rng = random.Random(6)
    parts = ["password", "PASSWD", "paſſword", "pwd", "api_key", "apiKey", "apı_key", "APİKEY", "secretkey", "seCret_Key", "access_token",
             "authtoken", "aws_secret_access_key", "AWS_SECRET_ACCESS_\u212aEY", "=", " = ", "\u00a0=\u2003", "\x1f=",
             "\x1c=", "\n", "\r", "\u2028", "'", '"', "abcd", "abcdefgh", "x", "'abcdefgh'", '"ab"', "'漢字漢字'", "'🙂🙂🙂'",
             "sk-", "sk-" + "a1" * 10, "sk-" + "a" * 19, "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----",
             "-----BEGIN DSA PRIVATE KEY-----", " ", "==", ";"]
    cases = {f"{i}": "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for i in range(6000)}
    cases["spans"] = "password = 'a\nbcdef'"
    got = {}
    for row in secret_findings(texts(spark, cases), "file_path").collect():
        got.setdefault(row["file_path"], set()).add((row["type"], row["line_number"]))
    hits = 0
    for path, text in cases.items():
        assert got.get(path, set()) == secret_twin(text), repr(text)
        hits += bool(got.get(path))
    assert hits > 300


def test_user_patterns_with_anchors_are_not_prefiltered(spark):
    assert _may_prefilter(r'token = "[^"]+"') and not _may_prefilter(r"^token") and not _may_prefilter(r"\btoken")
    assert not _may_prefilter(r"(?<=a)b") and not _may_prefilter("a++b")
    anchored = [SecretPattern(r"^token = \S+$", "Token Line", "LOW")]
    assert text_may_hit(F.lit("x"), anchored) is None
    found = secret_findings(texts(spark, {"a": "x\ntoken = abc\n", "b": "x token = abc"}), "file_path", patterns=anchored)
    assert values(found, "file_path", "type", "line_number", "severity") == [("a", "Token Line", 2, "LOW")]


def test_patterns_from_a_table(spark):
    table = spark.createDataFrame([(1, "b+", "B", "LOW"), (0, "a+", "A", "HIGH")],
                                  "pattern_idx int, pattern string, type string, severity string")
    assert [p.type for p in patterns_from_table(table)] == ["A", "B"]
    many = spark.range(5000).selectExpr("id as pattern_idx", "'x' as pattern", "'T' as type", "'LOW' as severity")
    assert len(patterns_from_table(many)) == 5000
    with pytest.raises(ValueError):
        patterns_from_table(many.limit(0))


def test_patterns_sharing_a_type_give_one_finding_per_line(spark):
    both = [SecretPattern("aa", "T", "LOW"), SecretPattern("ab", "T", "HIGH"), BUILTIN_PATTERNS[0]]
    for gate in ("none", "python"):
        found = static_findings(texts(spark, {"f": "x = 'aab'\ny = 'ab'"}), "file_path", gate=gate, patterns=both)
        assert values(found, "line_number", "severity") == [(1, "LOW"), (2, "HIGH")]


REPLY = """Sure:
---
SEVERITY: high
TYPE: SQL Injection
LINE: Line 12
DESCRIPTION: d1
IMPACT: i1
FIX: one
two
---
SEVERITY: nonsense
TYPE: Open Redirect
LINE: N/A
---
---
TYPE: No Severity
-----
SEVERITY: INFO
TYPE: Chatty
LINE: 0
---"""


def replies(spark, *rows):
    return spark.createDataFrame(rows, "file_hash string, response_text string, error string")


def test_reply_blocks_to_findings(spark):
    rows = values(parse_replies(replies(spark, ("h", REPLY, None)), "file_hash"),
                  "ordinal", "severity", "type", "line_number", "fix", "description", "confidence", "source")
    assert [r[1:] for r in rows] == [
        ("HIGH", "SQL Injection", 12, "one", "d1", 0.80, "llm"),
        ("MEDIUM", "Open Redirect", None, "", "", 0.80, "llm"),
        ("INFO", "Chatty", None, "", "", 0.80, "llm")]


@pytest.mark.parametrize("text", ["NO_VULNERABILITIES", "x no_vulnerabilities\n" + REPLY, "", "nothing here"])
def test_replies_without_findings(spark, text):
    assert reply_findings(replies(spark, ("h", text, None)), "file_hash").count() == 0


def test_failed_replies_become_one_info_finding(spark):
    failed = reply_errors(replies(spark, ("a", None, "timeout"), ("b", None, None), ("c", REPLY, None)), "file_hash")
    assert values(failed, "file_hash", "severity", "type", "description", "confidence") == [
        ("a", "INFO", "LLM Analysis Error", "LLM analysis failed: timeout", 1.0),
        ("b", "INFO", "LLM Analysis Error", "LLM analysis failed: empty reply", 1.0)]
