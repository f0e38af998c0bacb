"""The whole scan on small corpora."""

import base64

import pytest
from pyspark.sql import functions as F

from helpers import findings, texts, values
from siftwork.functions.text import fingerprint
from siftwork.operators.ordering import sort_findings
from siftwork.plans.changes import listing_counts, scan_changes
from siftwork.plans.scan import scan
from siftwork.sources.cache import CacheTables, FindingCache

ORDERS = '''import hashlib
import os


def find(db, name):
    sql = f"SELECT id FROM t WHERE n = '{name}' AND password = '{name}pw'"
    return db.execute(sql)


def digest(value):
    return hashlib.md5(value).hexdigest()


def run(name):
    os.system(f"echo {name}")


DB_PASSWORD = "orange juice"
LIVE_TOKEN = "sk-live-12"
'''

REPLY = """---
SEVERITY: CRITICAL
TYPE: SQL Injection
LINE: 6
DESCRIPTION: d
IMPACT: i
FIX: f
---
SEVERITY: HIGH
TYPE: Command  Injection
LINE: 15
---
SEVERITY: HIGH
TYPE: Insecure Hashing Algorithm
LINE: 11
---
SEVERITY: HIGH
TYPE: Hardcoded Credentials
LINE: 18
---
SEVERITY: HIGH
TYPE: Hardcoded Token
LINE: 19
---
SEVERITY: HIGH
TYPE: Missing Password Salting
LINE: 11
---
SEVERITY: MEDIUM
TYPE: Information Exposure
LINE: 3
---
SEVERITY: INFO
TYPE: Style
LINE: 1
---"""


def reply_for(files, *rows):
    """Replies by content hash from (file_path, response_text, error)."""
    spark = files.sparkSession
    given = spark.createDataFrame(list(rows), "file_path string, response_text string, error string")
    hashed = files.select("file_path", fingerprint(F.col("text")).alias("file_hash"))
    return given.join(hashed, "file_path").select("file_hash", "response_text", "error")


def test_sample_file_end_to_end(spark):
    files = texts(spark, {"orders.py": ORDERS})
    result = scan(files, reply_for(files, ("orders.py", REPLY, None)))
    ordered = [(r["severity"], r["type"], r["line_number"], r["source"])
               for r in sort_findings(result.findings, "file_path").collect()]
    assert ordered == [
        ("CRITICAL", "Command Injection", 15, "static"),
        ("CRITICAL", "SQL Injection", 6, "llm"),
        ("HIGH", "Weak Cryptographic Hash", 11, "static"),
        ("HIGH", "Hardcoded Password", 6, "static"),
        ("HIGH", "Hardcoded Password", 18, "static"),
        ("HIGH", "Insecure Hashing Algorithm", 11, "llm"),
        ("HIGH", "Hardcoded Credentials", 18, "llm"),
        ("HIGH", "Hardcoded Token", 19, "llm"),
        ("HIGH", "Missing Password Salting", 11, "llm"),
        ("MEDIUM", "Information Exposure", 3, "llm")]
    row = result.files.first()
    assert (row["critical"], row["high"], row["medium"], row["info"], row["risk_score"]) == (2, 7, 1, 0, 31)
    run = result.run("HIGH").first()
    assert run["breached"] and run["riskiest_file"] == "orders.py" and run["total_vulnerabilities"] == 10


def test_copies_are_analysed_once_under_the_smallest_path(spark):
    risky = "eval(x)\n"
    files = texts(spark, {"b/a.py": risky, "a/a.js": risky, "c.py": "exec(y)\n", "d.py": "exec(y)\n"})
    result = scan(files)
    # The JavaScript path comes first, so the shared content is not parsed as Python.
    assert values(result.findings, "file_path", "type") == [
        ("c.py", "Code Injection (eval/exec)"), ("d.py", "Code Injection (eval/exec)")]
    assert values(result.files, "file_path", "language", "from_cache", "risk_score") == [
        ("a/a.js", "JavaScript", False, 0), ("b/a.py", "Python", False, 0),
        ("c.py", "Python", False, 4), ("d.py", "Python", False, 4)]


def test_toggles_gate_and_threshold(spark):
    files = texts(spark, {"a.py": "eval(x)\npassword = 'hunter22'", "b.md": "password = 'hunter22'"})
    assert scan(files, use_static=False).findings.count() == 0
    assert values(scan(files).findings, "file_path", "line_number") == [("a.py", 1), ("a.py", 2)]
    assert values(scan(files, gate="none").findings, "file_path", "line_number") == [("a.py", 2), ("b.md", 1)]
    assert values(scan(files, min_severity="CRITICAL").findings, "line_number") == [(1,)]


def test_unreadable_files_stay_in_the_report(spark):
    files = spark.createDataFrame([("a.py", "eval(x)", None), ("b.py", None, "denied")],
                                  "file_path string, text string, error string")
    result = scan(files)
    assert values(result.files, "file_path", "file_hash", "language", "error", "findings")[1] == ("b.py", "", "unknown", "denied", 0)
    assert result.run().first()["files_scanned"] == 2


def test_failed_replies_are_reported_but_not_remembered(spark):
    files = texts(spark, {"a.py": "eval(x)", "b.py": "y = 1"})
    result = scan(files, reply_for(files, ("a.py", None, "timeout"), ("b.py", "NO_VULNERABILITIES", None)), min_severity="INFO")
    assert values(result.findings, "file_path", "type") == [("a.py", "Code Injection (eval/exec)"), ("a.py", "LLM Analysis Error")]
    assert values(result.fresh_entries, "file_path") == [("b.py",)]
    assert result.fresh_findings.count() == 0
    # The default threshold hides the error finding.
    hidden = scan(files, reply_for(files, ("a.py", None, "timeout")))
    assert values(hidden.findings, "type") == [("Code Injection (eval/exec)",)]


def test_cached_contents_are_not_analysed_again(spark, tmp_path):
    store = FindingCache(spark, str(tmp_path / "cache"))
    first = scan(texts(spark, {"a.py": "eval(x)", "clean.py": "y = 1"}), cache=store)
    assert values(first.files, "file_path", "from_cache") == [("a.py", False), ("clean.py", False)]
    store.put(first.fresh_entries, first.fresh_findings)
    # Same contents under other paths; one new file.  The language is that of the path at hand.
    again = scan(texts(spark, {"z.js": "eval(x)", "y.py": "y = 1", "new.py": "exec(z)"}), cache=store)
    assert values(again.files, "file_path", "language", "from_cache", "risk_score") == [
        ("new.py", "Python", False, 4), ("y.py", "Python", True, 0), ("z.js", "JavaScript", True, 4)]
    assert values(again.fresh_entries, "file_path") == [("new.py",)]
    assert again.run().first()["cache_hits"] == 2


def test_cache_keeps_unfiltered_findings(spark):
    files = texts(spark, {"a.py": "password = 'hunter22'"})
    strict = scan(files, min_severity="CRITICAL")
    assert strict.findings.count() == 0 and strict.fresh_findings.count() == 1
    known = CacheTables(strict.fresh_entries, strict.fresh_findings)
    assert scan(files, cache=known, min_severity="LOW").findings.count() == 1


def test_merge_happens_per_content(spark):
    files = texts(spark, {"a.py": "eval(x)"})
    reply = "\n---\nSEVERITY: LOW\nTYPE: code injection (EVAL/exec) again\n---\n"
    found = scan(files, reply_for(files, ("a.py", reply, None))).findings
    assert values(found, "source") == [("static",)]
    assert findings(spark, [("a", 1, "LOW", "T", 1, 0.5, "llm")]).count() == 1


def test_change_set(spark):
    listing = spark.createDataFrame(
        [("a.py", "added"), ("gone.py", "removed"), ("blank.py", "modified"), ("missing.py", None), ("n.md", "added")],
        "file_path string, status string")
    payloads = spark.createDataFrame(
        [("a.py", "base64", base64.b64encode(b"eval(x)").decode()), ("blank.py", "base64", base64.b64encode(b" \n").decode()),
         ("gone.py", "base64", base64.b64encode(b"eval(x)").decode())], "file_path string, encoding string, content string")
    replies = reply_for(texts(spark, {"a.py": "eval(x)"}), ("a.py", None, "timeout"))
    done = scan_changes(listing, payloads, replies, min_severity="INFO")
    assert values(done.result.findings, "file_path", "type") == [("a.py", "Code Injection (eval/exec)")]
    assert values(done.result.failed_replies, "file_path", "error") == [("a.py", "timeout")]
    assert values(done.skipped, "file_path") == [("blank.py",), ("missing.py",)]
    assert tuple(listing_counts(listing).first()) == (5, 3)


def test_unknown_gate_is_refused(spark):
    with pytest.raises(ValueError):
        scan(texts(spark, {"a.py": ""}), gate="perl")
