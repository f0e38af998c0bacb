"""What a content is, what the cache remembers of it, and which finding speaks for a rule."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwork.operators.secrets import SecretPattern, hit_codes
from siftwork.plans import reports
from siftwork.plans.scan import scan
from siftwork.sources import inputs
from siftwork.sources.cache import CacheTables, FindingCache, findings_from_json
from siftwork.streaming import progress

REPLY = "SEVERITY: HIGH\nTYPE: Open Redirect\nLINE: 3\nDESCRIPTION: d\nIMPACT: i\nFIX: f"


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file_path string, text string")


def replies(spark, rows):
    return spark.createDataFrame(rows, inputs.REPLY_SCHEMA)


def by_hash(result):
    return sorted((r.file_hash, r.type) for r in result.by_hash.select("file_hash", "type").collect())


@pytest.mark.parametrize("gate", ["python", "none"])
def test_texts_of_one_path_keep_their_own_findings(spark, gate):
    first = 'API_KEY = "sk_live_abcdefghijklmnop"\n' + "eval(x)\n" * (gate == "python")
    files = texts(spark, ("setup.py", first), ("setup.py", "print(1)\n"), ("copy.py", first))
    result = scan(files, gate=gate)
    hashes = {r.file_hash for r in result.by_hash.collect()}
    expected = inputs.with_identity(texts(spark, ("a.py", first)).withColumn("error", F.lit(None).cast("string"))).first().file_hash
    assert hashes == {expected}
    assert {r.file_hash for r in result.fresh_findings.collect()} == {expected}


def test_no_text_is_shuffled(spark):
    plan = scan(texts(spark, ("a.py", "eval(x)\n"))).by_hash._jdf.queryExecution().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert not any("text" in x for x in exchanges)


def test_cache_knows_which_passes_it_holds(spark, tmp_path):
    files = texts(spark, ("a.py", "eval(x)\n"), ("b.py", "print(2)\n"))
    cache = FindingCache(spark, str(tmp_path / "cache"))
    first = scan(files, cache=cache)
    cache.put(first.fresh_entries, first.fresh_findings)
    assert scan(files, cache=cache).files.where("not from_cache").count() == 0
    hashes = {r.file_path: r.file_hash for r in first.manifest.collect()}
    second = scan(files, replies(spark, [(hashes["a.py"], REPLY, None)]), cache)
    assert second.files.where("from_cache").count() == 0
    assert by_hash(second) == sorted([(hashes["a.py"], "Code Injection (eval/exec)"), (hashes["a.py"], "Open Redirect")])
    cache.put(second.fresh_entries, second.fresh_findings)
    third = scan(files, replies(spark, [(hashes["b.py"], REPLY, None)]), cache)
    assert {(r.file_path, r.from_cache) for r in third.files.collect()} == {("a.py", True), ("b.py", False)}
    assert (hashes["b.py"], "Open Redirect") in by_hash(third)
    # Without the static pass, what it found alone is no answer.
    assert scan(files, use_static=False, replies=replies(spark, []), cache=CacheTables(first.fresh_entries, first.fresh_findings)
                ).files.where("from_cache").count() == 0


def test_one_reply_counts(spark):
    files = texts(spark, ("a.js", "x"))
    key = scan(files).manifest.first().file_hash
    result = scan(files, replies(spark, [(key, None, "timeout"), (key, REPLY, None), (key, REPLY + "\nmore", None)]))
    assert [(r.type, r.ordinal) for r in result.by_hash.collect()] == [("Open Redirect", result.by_hash.first().ordinal)]
    assert result.by_hash.count() == 1


def test_raw_payloads_are_scanned(spark):
    rows = [("a.py", "none", None, "eval(x)"), ("b.py", "base64", "cHJpbnQoMSk=", None), ("c.py", None, None, None)]
    got = inputs.decode_payload(spark.createDataFrame(rows, "file_path string, encoding string, content string, text string"))
    assert {(r.file_path, r.text) for r in got.collect()} == {("a.py", "eval(x)"), ("b.py", "print(1)"), ("c.py", "")}


def test_payloads_decode_as_their_cleaned_form(spark):
    """Line ends, blanks and stray characters anywhere, broken padding and cut payloads."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        packed = list(base64.b64encode(rng.randbytes(rng.randrange(12))).decode()[:rng.choice([99, 99, 99, 7, 5])])
        for _ in range(rng.randrange(4)):
            packed.insert(rng.randrange(len(packed) + 1), rng.choice(["\r\n", "\n", " ", "\t", "\x1c", "\u2028", "\u00a0", "-", "é", "=", "A"]))
        rows.append((i, "base64", "".join(packed)))
    payloads = spark.createDataFrame(rows, "file_id int, encoding string, content string")
    cleaned = payloads.withColumn("content", F.regexp_replace("content", "[^A-Za-z0-9+/=]", ""))
    got, want = ({r.file_id: r.text for r in inputs.decode_payload(df).collect()} for df in (payloads, cleaned))
    assert got == want and sum(t != "" for t in got.values()) > 1000


def test_large_payloads_decode_quickly(spark):
    lines = base64.encodebytes(b"plain text of a file\n" * 57).decode()
    payloads = spark.range(0, 48, 1, 4).select(F.lit("base64").alias("encoding"), F.repeat(F.lit(lines), 900 + (F.col("id") % 2).cast("int")).alias("content"))
    began = time.time()
    texts_read = inputs.decode_payload(payloads).agg(F.sum(F.length("text"))).first()[0]
    assert texts_read == 24 * (900 + 901) * 21 * 57 and time.time() - began < 4.5


def test_broken_cache_json_is_no_clean_result(spark):
    rows = spark.createDataFrame([("h", '[{"severity": ')], "file_hash string, vulnerabilities string")
    with pytest.raises(Exception):
        findings_from_json(rows, "file_hash").collect()


def test_rules_follow_the_reported_order(spark):
    found = scan(texts(spark, ("a.py", 'import os\nos.popen(c)\nos.system(f"x {c}")\n'))).findings
    worst = found.orderBy(F.desc("severity_score"), F.desc("confidence"), "ordinal").first()
    assert reports.sarif_rules(found).first().full_description == worst.description


def test_many_patterns_of_one_type_plan_quickly(spark):
    patterns = [SecretPattern(f"tok{i}_[a-z]+", "Token", "HIGH") for i in range(300)]
    frame = spark.createDataFrame([("x tok7_ab tok8_cd\nnone\ntok8_zz",)], "text string")
    began = time.time()
    codes = frame.select(hit_codes(F.col("text"), patterns).alias("c")).first().c
    assert len(codes) == 2 and time.time() - began < 60


def test_scan_results_become_events(spark, monkeypatch):
    monkeypatch.setattr(progress, "EVENT_FINDINGS", 2)
    many = "eval(x)\n" * 5
    files = spark.createDataFrame([("a.py", many, None), ("b.py", "print(2)\n", None), ("c.py", None, "denied")],
                                  "file_path string, text string, error string")
    replies = texts(spark, ("b.py", "print(2)\n")).select(
        F.sha2("text", 256).alias("file_hash"), F.lit(None).cast("string").alias("response_text"), F.lit("timeout").alias("error"))
    result = scan(files, replies)
    events = progress.scan_result_events(5, result.files, result.findings, result.failed_replies)
    events = progress.parse_events(events.select(F.to_json(F.struct("*")).alias("value")))
    told = [(r.type, r.file, r["index"], r.total, r.findings, r.vulns and len(r.vulns)) for r in events.orderBy("seq").collect()]
    assert told == [
        ("file_start", "a.py", 0, 3, None, None), ("file_done", "a.py", None, None, 5, 2), ("file_done", "a.py", None, None, 5, 2),
        ("file_done", "a.py", None, None, 5, 1), ("file_start", "b.py", 1, 3, None, None), ("log", "b.py", None, None, None, None),
        ("file_done", "b.py", None, None, 0, []), ("file_start", "c.py", 2, 3, None, None), ("file_skip", "c.py", None, None, None, None),
        ("complete", None, None, None, None, None)]
    assert [r.text for r in events.where("level = 'warning'").collect()] == ["LLM failed for b.py: timeout"]
    states = {r.file: (r.status, r.findings) for r in progress.file_progress(events).collect()}
    assert states == {"a.py": ("done", 5), "b.py": ("clean", 0), "c.py": ("skip", 0)}
    assert progress.scan_progress(events).first()["pct"] == 100
    assert progress.event_findings(events).count() == result.findings.count() == 5
    counts = progress.completion_counts(events).first()
    assert (counts.total_files, counts.total_findings, counts.critical + counts.high) == (2, 5, 5)
    broken = progress.error_event(spark, 5, 9, "boom", "trace")
    assert progress.scan_status(broken).first()["message"] == "boom"
    nothing = progress.scan_result_events(6, result.files.limit(0), result.findings.limit(0))
    assert [(r.type, r.total_files, r.total_findings) for r in nothing.collect()] == [("complete", 0, 0)]


def test_findings_table_is_dealt_by_folder(spark, tmp_path):
    many = texts(spark, *[(f"d/f{i}.py", f"eval(x{i})\n") for i in range(40)]).repartition(8)
    found = scan(many).findings
    assert {r.language for r in found.collect()} == {"Python"}
    reports.write_findings(found.repartition(8), str(tmp_path / "t"))
    folders = list((tmp_path / "t").glob("language=*/severity=*"))
    assert folders and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40
