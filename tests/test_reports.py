"""JSON and SARIF outputs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import findings, values
from siftwork.operators.rollups import file_rollup
from siftwork.plans import reports
from siftwork.plans.prompts import build_prompts


@pytest.fixture
def case(spark):
    files = spark.createDataFrame(
        [("b.py", "Python", "0123456789abcdef", False, None), ("a.py", "Python", "f" * 64, True, None),
         ("c.py", "unknown", "", False, "gone"), ("d.go", "Go", "1" * 64, False, "")],
        "file_path string, language string, file_hash string, from_cache boolean, error string")
    found = findings(spark, [
        ("b.py", 1, "LOW", "Weak Crypto", None, 0.9, "static"), ("b.py", 2, "CRITICAL", "SQL Injection", 4, 0.8, "llm"),
        ("b.py", 3, "CRITICAL", "SQL Injection", 0, 0.95, "static"), ("d.go", 1, "HIGH", "SQL Injection", 9, 0.5, "llm"),
        ("c.py", 1, "HIGH", "Ghost", 9, 0.5, "llm")])
    return file_rollup(files, found), found


def whole(path):
    """Part files in name order, as one text."""
    return "".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*")))


def nested(files, found):
    """The texts of the line report put together per file."""
    docs = {}
    for r in reports.json_report(files, found).orderBy("file_path", "rank").collect():
        text = json.loads(r["document"])
        if r["rank"] == 0:
            docs[r["file_path"]] = {**text, "vulnerabilities": []}
        else:
            assert text["file_path"] == r["file_path"] and text["rank"] == r["rank"] == len(docs[r["file_path"]]["vulnerabilities"]) + 1
            docs[r["file_path"]]["vulnerabilities"].append(text["vulnerability"])
    return docs


def test_json_texts_per_file_and_finding(case):
    docs = nested(*case)
    assert sorted(docs) == ["a.py", "b.py", "c.py", "d.go"]
    b = docs["b.py"]
    assert [(v["severity"], v["confidence"]) for v in b["vulnerabilities"]] == [("CRITICAL", 0.95), ("CRITICAL", 0.8), ("LOW", 0.9)]
    assert b["file_hash"] == "0123456789ab…" and b["error"] is None and b["risk_score"] == 9
    assert b["severity_counts"] == {"CRITICAL": 2, "HIGH": 0, "MEDIUM": 0, "LOW": 1, "INFO": 0}
    assert b["vulnerabilities"][2]["line_number"] is None and b["vulnerabilities"][2]["owasp"].startswith("A02")
    assert docs["a.py"]["vulnerabilities"] == [] and docs["a.py"]["from_cache"] is True
    assert docs["c.py"]["file_hash"] == "…" and docs["c.py"]["error"] == "gone"


def test_single_json_document(case, tmp_path):
    files, found = case
    reports.write_json_document(files, found, str(tmp_path / "doc"), "2024-01-01T00:00:00Z")
    doc = json.loads(whole(tmp_path / "doc"))
    assert doc["generated_at"] == "2024-01-01T00:00:00Z" and doc["summary"]["total_vulnerabilities"] == 5
    assert doc["summary"]["severity_counts"]["CRITICAL"] == 2 and doc["summary"]["cache_hits"] == 1
    assert {f["file_path"]: f for f in doc["files"]} == nested(files, found)
    assert [f["file_path"] for f in doc["files"]] == ["a.py", "b.py", "c.py", "d.go"]


def test_documents_of_an_empty_run(case, tmp_path):
    files, found = case
    reports.write_json_document(files.limit(0), found.limit(0), str(tmp_path / "j"), "now")
    assert json.loads(whole(tmp_path / "j"))["files"] == []
    reports.write_sarif(files.limit(0), found.limit(0), str(tmp_path / "s"), "id")
    assert json.loads(whole(tmp_path / "s" / "document"))["runs"][0]["results"] == []


def test_sarif_document(case, tmp_path):
    files, found = case
    reports.write_sarif(files, found, str(tmp_path / "s"), "scan/1", ("tool", "9", "https://example.org"))
    doc = json.loads(whole(tmp_path / "s" / "document"))
    assert doc["version"] == "2.1.0" and doc["$schema"].endswith("sarif-schema-2.1.0.json")
    run = doc["runs"][0]
    assert run["automationDetails"] == {"id": "scan/1"} and run["tool"]["driver"]["name"] == "tool"
    rules = {rule["id"]: rule for rule in run["tool"]["driver"]["rules"]}
    assert sorted(rules) == ["SS-SQL-INJECTION", "SS-WEAK-CRYPTO"]  # the unreadable file's rule is absent
    sql = rules["SS-SQL-INJECTION"]
    # Metadata comes from the first finding in reported order: b.py's worst, not the one that came first.
    assert sql["properties"] == {"tags": ["security", "static"], "precision": "high", "problem.severity": "error",
                                 "security-severity": "9.5"}
    assert sql["help"] == {"text": 'Fix: mend "it"', "markdown": '**Fix:** `mend "it"`'}
    assert sql["name"] == "SQLInjection" and sql["defaultConfiguration"] == {"level": "error"}
    results = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["ruleId"],
                r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in run["results"]]
    assert results == [("b.py", "SS-SQL-INJECTION", 1), ("b.py", "SS-SQL-INJECTION", 4), ("b.py", "SS-WEAK-CRYPTO", 1),
                       ("d.go", "SS-SQL-INJECTION", 9)]
    assert run["results"][0]["message"]["text"] == "about SQL Injection — bad"
    assert run["results"][2]["properties"] == {"owasp": "A02:2021 – Cryptographic Failures", "confidence": 0.9, "source": "static"}


def test_written_report_and_findings_table(spark, case, tmp_path):
    files, found = case
    reports.write_json_report(files, found, str(tmp_path / "r"))
    lines = [json.loads(x) for x in whole(tmp_path / "r" / "files").splitlines()]
    assert len(lines) == 4 + 5 and [(x["file_path"], x.get("rank", 0)) for x in lines] == sorted((x["file_path"], x.get("rank", 0)) for x in lines)
    reports.write_findings(found.withColumn("language", F.lit("Go")), str(tmp_path / "f"))
    reports.write_findings(found.withColumn("language", F.lit("C")), str(tmp_path / "f"))
    table = spark.read.parquet(str(tmp_path / "f"))
    assert table.count() == 10 and table.where("severity = 'CRITICAL' and language = 'C'").count() == 2


def test_prompts_hold_the_whole_text(spark):
    files = spark.createDataFrame([("h", "Go", "x {y} \n" * 50_000)], "file_hash string, language string, text string")
    prompt = build_prompts(files).first()["prompt"]
    assert "x {y} \n" * 50_000 in prompt and "in the Go source" in prompt and "NO_VULNERABILITIES" in prompt


def test_results_carry_their_rule(case):
    files, found = case
    good = reports.reportable(found, files)
    joined = reports.results_with_rules(reports.sarif_results(good), reports.sarif_rules(good))
    assert values(joined, "uri", "rule_name", "security_severity")[0] == ("b.py", "SQLInjection", "9.5")
    assert joined.count() == 4
