"""Column expressions against plain-Python twins and hand-written cases."""

import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from siftwork import fixed
from siftwork.functions import labels, paths, text as tx


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    out = rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]


def words(rng, alphabet, count, longest):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(count)]


def test_file_suffix_and_language(spark):
    rng = random.Random(1)
    names = ["a.py", ".py", "a.", "a..py", "...", ".a.b", "x/.gitignore", "x.d/file", "A.PY", "..py", "d/a.tar.gz"]
    names += ["dir/" + (w or "f") for w in words(rng, "ab..Y", 3000, 7) if "/" not in w and w not in (".", "..")]
    got = column(spark, names, paths.file_suffix)
    assert got == [PurePosixPath(n).suffix.lower() for n in names]
    languages = column(spark, ["a.tf", "b.JSX", "c.md", "Makefile", ".py"], paths.detect_language)
    assert languages == ["Terraform", "JavaScript (JSX)", "Unknown", "Unknown", "Unknown"]


def test_skip_dirs_look_at_whole_components(spark):
    names = ["a/node_modules/b.js", "a/node_modules2/b.js", "build/x.py", "rebuild/x.py", "x.py"]
    assert column(spark, names, paths.in_skip_dir) == [True, False, True, False, False]


def test_strip_ws_and_split_lines(spark):
    rng = random.Random(2)
    alphabet = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
    samples = ["", "\n", "\r\n", "a\r\n", "a\n\r", "\u2028"] + words(rng, alphabet, 4000, 9)
    assert column(spark, samples, tx.strip_ws) == [s.strip() for s in samples]
    assert column(spark, samples, tx.split_lines) == [s.splitlines() for s in samples]


def test_decode_utf8(spark):
    rng = random.Random(3)
    pieces = [b"a", b"\r\n", b"\r", b"\n", "é".encode(), "漢".encode(), "🙂".encode(), b"\xff", b"\xe6\xbc", b"\xf0\x9f",
              b"\xc3", b"\x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80"]
    samples = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(3000)]
    want = [re.sub("\r\n?", "\n", s.decode("utf-8", errors="replace")) for s in samples]
    assert column(spark, [bytearray(s) for s in samples], tx.decode_utf8, "binary") == want


def test_extract_field(spark):
    rng = random.Random(4)
    parts = ["TYPE:", "FIX:", " ", "\n", "x", "y z", "\t", "\r", "\u2028", "\x1c", "LINE: 3", "\n\n"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)]

    def twin(block):
        found = re.search(r"^TYPE:\s*([^\n]+)", block, re.M)
        return found.group(1).strip() if found else ""
    assert column(spark, samples, lambda c: tx.extract_field(c, "TYPE")) == [twin(s) for s in samples]


def test_empty_and_multi_line_fields(spark):
    block = ["LINE:\nDESCRIPTION: d\nFIX: first\nsecond"]
    assert column(spark, block, lambda c: tx.extract_field(c, "LINE")) == ["DESCRIPTION: d"]
    assert column(spark, block, lambda c: tx.extract_field(c, "FIX")) == ["first"]


def test_parse_line_and_severity(spark):
    lines = ["10-15", "0", "Line 12", "N/A", " na ", "unknown", "", "x", "12.5", "99999999999999999999", "٣٤", "-7"]
    assert column(spark, lines, tx.parse_line) == [1015, None, 12, None, None, None, None, None, 125, None, 34, 7]
    names = ["critical", " High\n", "INFO", "bogus", "", "low"]
    assert column(spark, names, tx.parse_severity) == ["CRITICAL", "HIGH", "INFO", "MEDIUM", "MEDIUM", "LOW"]


def test_split_blocks(spark):
    rng = random.Random(5)
    parts = ["---", "\n", "a", "--", "-----", " ", "\n---\n"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert column(spark, samples, tx.split_blocks) == [re.split(r"\n-{3,}\n", "\n" + s.strip() + "\n") for s in samples]


def test_owasp_is_inferred_in_keyword_order(spark):
    kinds = ["Data Retrieval", "Insecure YAML Deserialization", "Embedded Private Key", "Missing Password Salting",
             "Insecure Hashing Algorithm", "SQL Injection via eval", "SSRF"]
    got = column(spark, kinds, labels.infer_owasp)
    assert [g and g[:3] for g in got] == ["A03", None, None, "A07", None, "A03", "A10"]
    kept = column(spark, ["SSRF"], lambda c: labels.fill_owasp(F.lit(""), c))
    assert kept == [""]


def test_rule_ids_and_short_forms(spark):
    kinds = ["Code Injection (eval/exec)", "Command Injection (shell=True)", "x" * 60]
    assert column(spark, kinds, labels.rule_id) == [
        "SS-CODE-INJECTION-EVAL/EXEC", "SS-COMMAND-INJECTION-SHELL=TRUE", "SS-" + "X" * 40]
    assert column(spark, ["A03:2021 – Injection", "", None], labels.owasp_short) == ["A03:2021", "—", "—"]
    assert column(spark, ["SQL  Injection Attack In Query Builder"], labels.type_key) == ["sqlinjectionattackinquery"[:24]]
    assert column(spark, list(fixed.SEVERITY_SCORES), labels.severity_score) == [4, 3, 2, 1, 0]


@pytest.mark.parametrize("link, want", [
    (" https://github.com/o/r/pull/12/files\n", ("o", "r", 12)),
    ("http://github.com/o/r/pull/7", ("o", "r", 7)),
    ("https://github.com/o/r/issues/7", None),
    ("see https://github.com/o/r/pull/7", None),
])
def test_pr_links(spark, link, want):
    got = column(spark, [link], tx.parse_pr_link)[0]
    assert (tuple(got) if got else None) == want


def test_progress_pct(spark):
    rows = spark.createDataFrame([(1, 3), (1, 8), (0, 0), (2, None)], "d bigint, t bigint")
    got = [r[0] for r in rows.select(tx.progress_pct(F.col("d"), F.col("t"))).collect()]
    assert got == [33, 13, 0, 0]
