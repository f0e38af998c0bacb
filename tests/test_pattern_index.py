"""Many line patterns: the index gives what trying every pattern gives."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.operators import pattern_index, secrets
from siftwork.operators.pattern_index import required_factor, starts_with_factor
from siftwork.operators.secrets import BUILTIN_PATTERNS, SecretPattern
from siftwork.schema import FINDING_COLUMNS


@pytest.mark.parametrize("pattern, factor", [
    ("sk-live-[a-z]+", "sk-live-"), ("(?i)PassWord\\s*=", "password"), ("abc?defg", "defg"), ("abcd*", "abc"), ("abcd{0,3}xyz", "abc"),
    ("ab|cdefg", None), ("(abcdef|x)yzw", "yzw"), ("(?:abcdef)?yz", None), ("[abcdef]ghi", "ghi"), ("a\\.b\\-c", "a.b-c"), ("\\x41bcdef", None),
    ("\\Qabc\\E", None), ("(?u)abcdef", None), ("abc(?i)def", None), ("^tok_[0-9]$", "tok_"), ("ab+cde", "cde"), ("x[]]abc", None), ("abc\\1def", None),
    ("", None), ("(?!abcdef)ghijk", "ghijk"), ("[a[b]]cdef", "cdef"), ("abc\\|def", "abc|def"), ("a\nbcd", None)])
def test_required_factor(pattern, factor):
    assert required_factor(pattern) == factor


def test_factors_are_in_every_hit():
    """Patterns made at random; what they match is searched in texts made from their letters."""
    rng = random.Random(2)
    atoms = ["a", "b", "Ab", "ba", "c?", "a*", "b+", "(ab)", "(?:a|b)", "[ab]", "[^a]", "a{2}", "b{0,1}", "\\.", ".", "(a)?", "ab?c"]
    checked = 0
    for _ in range(4000):
        pattern = rng.choice(["", "(?i)"]) + "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 9)))
        factor = required_factor(pattern)
        if factor is None:
            continue
        for _ in range(10):
            found = re.search(pattern, "".join(rng.choice("aAbBc.") for _ in range(30)))
            if found:
                checked += 1
                assert factor in found[0].lower(), (pattern, factor)
    assert checked > 300


@pytest.mark.parametrize("pattern, at_start", [
    ("(?i)word[a-z]+ [^,.]", True), ("abc*d", True), ("abcx?", True), ("[ab]cdef", False), ("ab?cdef", False), ("abcd$", False),
    ("abcd(?<=xabcd)e", False), ("abc[0-9]defgh", False), ("^abcd", False), ("abcd\\b", False)])
def test_hits_that_start_with_their_factor(pattern, at_start):
    assert starts_with_factor(pattern) == at_start


def random_case(seed, n_patterns):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeXYZ_é") for _ in range(rng.randrange(3, 8))) for _ in range(n_patterns)]
    shapes = ["{}", "(?i){}", "{}[0-9]*x?", "^{}", "{}$", "(?:{}|zz)q", "{}\\s*=", "[{}]{{9}}"]
    patterns = [SecretPattern(rng.choice(shapes).format(w), f"T{i % 5}", rng.choice(["LOW", "HIGH"])) for i, w in enumerate(words)]
    ends = ["\n", "\r\n", "\x0b", "\u2028", "\x85"]
    texts = ["".join(rng.choice([rng.choice(words), rng.choice(words).upper(), "q", " = ", "7x", "ſK"]) + rng.choice([" ", " ", *ends])
                     for _ in range(rng.randrange(60))) for _ in range(60)]
    return patterns, [(i, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (None, words[0])]


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 5)])
def test_index_equals_trying_every_pattern(spark, seed, n):
    patterns, rows = random_case(seed, n)
    files = spark.createDataFrame(rows, "file_id long, text string")
    by = lambda df, *c: sorted((tuple(map(str, r)) for r in df.select(*c).collect()))
    columns = ["file_id", "line_number", "pattern_idx"]
    plain = by(secrets.secret_hits(files, "file_id", patterns=patterns), *columns)
    assert by(pattern_index.indexed_hits(files, "file_id", patterns=patterns), *columns) == plain
    assert len(plain) > 100 * (n > 10)
    columns = ["file_id", *FINDING_COLUMNS]
    assert (by(pattern_index.indexed_findings(files, "file_id", patterns=patterns), *columns)
            == by(secrets.secret_findings(files, "file_id", patterns=patterns), *columns))


def test_builtin_patterns_through_the_index(spark):
    rows = [(1, 'password = "hunter22"\nx'), (2, 'AWS_SECRET_ACCESS_KEY="wJalrXUtnFEMI"'), (3, "-----BEGIN RSA PRIVATE KEY-----")]
    files = spark.createDataFrame(rows, "file_id long, text string")
    by = lambda df: sorted(tuple(map(str, r)) for r in df.select("file_id", *FINDING_COLUMNS).collect())
    assert by(pattern_index.indexed_findings(files, "file_id", patterns=BUILTIN_PATTERNS)) == by(
        secrets.secret_findings(files, "file_id", patterns=BUILTIN_PATTERNS)) != []


def test_thousands_of_patterns_plan_and_run_quickly(spark):
    patterns = [SecretPattern(f"tok{i:04d}_[a-z]+=", f"Token {i}", "HIGH") for i in range(5000)]
    files = spark.range(400).select(F.col("id").alias("file_id"), F.concat(
        F.lit("plain line\n" * 50), F.lit("tok"), F.lpad((F.col("id") * 11).cast("string"), 4, "0"), F.lit("_ab=1\ntok0007_=")).alias("text"))
    began = time.time()
    found = pattern_index.indexed_findings(files, "file_id", patterns=patterns).select("file_id", "line_number", "type").collect()
    assert {tuple(r) for r in found} == {(i, 51, f"Token {11 * i}") for i in range(400)} and time.time() - began < 40


def test_lines_with_many_candidates_stay_small(spark, monkeypatch):
    """Long texts whose lines may hit hundreds of patterns each: memory follows the text, not text times candidates."""
    words = [f"word{i:03d}" for i in range(400)]
    text = "\n".join(" ".join(words) for _ in range(40))
    batch = pa.RecordBatch.from_pydict({"file_id": list(range(20)), "_text": [text] * 20})
    files = spark.createDataFrame([(1, text)], "file_id long, text string")
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: run)
    run = pattern_index.candidate_lines(files, "file_id", factors=words)
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
    finally:
        pa.set_memory_pool(before)
    assert rows == 20 * 40 and pool.max_memory() < 40 << 20


def test_candidate_lines_are_not_shuffled(spark, capsys):
    files = spark.range(9).select(F.col("id").alias("file_id"), F.lit("tok1_ab tok2_cd").alias("text"))
    hits = pattern_index.indexed_hits(files, "file_id", patterns=[SecretPattern(f"tok{i}_[a-z]", "T", "LOW") for i in range(2000)])
    hits.explain()
    assert "hashpartitioning" not in capsys.readouterr().out and hits.count() == 18


def test_hits_behind_the_first_factor_and_other_scripts(spark):
    rows = [(1, "é𝄞 word, WORDing ok"), (2, "é𝄞 swordx, word"), (3, "\U0001d11e wordWord b\nword\r\nWORDs c"), (4, "words ,")]
    files = spark.createDataFrame(rows, "file_id long, text string")
    patterns = [SecretPattern(p, p, "LOW") for p in ("(?i)word[a-z]+ [^,.]", "(?i)word", "WORD", "(?i)ord[a-z]+ [bc]", "x?word$", "(?<!s)word")]
    by = lambda df: sorted(tuple(r) for r in df.select("file_id", "line_number", "pattern_idx").collect())
    found = by(pattern_index.indexed_hits(files, "file_id", patterns=patterns))
    assert found == by(secrets.secret_hits(files, "file_id", patterns=patterns)) and (1, 1, 0) in found and (3, 3, 0) in found
