"""Files read in pieces, and texts that need no parsing."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import membership
from siftwork.plans import scan as scan_module
from siftwork.plans.scan import scan
from siftwork.sources import tree
from siftwork.sources.cache import CacheTables
from siftwork.sources.inputs import decode_text, with_identity

KEY = 'API_KEY = "sk_live_abcdefghijklmnop"'


def normal(data):
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_pieces_add_up_to_the_text(size):
    rng = random.Random(size)
    atoms = [b"a", b"\n", b"\r", b"\r\n", "é".encode(), "語😀".encode(), b"\xff", b"\xe8\xaa", b"\x0b", " ".encode(), b"x" * 50]
    for _ in range(60):
        data = b"".join(rng.choice(atoms) for _ in range(rng.randrange(40)))
        pieces = list(tree._text_pieces(io.BytesIO(data), size))
        text = normal(data)
        assert "".join(p[2] for p in pieces) == text
        assert [p[3] for p in pieces] == [False] * (len(pieces) - 1) + [True]
        assert pieces[-1][4] == hashlib.sha256(text.encode()).hexdigest()
        numbered = [(p[1] + i, line) for p in pieces for i, line in enumerate(p[2].splitlines())]
        assert numbered == list(enumerate(text.splitlines(), 1))


def test_a_line_beyond_any_piece_is_cut_with_an_overlap():
    data = b"first\n" + b"0123456789" * 30 + b"\nlast"
    pieces = list(tree._text_pieces(io.BytesIO(data), 16, line_chars=64, overlap=20))
    long = [p[2] for p in pieces if p[1] == 2]
    assert len(long) > 3 and all(a[-20:] == b[:20] for a, b in zip(long, long[1:]) if not a.endswith("\n"))
    tail = pieces[-1][2].splitlines()
    assert (pieces[-1][1] + len(tail) - 1, tail[-1]) == (3, "last")
    assert pieces[-1][4] == hashlib.sha256(data).hexdigest()


@pytest.fixture
def some_tree(tmp_path):
    rng = random.Random(1)
    root = tmp_path / "tree"
    for i in range(12):
        lines = [rng.choice([KEY, "plain", "größe = 1", "x" * 90, "", 'token = "' + "a" * 30 + '"']) for _ in range(rng.randrange(1, 40))]
        path = root / f"d{i % 3}" / f"f{i}{'.py' if i % 2 else '.js'}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rng.choice(["\n", "\r\n"]).join(lines).encode())
    (root / "empty.py").write_bytes(b"")
    (root / "bad.js").write_bytes(b"\xff\r" + KEY.encode())
    (root / "gone.py").symlink_to(root / "nowhere")
    return root


def test_small_pieces_give_what_whole_files_give(spark, some_tree):
    whole = scan(with_identity(decode_text(tree.read_source_tree(spark, [some_tree]))).drop("file_hash", "language"), gate="none")
    pieces = tree.read_pieces(spark, [some_tree], piece_bytes=64)
    assert pieces.where("not last").count() > 20
    split = scan(pieces, gate="none")
    names = ["file_path", "file_hash", "ordinal", "type", "line_number"]
    rows = lambda df, *cols: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert rows(split.findings, *names) == rows(whole.findings, *names) != []
    assert rows(split.files, "file_path", "file_hash", "language", "risk_score") == rows(whole.files, "file_path", "file_hash", "language", "risk_score")
    assert {r.file_path.split("/")[-1] for r in split.files.where("error is not null").collect()} == {"gone.py"}


def test_a_file_of_several_pieces_is_not_parsed(spark, tmp_path):
    (tmp_path / "small.py").write_text("eval(x)\n")
    (tmp_path / "large.py").write_text("eval(x)\n" * 50)
    result = scan(tree.read_pieces(spark, [tmp_path], piece_bytes=64))
    assert [r.file_path.split("/")[-1] for r in result.findings.collect()] == ["small.py"]
    assert result.files.where("error is not null").count() == 0


def test_no_file_is_too_large(spark, tmp_path, monkeypatch):
    (tmp_path / "a.js").write_text("x\n" * 2000 + KEY)
    assert tree.load_contents(tree.list_files(spark, [tmp_path / "a.js"]), max_file_bytes=100).first().error
    result = scan(tree.read_pieces(spark, [tmp_path], piece_bytes=100), gate="none")
    assert [(r.line_number, r.type) for r in result.findings.collect()] == [(2001, "Hardcoded API Key")]


@pytest.mark.parametrize("cached", [0, 99, 100])
def test_known_contents_and_copies_are_not_parsed(spark, monkeypatch, cached):
    files = spark.range(300).select(
        F.format_string("p%03d.py", "id").alias("file_path"),
        F.concat(F.lit("eval(x)\ny = "), (F.col("id") % 100).cast("string"), F.lit("\n")).alias("text"))
    hashes = with_identity(files.withColumn("error", F.lit(None).cast("string"))).where(f"file_path < 'p{cached:03d}.py'").select("file_hash").distinct()
    entries = hashes.select("file_hash", F.lit("old").alias("file_path"), F.lit("Python").alias("language"),
                            F.current_timestamp().alias("scanned_at"), F.lit(None).cast("string").alias("passes"))
    full = scan(files)
    known = CacheTables(entries, full.by_hash.join(hashes, "file_hash", "left_semi"))
    parsed = []
    real = scan_module.static_sites
    monkeypatch.setattr(scan_module, "static_sites", lambda texts, *k, **o: (parsed.append(texts.count()), real(texts, *k, **o))[1])
    again = scan(files, cache=known)
    # 300 rows of 100 contents: one row per unknown content, and at most a few by chance.
    assert 100 - cached <= parsed[0] <= 1.3 * (100 - cached) + 12
    rows = lambda r: sorted((x.file_path, x.file_hash, x.type, x.line_number) for x in r.findings.collect())
    assert rows(again) == rows(full) and len(rows(full)) == 300


def test_the_filter_loses_no_key_and_stays_bounded(spark, monkeypatch):
    keys = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("_bits2"))
    passed = {r.k for r in membership.that_may_match(rows, keys, "k").collect()}
    assert {None, *range(1, 5000)} <= passed and len(passed) < 5000 + 0.12 * 95_000
    monkeypatch.setattr(membership, "MOST_BITMAPS", 1)
    assert membership.key_filter(keys, membership.bitmaps_for(10 ** 9), "k").count() == 1
    assert {r.k for r in membership.that_may_match(rows, keys, "k").collect()} >= {None, *range(1, 5000)}
    assert membership.that_may_match(rows, keys.limit(0), "k").count() == 0
