"""Reading trees, files, listings, payloads and the cache folder."""

import base64
import gzip
import hashlib
import json
import os
import shutil
import time
from urllib.parse import unquote

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from helpers import findings, values
from siftwork.schema import finding_rows
from siftwork.session import shared_folder, size_shuffles
from siftwork.sources import inputs, stores, tree
from siftwork.sources.cache import FindingCache, findings_from_json, findings_to_json, upsert_cache


def put(root, files):
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(root)


@pytest.fixture
def source_tree(tmp_path):
    # The root itself lies below a directory called "build".
    return put(tmp_path / "build" / "repo", {
        "pkg/__init__.py": b"", "pkg/_private.py": b"x = 1\r\ny = 2\r", ".github/ci.yml": b"on: push", "UPPER.PY": b"z",
        "pkg/bad.py": b"caf\xe9 = '\xff'", "notes.md": b"#", "venv/lib.py": b"v", "a/node_modules/b.js": b"n",
        "rebuild/keep.go": b"g", ".hidden.py": b"h", ".py": b"dot", "Makefile": b"m"})


def test_tree_scope_and_decoding(spark, source_tree):
    files = inputs.with_identity(inputs.decode_text(tree.read_source_tree(spark, [source_tree])))
    rows = {r["relative_path"]: r for r in files.collect()}
    assert sorted(rows) == [".github/ci.yml", ".hidden.py", "UPPER.PY", "pkg/__init__.py", "pkg/_private.py", "pkg/bad.py",
                            "rebuild/keep.go"]
    assert rows["pkg/_private.py"]["text"] == "x = 1\ny = 2\n" and rows["pkg/__init__.py"]["text"] == ""
    assert rows["pkg/bad.py"]["text"] == "caf� = '�'"
    assert rows["UPPER.PY"]["language"] == "Python" and rows["UPPER.PY"]["file_path"] == f"{source_tree}/UPPER.PY"


def test_tree_units_cover_every_file_once(spark, tmp_path):
    root = put(tmp_path / "r", {f"d{i % 7}/e{i % 3}/f{i}.py": b"" for i in range(60)} | {"top.py": b"", "d1/mid.py": b""})
    for units in (1, 3, 10, 500):
        listed = [r["relative_path"] for r in tree.list_tree(spark, [root], units=units).collect()]
        assert len(listed) == 62 and len(set(listed)) == 62


def test_explicit_files_bypass_scope_and_errors_become_rows(spark, source_tree):
    named = [f"{source_tree}/{n}" for n in ("notes.md", "venv/lib.py", "missing.py", "pkg", "notes.md")]
    files = inputs.with_identity(inputs.decode_text(tree.read_source_files(spark, named)))
    rows = {os.path.basename(r["file_path"]): r for r in files.collect()}
    assert len(rows) == 4 and files.count() == 4
    assert rows["notes.md"]["language"] == "Unknown" and rows["lib.py"]["error"] is None
    assert "No such file" in rows["missing.py"]["error"] and rows["missing.py"]["file_hash"] == ""
    assert rows["pkg"]["error"] == "not a regular file" and rows["pkg"]["language"] == "unknown"


def test_directories_and_files_together_hold_a_path_once(spark, source_tree):
    both = tree.read_sources(spark, [source_tree], [f"{source_tree}/UPPER.PY", f"{source_tree}/notes.md"])
    paths = [r["file_path"] for r in both.collect()]
    assert len(paths) == len(set(paths)) == 8


@pytest.fixture
def store(monkeypatch):
    """`box://` URIs as a store rooted in a folder, on the executors too."""
    def mount(folder):
        folder = str(folder)

        def located(path):
            return fs.SubTreeFileSystem(folder, fs.LocalFileSystem()), unquote(path.split("://", 1)[1])
        monkeypatch.setattr(stores, "located", located)
    return mount


def test_trees_in_a_store_are_read_by_uri(spark, tmp_path, store):
    put(tmp_path / "bucket", {"repo/a b/x%y.py": b"x = 1\n", "repo/.hid/_p.py": b"\xff", "repo/venv/no.py": b"", "repo/notes.md": b"#",
                              "repo/packed.py": gzip.compress(b"x"), "other/z.py.gz": b"not packed"})
    store(tmp_path / "bucket")
    files = tree.read_source_tree(spark, ["box://repo"])
    rows = {r["relative_path"]: r for r in files.collect()}
    assert sorted(rows) == [".hid/_p.py", "a b/x%y.py", "packed.py"]
    assert rows["a b/x%y.py"]["file_path"] == "box://repo/a%20b/x%25y.py" and rows["a b/x%y.py"]["content"] == b"x = 1\n"
    assert gzip.decompress(rows["packed.py"]["content"]) == b"x"
    named = tree.read_source_files(spark, ["box://other/z.py.gz", "box://other/none.py", "box://repo", rows["a b/x%y.py"]["file_path"]])
    found = {r["file_path"]: r for r in named.collect()}
    assert found["box://other/z.py.gz"]["content"] == b"not packed" and found["box://repo/a%20b/x%25y.py"]["content"] == b"x = 1\n"
    assert "No such file" in found["box://other/none.py"]["error"] and found["box://repo"]["error"] == "not a regular file"
    pieces = tree.read_pieces(spark, ["box://repo/"], piece_bytes=4).where("relative_path = 'a b/x%y.py' AND last")
    assert pieces.first()["file_hash"] == hashlib.sha256(b"x = 1\n").hexdigest()
    missing = tree.read_source_tree(spark, ["box://absent"]).first()
    assert missing["file_path"] == "box://absent" and missing["error"]


def test_file_uris_are_local_paths(spark, source_tree):
    local, by_uri = tree.read_source_tree(spark, [source_tree]), tree.read_source_tree(spark, [f"file://{source_tree}"])
    assert sorted(map(tuple, local.collect())) == sorted(map(tuple, by_uri.collect()))
    assert stores.normal("file:///a%20b//c") == "/a b/c" and stores.normal("/a//b/") == "/a/b" and stores.normal("s3://b/x") == "s3://b/x"
    with pytest.raises(ValueError):
        stores.normal("s3://b/x?region=y")


def listed(monkeypatch, root, folder, since, until, units=1):
    """(files found, directories whose names were read) of one trigger."""
    looked, entries = [], stores.entries
    monkeypatch.setattr(stores, "entries", lambda d: looked.append(os.path.relpath(d, root)) or entries(d))
    stream = tree._TreeStream(tree._TreeOptions({**tree._options([root], {".py"}, {"venv"}, units, known_directories=folder)}))
    names = [row[1] for unit in stream.partitions({"changed_ns": since}, {"changed_ns": until}) for row in stream.read(unit)]
    stream.commit({"changed_ns": until})
    monkeypatch.setattr(stores, "entries", entries)
    return sorted(names), sorted(looked)


def test_a_trigger_lists_changed_directories_only(monkeypatch, tmp_path):
    root, folder = put(tmp_path / "r", {f"d{i}/e{j}/f.py": b"" for i in range(3) for j in range(3)}), str(tmp_path / "known")
    now = lambda: time.sleep(0.05) or time.time_ns()
    first = now()
    found, _ = listed(monkeypatch, root, folder, 0, first)
    assert len(found) == 9 and os.listdir(folder) == [str(first)]
    idle = now()
    # One unit: neither the driver nor the task reads any names.
    assert listed(monkeypatch, root, folder, first, idle) == ([], [])
    put(tmp_path / "r", {"d1/e1/new.py": b"", "d2/deep/er/x.py": b"", "d2/venv/y.py": b""})
    third = now()
    found, looked = listed(monkeypatch, root, folder, idle, third)
    assert found == ["d1/e1/new.py", "d2/deep/er/x.py"]
    assert looked == ["d1/e1", "d2", "d2/deep", "d2/deep/er"] and os.listdir(folder) == [str(third)]
    # A file after the window is found by the next trigger, though its directory has not changed since.
    put(tmp_path / "r", {"d0/e0/late.py": b""})
    assert listed(monkeypatch, root, folder, third, third + 1)[0] == []
    assert listed(monkeypatch, root, folder, third + 1, now())[0] == ["d0/e0/late.py"]
    # Directories that went are forgotten, a tree cut otherwise is walked again.
    shutil.rmtree(f"{root}/d2")
    fifth = now()
    assert listed(monkeypatch, root, folder, time.time_ns() - 10 ** 6, fifth, units=4)[0] == []
    put(tmp_path / "r", {"d0/e2/again.py": b""})
    assert listed(monkeypatch, root, folder, fifth, now(), units=4)[0] == ["d0/e2/again.py"]


def test_directories_of_a_slow_writer_are_looked_at_again(monkeypatch, tmp_path):
    root, folder = put(tmp_path / "r", {"a/b/f.py": b""}), str(tmp_path / "known")
    begun = time.time_ns() + 10 ** 6
    time.sleep(0.05)
    put(tmp_path / "r", {"a/b/f.py": b"written on"})
    assert listed(monkeypatch, root, folder, 0, begun)[0] == []
    # The directory is older than the window that takes the file.
    assert listed(monkeypatch, root, folder, begun, time.time_ns() + 10 ** 9)[0] == ["a/b/f.py"]


def test_too_large_files_become_error_rows(spark, source_tree):
    listing = tree.list_files(spark, [f"{source_tree}/pkg/bad.py"])
    row = tree.load_contents(listing, max_file_bytes=3).first()
    assert row["content"] is None and "more than one row can hold" in row["error"]


def test_read_errors_from_a_manifest(spark):
    manifest = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    files = spark.createDataFrame([("a", "x", None), ("c", None, "denied")], "file_path string, text string, error string")
    assert values(inputs.with_read_errors(manifest, files), "file_path", "error") == [
        ("a", None), ("b", "file not found or not readable"), ("c", "denied")]


def test_listing_and_changes(spark, tmp_path):
    page = [{"filename": "a.py", "status": "added"}, {"filename": "b.py", "status": "removed"},
            {"filename": "c.md", "status": "added"}, {"filename": "d.SQL"}]
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text(json.dumps([{"filename": "e.rs", "status": "modified"}]))
    listing = inputs.read_pr_listing(spark, str(tmp_path))
    assert values(listing, "file_path", "status") == [("a.py", "added"), ("d.SQL", None), ("e.rs", "modified")]
    files = spark.createDataFrame([("a.py",), ("c.md",), ("x.py",)], "file_path string")
    changed = spark.createDataFrame([("a.py",), ("a.py",), ("c.md",)], "file_path string")
    assert values(inputs.only_changed(files, changed), "file_path") == [("a.py",)]


def test_payloads(spark):
    good = base64.encodebytes("héllo\r\nwörld".encode() * 20).decode()
    rows = [("a", "base64", good), ("b", "none", good), ("c", "base64", "A"), ("d", "base64", None),
            ("e", "base64", base64.b64encode(b"\xffx").decode()), ("f", None, good)]
    df = spark.createDataFrame(rows, "path string, encoding string, content string")
    got = {r["path"]: r["text"] for r in inputs.decode_payload(df).collect()}
    assert got == {"a": "héllo\nwörld" * 20, "b": "", "c": "", "d": "", "e": "�x", "f": ""}


def test_blank_texts(spark):
    df = spark.createDataFrame([("a", " \n\t　"), ("b", ""), ("c", " x ")], "path string, text string")
    assert values(inputs.mark_blank(df), "path", "skipped") == [("a", True), ("b", True), ("c", False)]
    assert values(inputs.drop_blank(df), "path") == [("c",)]


def test_replies_table(spark, tmp_path):
    spark.createDataFrame([("h", "NO_VULNERABILITIES", None)], inputs.REPLY_SCHEMA).write.json(str(tmp_path / "r"))
    assert values(inputs.read_replies(spark, str(tmp_path / "r"), "json"), "file_hash", "error") == [("h", None)]


# ------------------------------------------------------------------ cache

def entries(spark, *rows):
    return spark.createDataFrame(rows, "file_hash string, file_path string, language string, at bigint").select(
        "file_hash", "file_path", "language", F.timestamp_seconds("at").alias("scanned_at"))


def test_upsert_last_write_wins(spark):
    old = entries(spark, ("h1", "old", "Go", 1), ("h2", "old", "Go", 1))
    new = entries(spark, ("h2", "x", "Go", 5), ("h2", "y", "Go", 9), ("h3", "z", "Go", 3))
    assert values(upsert_cache(old, new), "file_hash", "file_path") == [("h1", "old"), ("h2", "y"), ("h3", "z")]


def test_cache_folder(spark, tmp_path):
    store = FindingCache(spark, str(tmp_path / "c"))
    assert store.read().entries.count() == 0 and store.stats().first()["cached_files"] == 0
    store.put(entries(spark, ("h1", "a", "Go", 1), ("h2", "b", "Go", 2)),
              findings(spark, [("h1", 1, "LOW", "T", 1, 0.5, "llm"), ("h1", 2, "LOW", "U", 1, 0.5, "llm")], "file_hash"))
    store.put(entries(spark, ("h1", "a2", "Go", 7)), findings(spark, [("h1", 1, "HIGH", "V", 1, 0.5, "llm")], "file_hash"))
    now = store.read()
    assert values(now.entries, "file_hash", "file_path") == [("h1", "a2"), ("h2", "b")]
    assert values(now.findings, "file_hash", "type") == [("h1", "V")]
    one = store.read(only=spark.createDataFrame([("h2",)], "file_hash string"))
    assert values(one.entries, "file_hash") == [("h2",)] and one.findings.count() == 0
    # Findings whose writer was lost before its entries stay invisible, and a repeated run changes nothing.
    store._append("findings", finding_rows(findings(spark, [("h1", 1, "LOW", "T", 1, 0.5, "llm")], "file_hash"), "file_hash"), "lost")
    again = entries(spark, ("h3", "c", "Go", 9)), findings(spark, [("h3", 1, "LOW", "W", 1, 0.5, "llm")], "file_hash")
    assert [store.put(*again, run="stream#7") for _ in range(2)] == ["stream#7"] * 2
    assert values(store.read().entries, "file_hash", "file_path") == [("h1", "a2"), ("h2", "b"), ("h3", "c")]
    assert values(store.read().findings, "type") == [("V",), ("W",)]
    assert store.clear() == 3 and store.read().entries.count() == 0
    store.put(entries(spark, ("h5", "n", "Go", 3)), findings(spark, [("h5", 1, "LOW", "T", 1, 0.5, "llm")], "file_hash"))
    assert values(store.read().entries, "file_hash") == [("h5",)]


def test_a_batch_reads_its_partitions_of_the_cache(spark, tmp_path):
    store = FindingCache(spark, str(tmp_path / "c"))
    rows = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    store.put(rows.select("file_hash", F.lit("p").alias("file_path"), F.lit("Go").alias("language"), F.current_timestamp().alias("scanned_at")),
              findings(spark, [("ab", 1, "LOW", "T", 1, 0.5, "llm")], "file_hash"))
    assert len(list((tmp_path / "c" / "entries").glob("prefix=*"))) > 150
    few = rows.limit(2)
    found = store.read(only=few).entries
    assert found.count() == 2
    plan = found._jdf.queryExecution().toString()
    names = sorted({r.file_hash[:2] for r in few.collect()})
    assert "PartitionFilters: [prefix" in plan and all(f"h{n}" in plan for n in names)


def test_finding_json_both_ways(spark):
    found = findings(spark, [("h", 7, "LOW", "Path Traversal", None, 0.25, "static")], "file_hash")
    text = findings_to_json(found, "file_hash").first()["finding"]
    assert json.loads(text)["line_number"] is None and json.loads(text)["fix"] == 'mend "it"'
    bare = json.dumps([json.loads(text), {"severity": "HIGH", "type": "SSRF", "description": "", "impact": "", "fix": ""},
                       {"severity": "LOW", "type": "SSRF", "description": "", "impact": "", "fix": "", "owasp": ""}])
    rows = spark.createDataFrame([("h", bare), ("none", "[]")], "file_hash string, vulnerabilities string")
    back = values(findings_from_json(rows, "file_hash"), "ordinal", "severity_score", "confidence", "source", "line_number", "owasp")
    assert back == [(0, 1, 0.25, "static", None, "A01:2021 – Broken Access Control"),
                    (1, 3, 1.0, "llm", None, "A10:2021 – Server-Side Request Forgery"), (2, 1, 1.0, "llm", None, "")]


def test_shared_folder_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert shared_folder(spark) == named.rstrip("/")


def test_shuffles_start_as_wide_as_the_input_needs(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 1) == 4
        assert size_shuffles(spark, 10 << 30) == 40 and spark.conf.get(key) == "40"
        assert size_shuffles(spark, 100 << 40) == 409_600
    finally:
        spark.conf.unset(key)


def test_roots_that_are_missing_are_error_rows(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    rows = tree.read_source_tree(spark, [str(tmp_path), str(tmp_path / "nowhere")]).collect()
    assert {(r.file_path, r.error is None) for r in rows} == {(str(tmp_path / "a.py"), True), (str(tmp_path / "nowhere"), False)}


def test_wide_directories_are_cut_into_slices(tmp_path):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.py").write_text("x")
        (tmp_path / f"t{i}.py").write_text("x")
    units = tree._units(str(tmp_path), frozenset(), 8)
    found = [row[0] for u in units for row in tree._walk(u, frozenset([".py"]), frozenset())]
    assert len(units) <= 24 and len(found) == len(set(found)) == 120


def test_an_idle_window_lists_nothing(tmp_path):
    (tmp_path / "a.py").write_text("x")
    units = tree._units(str(tmp_path), frozenset(), 8, 0, 1)
    assert [row for u in units for row in tree._walk(u, frozenset([".py"]), frozenset())] == []
