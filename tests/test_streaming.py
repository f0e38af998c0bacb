"""Streams against their batch twins."""

import json
import random
import time

import pytest

from helpers import values
from siftwork.operators.secrets import BUILTIN_PATTERNS
from siftwork.sources.cache import FindingCache
from siftwork.streaming import progress
from siftwork.streaming.scan_stream import latest_scan_results, start_scan_stream


def fold_in_order(events):
    """Plain replay of the events of one scan, in order."""
    states = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        state = states.get(e.get("file"))
        if e["type"] == "file_start":
            states[e["file"]] = {"status": "scanning", "findings": 0, "severity": None, "language": e["language"]}
        elif e["type"] == "file_done" and state:
            state.update(status="done" if e["findings"] else "clean", findings=e["findings"], severity=e["severity"])
        elif e["type"] == "file_skip" and state:
            state["status"] = "skip"
    return states


@pytest.fixture(scope="module")
def log():
    rng, rows = random.Random(7), []
    for seq in range(3000):
        kind = rng.choice(["file_start", "file_done", "file_skip", "file_done", "log", "pr_info"])
        e = {"scan_id": rng.randrange(6), "seq": seq, "type": kind}
        if kind.startswith("file_"):
            e["file"] = f"f{rng.randrange(40)}.py"
        if kind == "file_start":
            e.update(language=rng.choice(["Python", "Go"]), index=rng.randrange(9), total=9)
        if kind == "file_done":
            n = rng.randrange(3)
            e.update(findings=n, severity="HIGH" if n else None, vulns=[{"severity": "HIGH"}] * n)
        rows.append(e)
    return rows


def expected(log):
    out = []
    for scan_id in {e["scan_id"] for e in log}:
        states = fold_in_order([e for e in log if e["scan_id"] == scan_id])
        out += [(scan_id, f, s["language"], s["status"], s["findings"], s["severity"]) for f, s in states.items()]
    return sorted(out, key=repr)


COLUMNS = ("scan_id", "file", "language", "status", "findings", "severity")


TOTALS = ("scan_id", "pct", "files_listed", "files_reported", "files_finished", "findings_so_far")


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(e),) for e in rows], "value string")


def test_file_progress_batch_and_stream(spark, log, tmp_path):
    batch = progress.file_progress(progress.parse_events(lines(spark, log)))
    assert values(batch, *COLUMNS) == expected(log)
    shuffled = log[:]
    random.Random(8).shuffle(shuffled)  # arrival order does not matter
    lines(spark, shuffled).repartition(6).write.text(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    progress.start_file_progress(progress.parse_events(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"),
                                 availableNow=True).awaitTermination()
    current = progress.current_file_progress(spark, str(tmp_path / "out"))
    assert values(current, *COLUMNS) == expected(log)
    # The scan totals follow from the stored states alone.
    totals = values(progress.scan_totals(progress.current_file_states(spark, str(tmp_path / "out"))), *TOTALS)
    assert totals == values(progress.scan_progress(progress.parse_events(lines(spark, log))), *TOTALS)
    states = expected(log)
    assert [t[2] for t in totals] == [sum(s[0] == i for s in states) for i in range(6)]


def test_ended_scans_leave_the_store(spark, tmp_path):
    """Scans that complete or fail leave nothing open; what comes later is still counted."""
    def event(scan_id, seq, kind, **more):
        return {"scan_id": scan_id, "seq": seq, "type": kind, **more}

    steps = [
        [event(1, 1, "file_start", file="a", language="Go", index=0, total=2), event(2, 1, "file_start", file="a", index=0, total=9)],
        [event(1, 2, "file_done", file="a", findings=1, severity="LOW"), event(1, 9, "complete", total_files=1),
         event(3, 1, "file_start", file="x", index=1, total=4)],
        [event(2, 2, "error", text="boom"), event(1, 3, "file_skip", file="a"), event(4, 1, "log", text="hi")],
        [event(3, 2, "file_done", file="x", findings=0), event(3, 3, "complete", total_files=1), event(1, 4, "file_start", file="late", index=1, total=2)],
    ]
    every = [e for step in steps for e in step]
    out = str(tmp_path / "out")
    still_open = []
    for n, step in enumerate(steps):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(map(json.dumps, step)))
        stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        progress.start_file_progress(progress.parse_events(stream), out, str(tmp_path / "ckpt"), availableNow=True).awaitTermination()
        still_open.append({r.scan_id for r in progress.open_file_states(spark, out).collect()})
        so_far = progress.parse_events(lines(spark, [e for s in steps[:n + 1] for e in s]))
        assert values(progress.current_file_progress(spark, out), *COLUMNS) == values(progress.file_progress(so_far), *COLUMNS)
    assert still_open == [{1, 2}, {2, 3}, {3}, set()]
    assert spark.read.parquet(f"{out}/open/batch=3").count() == 0
    assert sorted(p.name for p in (tmp_path / "out" / "open").iterdir()) == ["batch=2", "batch=3"]
    events = progress.parse_events(lines(spark, every))
    assert values(progress.scan_totals(progress.current_file_states(spark, out)), *TOTALS) == values(progress.scan_progress(events), *TOTALS)


def test_progress_bar_and_completion(spark):
    rows = [{"scan_id": 1, "seq": 1, "type": "file_start", "file": "a", "index": 0, "total": 3},
            {"scan_id": 1, "seq": 2, "type": "file_skip", "file": "a"},
            {"scan_id": 1, "seq": 3, "type": "file_start", "file": "b", "index": 1, "total": 3},
            {"scan_id": 1, "seq": 4, "type": "file_done", "file": "b", "findings": 2, "severity": "LOW"},
            {"scan_id": 2, "seq": 5, "type": "file_start", "file": "a", "index": 0, "total": 1},
            {"scan_id": 2, "seq": 6, "type": "complete", "total_files": 1, "total_findings": 2, "severity_counts": {"LOW": 2}},
            {"scan_id": 3, "seq": 7, "type": "complete", "total_files": 0, "total_findings": 0, "severity_counts": {}},
            {"scan_id": 4, "seq": 8, "type": "log", "text": "hi"},
            {"scan_id": 4, "seq": 9, "type": "error", "text": "boom", "detail": "trace"}]
    events = progress.parse_events(lines(spark, rows))
    assert values(progress.scan_progress(events), "scan_id", "pct", "files_listed", "files_reported", "files_finished",
                  "findings_so_far") == [(1, 33, 2, 1, 2, 2), (2, 100, 1, 1, 0, 0), (3, 0, 0, 0, 0, 0)]
    assert values(progress.completion_counts(events), "scan_id", "total_files", "total_findings", "critical", "low") == [
        (2, 1, 2, 0, 2), (3, 0, 0, 0, 0)]
    assert values(progress.scan_status(events), "scan_id", "status", "message") == [
        (1, "running", None), (2, "complete", None), (3, "complete", None), (4, "error", "boom")]


def run_stream(spark, root, tmp_path, **options):
    time.sleep(0.05)
    start_scan_stream(spark, [str(root)], str(tmp_path / "out"), str(tmp_path / "ckpt"), settle_seconds=0,
                      availableNow=True, **options).awaitTermination()
    files, found = latest_scan_results(spark, str(tmp_path / "out"))
    return values(files, "file_path", "from_cache", "risk_score"), values(found, "file_path", "type", "line_number")


def test_scan_stream_takes_new_and_changed_files(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "__init__.py").write_text("eval(x)")
    (root / "sub" / "b.py").write_text("y = 1")
    files, found = run_stream(spark, root, tmp_path)
    assert files == [(f"{root}/__init__.py", False, 4), (f"{root}/sub/b.py", False, 0)] and len(found) == 1
    # One file changes, one is moved in with an old modification time, one is out of scope.
    (root / "sub" / "b.py").write_text("exec(y)")
    late = tmp_path / "late.py"
    late.write_text("password = 'hunter22'")
    import os
    os.utime(late, (1, 1))
    late.rename(root / "late.py")
    (root / "notes.md").write_text("eval(x)")
    files, found = run_stream(spark, root, tmp_path)
    assert [f[2] for f in files] == [4, 3, 4] and [f[0].split("/")[-1] for f in files] == ["__init__.py", "late.py", "b.py"]
    batches = spark.read.parquet(str(tmp_path / "out" / "files")).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [2, 2]  # the unchanged file was not read again


def test_scan_stream_by_known_directories(spark, tmp_path):
    root, known = tmp_path / "src", tmp_path / "known"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.py").write_text("eval(x)")
    files, _ = run_stream(spark, root, tmp_path, known_directories=str(known))
    assert files == [(f"{root}/sub/a.py", False, 4)] and list(known.rglob("*.json"))
    (root / "sub" / "new").mkdir()
    (root / "sub" / "new" / "b.py").write_text("y = 1")
    files, found = run_stream(spark, root, tmp_path, known_directories=str(known))
    assert files == [(f"{root}/sub/a.py", False, 4), (f"{root}/sub/new/b.py", False, 0)] and len(found) == 1


def test_scan_stream_with_cache(spark, tmp_path):
    root, store = tmp_path / "src", FindingCache(spark, str(tmp_path / "cache"))
    root.mkdir()
    (root / "a.py").write_text("eval(x)")
    files, _ = run_stream(spark, root, tmp_path, cache=store, patterns=BUILTIN_PATTERNS)
    assert files == [(f"{root}/a.py", False, 4)]
    assert store.stats().first()["cached_files"] == 1
    (root / "copy.py").write_text("eval(x)")
    files, found = run_stream(spark, root, tmp_path, cache=store)
    assert files == [(f"{root}/a.py", False, 4), (f"{root}/copy.py", True, 4)]
    assert [f[0].split("/")[-1] for f in found] == ["a.py", "copy.py"]
