"""Vector codes against a brute-force version in whole numbers of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.llm import codebooks


def whole(x, scale):
    return int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale)


def brute(rows, parts, entries, rounds, scale):
    """[(id, vector, code, error)] and the entries of (id, vector) rows of one length."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[[whole(x, scale) for x in v[p * width:(p + 1) * width]] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, v, bytes(j for _, j in f), sum(d for d, _ in f)) for (i, v), f in zip(kept, assign())], books


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, (i or 0) % 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize("seed, spread, rounds, entries", [(1, 1.0, 2, 64), (2, 0.02, 4, 6), (3, 0.005, 5, 3), (4, 300.0, 2, 8)])
def test_codes_match_brute_force(spark, seed, spread, rounds, entries):
    # A small spread makes many ties and entries that stay while others move.
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(8)]) for i in rng.sample(range(1000), 150)]
    rows += rows[:7] + [(5000, None), (5001, [1.0, None] + [0.0] * 6), (5002, [float("nan")] * 8), (5003, [float("-inf")] + [0.0] * 7),
                        (None, [0.25] * 8), (None, [0.5] * 8)]
    coded, books = codebooks.compress(vectors(spark, rows), parts=4, entries=entries, rounds=rounds)
    expected, entries_ = brute(rows, 4, entries, rounds, 256)
    assert books.entries == entries_
    assert sorted((r.vec_id is None, r.vec_id or 0, list(r.embedding), bytes(r.code), r.error) for r in coded.collect()) == sorted(
        (i is None, i or 0, v, c, e) for i, v, c, e in expected)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    sizes = [1.0, 3e7, 1e16, 3e38, 1.5e300]
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * rng.choice(sizes) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [rng.random() for _ in range(4)]) for i in range(20)]
    for low in (0, 100):  # entries that are large and entries that are small at first
        turned = [((i + 200 - low) % 300, v) for i, v in rows]
        coded, books = codebooks.compress(vectors(spark, turned), parts=2, entries=5, rounds=2)
        expected, entries = brute(turned, 2, 5, 2, 256)
        assert books.entries == entries
        assert {r.vec_id: (bytes(r.code), r.error) for r in coded.collect()} == {
            i: (c, e if e < 2 ** 63 else None) for i, _, c, e in expected}
        # Sums with a row beyond long are null, they do not fail.
        codebooks.with_group_error(coded, "label", "total").collect()


def test_odd_tables(spark):
    empty, books = codebooks.compress(vectors(spark, []))
    assert empty.collect() == [] and books.digest() == codebooks.hashlib.sha256(b"").hexdigest()
    few, _ = codebooks.compress(vectors(spark, [(3, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [])]), parts=2)
    # Five zeros short of nothing: three components are two parts of two; the empty vector has another length.
    assert sorted((r.vec_id, r.code and bytes(r.code), r.error) for r in few.collect()) == [(1, b"\0\0", 0), (2, None, None), (3, b"\0\0", 0)]
    clash = vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.75])]).select(
        "vec_id", "embedding", F.lit("x").alias("code"), F.lit(1).alias("_row"), F.lit(2).alias("_code"), F.lit(3).alias("a.b"), F.lit(4).alias("_vector"))
    out, _ = codebooks.compress(clash, parts=2)
    assert out.columns == ["vec_id", "embedding", "_row", "_code", "a.b", "_vector", "code", "error"]
    assert [(r["_row"], r["_code"], r["a.b"], r["_vector"], bytes(r["code"])) for r in out.orderBy("vec_id").collect()] == [
        (1, 2, 3, 4, b"\0\0"), (1, 2, 3, 4, b"\0\1")]


def test_group_errors_put_nulls_together(spark):
    coded = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", 1), (4, "a", None), (5, "b", None)], "vec_id long, label string, error long")
    assert {r.vec_id: r.t for r in codebooks.with_group_error(coded, "label", "t").collect()} == {1: 11, 2: 11, 3: 1, 4: 1, 5: None}


def test_only_moved_entries_are_compared(monkeypatch):
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(0, 9, (400, 3)))
    books = codebooks.Codebooks([[[int(v) for v in r] for r in rows[:8]]])
    code, exact = books.assign([rows], None, None)
    moved = codebooks.Codebooks([[[v + (j in (2, 5)) for v in e] for j, e in enumerate(books.entries[0])]], [[j in (2, 5) for j in range(8)]])
    seen = []
    real = codebooks.nearest
    monkeypatch.setattr(codebooks, "nearest", lambda r, e: (seen.append((len(r), len(e))), real(r, e))[1])
    again = moved.assign([rows], code, exact.astype(np.int64))
    rescanned = int(np.isin(code[:, 0], (2, 5)).sum())
    assert seen == [(rescanned, 8), (400 - rescanned, 2)]
    monkeypatch.undo()
    full = codebooks.Codebooks(moved.entries).assign([rows], None, None)
    assert (again[0] == full[0]).all() and (again[1] == full[1]).all()
