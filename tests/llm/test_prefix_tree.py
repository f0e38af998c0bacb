"""The prefix tree against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import prefix_tree as pt


def brute(convs):
    """Node rows of {id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        kids = [below(k) for k in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return sum(k[0] for k in kids) or int(not kids), own + sum(k[1] for k in kids)

    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), *below(n),
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def some_conversations(rng, n, length=6, kinds=3):
    return {i: [(rng.choice(["user", "bot"]), "x" * rng.randrange(kinds)) for _ in range(rng.randrange(length))]
            for i in rng.sample(range(3 * n), n)}


def as_turns(spark, convs):
    return spark.createDataFrame([(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)],
                                 "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed, n, kinds", [(1, 300, 2), (2, 200, 4), (3, 1, 2)])
def test_nodes_match_brute_force(spark, seed, n, kinds):
    rng = random.Random(seed)
    convs = {c: t for c, t in some_conversations(rng, n, kinds=kinds).items() if t} or {7: [("user", "x")]}
    # A hot prefix and a hot conversation.
    convs.update({10_000 + i: [("user", "hello")] * 3 for i in range(n)})
    assert rows_of(pt.prefix_tree(pt.turn_sequences(as_turns(spark, convs)))) == brute(convs)


def test_shared_heads(spark):
    rng = random.Random(5)
    convs = {i: [("user", f"{i % 7}{k}") for k in range(rng.randrange(1, 9))] for i in [*range(0, 140), *range(250, 420, 3)]}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values()), "some conversation should lose all its turns"
    found = pt.with_shared_heads(pt.turn_sequences(as_turns(spark, convs)))
    assert rows_of(pt.prefix_tree(found)) == brute(rebuilt)


def test_nulls_ties_repeats_and_names(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (2, None, "user", "a"), (2, 0, "", ""), (None, 0, "user", "lost"),
            (3, 5, "z", "q"), (3, 5, "a", "q")]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in rows], "c long, t long, r string, x string, digest string, chars int")
    found = pt.turn_sequences(turns, "c", "t", "r", "x")
    tied = sorted([("z", "q"), ("a", "q")], key=lambda t: hashlib.sha256(f"1:{t[0]}{t[1]}".encode()).hexdigest())
    assert rows_of(pt.prefix_tree(found)) == brute({1: [("user", "a"), ("", ""), ("", "")], 2: [("user", "a"), ("", "")], 3: tied})
    assert pt.prefix_tree(pt.with_shared_heads(found.limit(0))).collect() == []


def test_a_long_conversation(spark):
    convs = {1: [("u", f"t{i}") for i in range(3000)], 2: [("u", f"t{i}") for i in range(2990)], 3: [("u", "t0")]}
    sequences = pt.turn_sequences(as_turns(spark, convs))
    got = rows_of(pt.prefix_tree(sequences))
    assert len(got) == 3001 and {r[1]: r[5] for r in got}[1] == 1
    last = {r[1]: r for r in got}
    assert last[2990][3:6] == (2, 1, 1) and last[1][6] == 2 * 2 + sum(len(f"t{i}") for i in range(1, 2990))


@pytest.mark.parametrize("limit", [1, 3, 17, 1000])
def test_stretches_may_be_cut_anywhere(monkeypatch, limit):
    """Rows of nodes over stretches of any size, and over parts that know their neighbours, add up to the same tree."""
    monkeypatch.setattr(pt, "STRETCH", limit)
    monkeypatch.setattr(pt, "PIECE", 2)
    rng = random.Random(limit)
    convs = some_conversations(rng, 120, kinds=2)
    digest = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()[:pt.DIGEST]
    order = sorted((b"".join(map(digest, t)), c, [len(x) for _, x in t]) for c, t in convs.items())
    cuts = sorted(rng.sample(range(1, len(order)), 4))
    rows = []
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)])):
        if a:
            rows.append((part, pt.BEFORE, order[a - 1][0], None, []))
        rows += [(part, pt.OWN, *r) for r in order[a:b]]
        if b < len(order):
            rows.append((part, pt.AFTER, order[b][0], None, []))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[i:i + 7]), kinds)], names=list("abcde"))
               for i in range(0, len(rows), 7)]
    total, ends = {}, []
    for batch in pt._stretches(iter(batches)):
        for r in batch.to_pylist():
            if r["ends"] is not None:
                ends.append((r["key"], r["first"], r["ends"]))
                continue
            old = total.get(r["key"])
            numbers = np.array([r[c] for c in ("n_convs", "n_children", "n_leaves", "saved")])
            total[r["key"]] = (r["parent"], r["depth"], min(r["first"], old[2]) if old else r["first"], numbers + (old[3] if old else 0))
    pieces = sorted(ends)
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*pieces)], names=["key", "first", "ends"])
    digests = {r["key"]: r["ends_sha256"] for b in pt._digests(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = sorted((first, depth, total[parent][2] if parent else -1, *map(int, numbers), digests.get(key, nothing))
                 for key, (parent, depth, first, numbers) in total.items())
    assert got == brute(convs)
