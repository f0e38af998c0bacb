"""Operators on texts against plain-Python versions, odd rows included."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from siftwork.llm import common, line_dedup, quality, simhash, substring_dedup, token_counts
from siftwork.llm.queries import QUERIES, tokenizer_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_lines int, _k string, _text int, "
          "N_Words string, `a.b` string")


def frame(spark, pairs, lang="en"):
    rows = [(i, t, lang if (i or 0) % 5 else None, None, None, 7, "k", 1, "w", "x") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "ÉTÉ", "été", "#", "|", "a", "語", "x.y"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, passage = " Common LINE \t", line(30)
    pairs = [(i, "\n".join([line(rng.randint(0, 12)) for _ in range(rng.randint(0, 6))] + [shared] * (i % 2)
                           + [passage] * (i % 3 == 0))) for i in range(40)]
    pairs += [(100, None), (101, ""), (102, " \n\t\x0b"), (None, shared), (None, None), (103, passage), (103, passage),
              (104, "one text"), (104, "another text " + passage), (105, "common line\nCOMMON LINE\ncommon line"),
              (106, " ".join(["long"] * 70_000)), (107, "\x00 nul sep")]
    return pairs


def kept_columns(result, docs, outputs):
    low = {o.lower() for o in outputs}
    assert [c for c in result.columns if c not in outputs] == [c for c in docs.columns if c.lower() not in low]


def test_line_dedup_equals_brute_force(spark):
    pairs = odd_texts()
    docs = frame(spark, pairs)
    result = line_dedup.drop_frequent_lines(docs, min_documents=5)
    kept_columns(result, docs, line_dedup.OUTPUTS)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(k for _, t in pairs for k in {key(x) for x in (t or "").split("\n")})
    expected = Counter()
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= 5)]
        expected[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in result.collect())
    assert got == expected


def test_quality_measures_equal_brute_force(spark):
    pairs = odd_texts()
    got = Counter(tuple(r) for r in quality.features(frame(spark, pairs)).select("_id", *quality.MEASURES[:5]).collect())
    expected = Counter()
    for i, t in pairs:
        words = [w.decode() for w in (t or "").encode().split()]
        at = defaultdict(list)
        for k in range(len(words) - 2):
            at[tuple(words[k:k + 3])].append(k)
        covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        expected[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == expected


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 3, 9) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.004).alias("p")).collect()
    for r in rows:
        exact = sum(math.comb(r.n, i) * 0.004 ** i * 0.996 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.004 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)


def labelled(spark, good, bad):
    clean = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"word{i} ###" for i in range(60))
    docs = [(i, clean) for i in range(good)] + [(good + i, noisy) for i in range(bad)]
    rows = [(i, t, "en", None) for i, t in docs] + [(-1, clean, "fr", None), (-2, noisy, "fr", None), (-3, noisy, "en", 1), (-4, None, None, 1)]
    labels = [(i, 1 if i < good else 0) for i in range(good + bad)] + [(0, None), (None, 1), (-99, 1), (-3, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_need_proof_and_hold_per_stratum(spark):
    docs, labels = labelled(spark, 2200, 40)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert set(range(2200)) <= kept and not kept & set(range(2200, 2240))
    assert -3 not in kept and -4 not in kept
    assert {-1, -2} <= kept, "a stratum without labels gets no cutoff"
    # 0.98 ** 148 > 0.05 >= 0.98 ** 149: so many good labels without any loss prove a cutoff.
    docs, labels = labelled(spark, 149, 40)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} & set(range(189)) == set(range(149))
    docs, labels = labelled(spark, 148, 40)
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} >= set(range(188)), "too few labels prove nothing"
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 191
    renamed = quality.quality_verdicts(docs.withColumnRenamed("doc_id", "n_words"), labels, id_col="n_words")
    assert renamed.columns.count("n_words") == 1 and {r.n_words for r in renamed.collect()} == {r.doc_id for r in docs.collect()}


def test_false_rejections_on_documents_without_labels(spark):
    """Good documents whose symbol ratio varies: half are labelled, the rate is measured on the others."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(6000):
        good = i % 5 > 0
        share = min(1.0, rng.expovariate(12)) if good else rng.uniform(0.1, 1)
        rows.append((i, " ".join(f"w{k}#" if rng.random() < share else f"w{k}" for k in range(60)), f"l{i % 3}"))
        if i % 2:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    verdicts = quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id for r in verdicts.where("kept").collect()}
    for lang in range(3):
        fresh = [i for i in range(0, 6000, 2) if i % 3 == lang]
        lost = [i not in kept for i in fresh if i % 5]
        caught = [i not in kept for i in fresh if i % 5 == 0]
        assert sum(lost) / len(lost) <= quality.ALPHA + 0.01 and sum(caught) / len(caught) > 0.3


def plain_fingerprint(text):
    """A restatement of the contract that shares no code with the operator."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    number = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return number - (number >> 63 << 64)


def plain_components(pairs):
    """(fingerprints, smallest id of the component or None) of (id, text) pairs."""
    prints = [plain_fingerprint(t) for _, t in pairs]
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (i, _), p in zip(pairs, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return prints, [least.get(find(p)) for p in prints]


def test_fingerprints_link_like_brute_force(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    pairs = [(i, " ".join(base[:j] + [f"e{i}"] + base[j + 1:])) for i, j in enumerate(rng.choices(range(150), k=60))]
    pairs += odd_texts()
    rows = simhash.near_duplicates(frame(spark, pairs)).collect()
    prints, components = plain_components(pairs)
    expected = Counter((i, p, c) for (i, _), p, c in zip(pairs, prints, components))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected
    assert simhash.near_duplicates(frame(spark, pairs).limit(0)).count() == 0


def test_registered_simhash_on_a_given_table(spark, sf_dir):
    """The query itself, on a whole table, against the restatement."""
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints, components = plain_components(pairs)
    expected = {i: (f"{p & (1 << 64) - 1:016x}", c) for (i, _), p, c in zip(pairs, prints, components)}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert found == expected
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(components))


def test_cells_of_a_hot_bucket_keep_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(2)
    values = sorted({rng.getrandbits(8) << 3 | rng.getrandbits(2) for _ in range(300)})
    nodes = spark.createDataFrame([(v, v) for v in values], "key long, fp long")
    total, together = simhash.bit_statistics(nodes)
    assert total == len(values)
    edges = simhash.links(nodes, simhash.allocate(together, total, 1), 1)
    roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    expected = {v: v for v in values}
    for _ in values:
        for a in values:
            for bit in range(12):
                if a ^ 1 << bit in expected:
                    expected[a] = min(expected[a], expected[a ^ 1 << bit])
    linked = {v for v in values if any(v ^ 1 << b in expected for b in range(12))}
    assert roots == {v: expected[v] for v in linked}


def test_thresholds_obey_the_pigeonhole_principle(spark):
    rng = random.Random(1)
    import numpy as np

    for tau in (3, 8):
        together = np.full((64, 64), 250.0)
        np.fill_diagonal(together, 500)
        plan = simhash.allocate(together, 1000, tau)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), tau):
                b ^= 1 << bit
            pair = np.array([a, b], np.uint64).view(np.int64)
            found = defaultdict(set)
            for rows, buckets in simhash.bucket_rows(pair, plan):
                for r, x in zip(rows.tolist(), buckets.tolist()):
                    found[r].add(x)
            assert found[0] & found[1]


def test_one_of_each_keeps_the_first_of_each_component(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base = [word() for _ in range(400)]
    pairs = [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base[:200] + ["edit"] + base[201:])),
             (5, " ".join(base[:100] + ["other"] + base[101:])), (30, " ".join(word() for _ in range(400))),
             (40, None), (41, ""), (42, "two words"), (42, "two words"), (None, "two words"), (None, "null id"), (None, "null id"), (50, "lonely")]
    pairs += [(100 + i, " ".join(word() for _ in range(80))) for i in range(60)]
    pairs += [(i if i is None else i + 1000, t) for i, t in odd_texts() if i != 104]  # one id, two texts
    docs = frame(spark, pairs)
    result = simhash.one_of_each(docs)
    assert result.columns == docs.columns
    prints, components = plain_components(pairs)
    kept = Counter(r.doc_id for r in result.collect())
    named = {c for c in components if c is not None}
    # Components without any id keep one row each.
    nameless = {p for p, c in zip(prints, components) if c is None}
    assert kept == Counter({**dict.fromkeys(named, 1), **({None: len(nameless)} if nameless else {})})
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def brute_starts(pairs, length):
    seen, drop = {}, {}
    order = sorted({(i is None, i or 0, t or "", t is None) for i, t in pairs})
    texts = [(n, k, t.encode().split()) for n, k, t, _ in order]
    for doc, (_, _, words) in enumerate(texts):
        for p in range(len(words) - length + 1):
            seen.setdefault(tuple(words[p:p + length]), (doc, p))
    for doc, (n, k, words) in enumerate(texts):
        gone = {q for p in range(len(words) - length + 1) if seen[tuple(words[p:p + length])] != (doc, p) for q in range(p, p + length)}
        drop[(n, k, b" ".join(words))] = (len(words), len(gone), b" ".join(w for q, w in enumerate(words) if q not in gone).decode())
    return drop


@pytest.mark.parametrize("task_bytes", [substring_dedup.TASK_BYTES, 1_000])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", task_bytes)
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randint(0, 50)}" for _ in range(rng.randint(15, 60))) for _ in range(6)]
    pairs = [(i, "  ".join([f"a{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40))] + rng.choices(passages, k=rng.randint(0, 3))))
             for i in range(60)]
    pairs += [(100, None), (101, ""), (102, "same " * 90), (None, passages[0]), (103, passages[1]), (103, passages[1])]
    docs = frame(spark, pairs)
    rows, total = docs.selectExpr("text"), sum(len((t or "").encode()) for _, t in pairs)
    assert common.width_for(rows, "text", task_bytes) == max(4, -(-total // task_bytes))
    result = substring_dedup.remove_repeats(docs, join_words=True)
    kept_columns(result, docs, substring_dedup.OUTPUTS)
    expected = brute_starts(pairs, 20)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in result.collect())
    assert got == Counter((i, *expected[(i is None, i or 0, b" ".join((t or "").encode().split()))]) for i, t in pairs)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_keeps_the_layout(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = frame(spark, [(1, passage), (2, f"  head\n\n{passage}\ntail  end\n"), (3, None), (4, "  as it is \n")])
    texts = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert texts == {1: passage, 2: "  head\n\ntail  end\n", 3: None, 4: "  as it is \n"}


def test_covers_hold_every_difference():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.cover_for(20)[0] == 13 and substring_dedup.cover_for(5)[0] == 1


def test_packed_entries_come_back():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = substring_dedup.Keys([0, 1, 0, 0], [5, 0, -7, 2 ** 62], [1, -2, 3, 4])
    number, position = rng.integers(0, 4, 50), rng.integers(0, 1 << 31, 50)
    h = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    hashes, place, at, flag, own = substring_dedup.unpacked(substring_dedup.packed([h, h + np.uint64(1)], [8, 8], number, position, number % 2, keys))
    got = Counter(zip(hashes[0].tolist(), hashes[1].tolist(), own.k[place].tolist(), at.tolist(), flag.tolist()))
    assert got == Counter(zip(h.tolist(), (h + np.uint64(1)).tolist(), keys.k[number].tolist(), position.tolist(), (number % 2).tolist()))


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    pairs = odd_texts() + [(200, "a<|endoftext|>b"), (201, "two  spaces \n and　more"), (202, "x" * 200_000)]
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    result = token_counts.count_tokens(frame(spark, pairs), path, limit=20)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in result.collect())
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in pairs]
    assert got == Counter((i, len((t or "").encode()), n, n > 20) for (i, t), n in zip(pairs, counts))
    assert token_counts.count_tokens(frame(spark, pairs).limit(0), path).count() == 0


def thue_morse(size, swap):
    bits = [(i.bit_count() + swap) % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits)


def test_windows_are_equal_by_their_words_only(spark):
    """Words whose polynomial hashes agree modulo 2^64 for every odd base are still different words."""
    around = [f"w{i}" for i in range(19)]
    pairs = [(1, " ".join([*around[:9], thue_morse(4096, 0), *around[9:]])), (2, " ".join([*around[:9], thue_morse(4096, 1), *around[9:]])),
             (3, " ".join([*around[:9], thue_morse(4096, 1), *around[9:]]))]
    found = substring_dedup.remove_repeats(frame(spark, pairs), 20)
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: 0, 3: 20}
