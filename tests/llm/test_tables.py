"""Files, vectors, packing, archives, pieces and the pipeline, against plain-Python versions."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from checks.compare import compare
from siftwork.llm import packing, sentence_pieces, token_files, topk, warc
from siftwork.llm.queries import ORACLES, QUERIES, tokenizer_path
from siftwork.llm.segments import Segmented

from test_texts import plain_components

ODD = ["", None, "two  spaces", " \n ", "İİ!? ΑΣ. Ⅷ ½", "it's 12's\x85x y　z", "H̱ tail", "<|endoftext|>a<|startoftext|>", "語語 한하 😀",
       "line\nNext, word. End", "word " * 3000, "x" * 70_000]


def docs_of(spark, texts, extra="n_tokens int, ids string"):
    rows = [(i if i % 7 else None, t, 1, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_give_what_the_library_gives(name):
    rng = random.Random(3)
    atoms = ["a", "B", " ", "  ", "\n", "\x1c", "\x85", "　", "é", "é", "H̱", "İ", "ß", "Σ", "'s", "1", "½", ".", "!?",
             "<|endoftext|>", "<|", "語", "한", "foo", "Bar,", "😀", "᠎", "ﬁ", "K"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    encoder = Segmented(tokenizer_path(name), False, store_size=500)
    assert encoder.encode(texts) == encoder._library(texts)
    long = " ".join(texts) * 4
    assert encoder.whole(long) == encoder._library([long])[0]


def test_token_files_come_back(spark, library, tmp_path):
    docs, pairs = docs_of(spark, ODD * 2)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"), 2)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.ids) for r in rows) == Counter((i, ids_of(library, t)) for i, t in pairs)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)
    one = manifest.where("documents > 1").first()
    shard = token_files.Shard(one.uri, f"{folder}/dictionary-{one.dictionary}")
    assert shard.ids(1) in {r.ids for r in rows}
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(docs.limit(0), empty, tokenizer_path("word_bpe_49k.json"), 2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_packing_holds_every_id_once(spark, library):
    docs, pairs = docs_of(spark, ODD + ["Some words here. More of them!"] * 60)
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, length=256).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 256
    # Documents of one id are told apart by putting their pieces together in order.
    whole = Counter()
    for key in {r.doc_id for r in rows}:
        own, held = sorted((r for r in rows if r.doc_id == key), key=lambda r: (r.sequence_id, r.offset)), b""
        for r in own:
            held = r.ids if r.start == 0 else held + r.ids
            if len(held) == 4 * r.doc_tokens:
                whole[(key, held)] += 1
    assert whole == Counter((i, ids_of(library, t)) for i, t in pairs)
    assert packing.pack(docs.limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        stops = np.unique(np.concatenate([[0], rng.integers(1, 4000, rng.integers(2, 40)), np.arange(600, 4000, 600)]))
        penalties = rng.integers(0, 90, len(stops))
        length = 1024
        cost = {0: 0.0}
        for j in range(1, len(stops)):
            options = []
            for i in range(j):
                size = int(stops[j] - stops[i])
                if size <= length:
                    pad = length - size
                    if size == 512 and size < length:
                        pad = min(pad, packing.SHORT)
                    if j == len(stops) - 1:
                        pad = min(pad, packing._tail(size, length)[0])
                    options.append(cost[i] + pad + penalties[j])
            cost[j] = min(options)
        cuts = packing.cut_points(stops, penalties, length)
        total, at = 0.0, {int(s): int(p) for s, p in zip(stops, penalties)}
        sizes = np.diff(cuts)
        assert cuts[0] == 0 and cuts[-1] == stops[-1] and (sizes > 0).all() and (sizes <= length).all()
        for a, b in zip(cuts, cuts[1:]):
            size = b - a
            total += at.get(b, packing.INSIDE) + (0 if size & (size - 1) == 0 and (b == cuts[-1] or b not in at) else
                                                  min(length - size, packing.SHORT if size == 512 else length))
        assert total <= cost[len(stops) - 1] + packing.SHORT


def test_archives_come_back_in_chunks(spark, tmp_path):
    big = "<p>" + "é" * 5000
    pages = [(1, "http://a/", "<a>"), (2, None, "<a>"), (9, "u\r\nv", "<a>"), (3, "x", None), (4, "x", ""), (5, "y", big), (6, "z", big),
             (7, "z", "lone"), (8, "v", "WARC/1.1\r\n\r\n"), (7, "z", "other of the same id"), (None, "n", "<a>"),
             (15, "r", "a"), (15, "r", "b"), (13, "r", "b"), (13, "r", "b"), (12, "r", "a")]
    frame = spark.createDataFrame([(*p, "k", 3) for p in pages], "page_id long, url string, html string, _id string, _chunk int").repartition(3)
    manifest = warc.write_archives(frame, f"file://{tmp_path}/w", chunk_bytes=1000)
    chunks = warc.read_archives(manifest, chunk_bytes=700)
    assert chunks.where("chunk > 3").count() > 0 and chunks.agg(F.max(F.length("data"))).first()[0] <= 700
    owners = {}
    for i, _, h in pages:
        owners[h or ""] = max(owners.get(h or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        owner = owners[h or ""]
        revisit = i is not None and i != owner
        expected[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                  owner if revisit else None)] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(chunks).collect())
    assert got == expected
    body = b"".join(r.data for r in chunks.where("record LIKE '<urn:page:6:%'").orderBy("chunk").collect())
    assert body == big.encode()
    assert warc.resolved(warc.read_archives(warc.write_archives(frame.limit(0), f"file://{tmp_path}/e"))).count() == 0
    small = warc.resolved(warc.read_archives(warc.write_archives(frame, f"file://{tmp_path}/s", min_bytes=10)))
    assert {r.page_id for r in small.where("record_type = 'revisit'").collect()} == {5}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "SHARDS_PER_GROUP", 2)
    rng = random.Random(7)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(120)]
    vectors += [(400, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (700, [float("inf")] * 6), (None, [1.0] * 6),
                (800, [1.0, 2.0]), (801, [2.0, 2.0]), (900, []), (40, vectors[40][1]), (50, [3.0] * 6)]
    vectors += vectors[5:30] + vectors[95:105] * 2 + [(100, [-1.0] * 6), (200, [0.25] * 6), (200, [0.25] * 6)]
    vectors += [(2000, [2.0 ** 40, 1.0, 0.0]), (2001, [2.0 ** 41, 0.0, 1.0]), (2002, [-2.0 ** 41, 5.0, 1.0]), (2003, [1e16, -1.0, 0.0]),
                (2100, [1e16, 0.0, 2.0]), (2004, [3e38, 0.0, 0.0]), (2200, [-3e38, 1.0, 1.0]), (2005, [1.7e308, 1.0, 0.0]), (2300, [-1.7e308, 1e-300, 5.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, shard int")
    got = Counter(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0, k=5).collect())
    usable = [(i, [int(x) * 1024 if abs(x) >= 2.0 ** 53 else math.floor(1024 * x) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for row, (i, q) in enumerate(usable):
        if i % 100 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -2 ** 63), 2 ** 63 - 1), j) for other, (j, v) in enumerate(usable)
                            if other != row and len(v) == len(q))
            expected.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored[:5], 1))
    assert got == expected
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def unigram_model(path, with_bytes):
    """A small unigram model file, field by field."""
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(number, value):
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(number << 3 | 2) + varint(len(value)) + value

    rng = random.Random(7)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256 * with_bytes)]
    tokens = {"▁", *"abcdé"} | {"▁" + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(60)}
    tokens |= {"".join(rng.choices("abcd", k=rng.randint(2, 6))) for _ in range(120)}
    pieces += [(t, -rng.uniform(2, 12), 1) for t in sorted(tokens)]
    body = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    body += field(2, field(3, 1) + (field(35, 1) if with_bytes else b""))
    path.write_bytes(body + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram_bytes"])
def test_pieces_are_the_library_s(kind, tmp_path):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model") if kind == "bpe" else unigram_model(tmp_path / "m.model", kind == "unigram_bytes")
    own, library = sentence_pieces.Model(path, 300), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    atoms = ["a", "b", " ", "  ", "\n", "▁", "the", "ing", "é", "語", "😀", "<s>", "\x00", "aaaa", " th", "cab", "dd", "x z"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.choice([0, 1, 2, 5, 20, 90]))) for _ in range(2000)]
    ids = own.encode(texts)
    found, wanted = [np.frombuffer(b, "<u4").tolist() for b in ids], library.encode(texts, num_threads=1)
    # The library adds up a whole text in single precision, so equally good cuts of
    # a unigram model ("a" + "aa", "aa" + "a") are a matter of its rounding.
    same = lambda a, b: sorted(a) == sorted(b) if kind != "bpe" else a == b
    assert all(same(a, b) for a, b in zip(found, wanted))
    assert [own.decode(b) for b in ids] == [library.decode(np.frombuffer(b, "<u4").tolist()) for b in ids]


def test_pieces_of_odd_documents(spark):
    docs, pairs = docs_of(spark, ODD, "n_pieces int, piece_ids string")
    path = tokenizer_path("piece_bpe_32k.model")
    rows = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, path), path).collect()
    assert Counter((r.doc_id, r.decoded, r.n_pieces == len(r.piece_ids) // 4) for r in rows) == Counter((i, t or "", True) for i, t in pairs)
    trips = sentence_pieces.round_trip(docs, path).collect()
    assert all(r.round_trip for r in trips) and {r.ids_crc32 for r in trips} == {zlib.crc32(r.piece_ids) for r in rows}
    assert sentence_pieces.encode_pieces(docs.limit(0), path).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_statement(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert compare(spark, con, sf_dir, name)[1] is True


def test_pipeline_stages(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns and after.dtypes == docs.dtypes
        assert after.where("n_chars <> char_length(text)").count() == 0
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "near_dedup":
            pairs = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == set(plain_components(pairs)[1])
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    total = defaultdict(int)
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(ids_of(library, r.text)) // 4 for r in before.collect()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == dict(total)


def test_pipeline_runs_as_a_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_dictionary_comes_from_long_texts_too(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(9000))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    dictionary, total = token_files.train_dictionary(docs, path, 2)
    assert total == sum(len((r.text or "").encode()) for r in docs.collect())
    assert len(dictionary) > 1000
    manifest = token_files.write_tokens(docs, f"file://{tmp_path}/t", path, 2)
    assert {len(r.dictionary) for r in manifest.collect()} == {64}
    assert token_files.train_dictionary(docs.limit(0), path, 2) == (b"", 0)
    monkeypatch.setattr(token_files, "SHARD_BYTES", total // 10)
    shards = token_files.write_tokens(docs, f"file://{tmp_path}/u", path, 2).collect()
    assert len(shards) > 5 and sum(r.documents for r in shards) == 40 and manifest.count() <= 4


def test_pipeline_stages_keep_columns_named_like_results(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 3, "a", 4, 5, 0), (2, None, None, None, None, None, None), (2, None, None, None, None, None, None),
                                  (3, f"{text}\nx", 7, "b", 8, 9, 0)],
                                 "doc_id long, text string, n_lines int, n_removed string, N_Words long, n_dropped long, n_chars long")
    for stage in (corpus_pipeline.rare_lines, corpus_pipeline.single_passages):
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        rows = Counter((r.doc_id, r.n_lines, r.n_removed, r["N_Words"], r.n_dropped) for r in out.collect())
        assert rows == Counter([(1, 3, "a", 4, 5), (3, 7, "b", 8, 9), (2, None, None, None, None), (2, None, None, None, None)])
        assert stage(spark, docs.limit(0), None).count() == 0
