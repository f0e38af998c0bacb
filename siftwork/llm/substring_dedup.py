"""Substring dedup: words of long runs that occur earlier in the corpus are removed.

Any two equal runs of `length` words share, at one and the same shift, a position
of a difference cover in both texts.  So only runs of length - period + 1 words
that start at cover positions (4 in 13 for 20 words) are hashed and gathered.
Positions whose anchor occurs twice or more are then extended to the full windows
around them, these are hashed again by a strong hash, and every window but the
first of its kind, by (id, start), gives its words up.

Anchors and windows travel as packed arrays, one row per batch of texts and
bucket; windows are dealt by the least hash of the short runs inside them, which
neighbouring windows mostly share.  Each batch resolves for itself what it can: of a hash it sends one entry,
so a passage of every document is one entry per batch, never a row per document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, keyed, partitions, width_for

#: Difference covers by period: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
LEAST_ANCHOR = 8
BLOCK_WORDS = 100_000
#: Entries that a task gathers before it packs them by bucket: 256 per bucket, within these bounds.
LEAST_PENDING, MOST_PENDING = 200_000, 4_000_000
#: Text whose entries one task gathers, in two buckets: the number of buckets follows the size of the input.
TASK_BYTES = 128 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
KEY = ["_null", "_k", "_hash"]
OUTPUTS = ["n_words", "n_removed"]


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least LEAST_ANCHOR words."""
    period = max((p for p in COVERS if length - p + 1 >= LEAST_ANCHOR), default=1)
    return period, COVERS[period]


# --- hashing in blocks --------------------------------------------------------


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, text number, position, words left from here) of texts in blocks of bounded size.

    A long text is cut into slices that overlap by length - 1 words, and `left`
    is zero where a window would belong to the next slice.
    """
    words: list[bytes] = []
    parts: list[tuple[int, int, int, int]] = []
    for number, text in enumerate(texts):
        own = text.split()
        for at in range(0, max(len(own) - length + 1, 1), BLOCK_WORDS):
            some = own[at:at + BLOCK_WORDS + length - 1]
            last = at + len(some) == len(own)
            parts.append((number, at, len(some), len(some) if last else BLOCK_WORDS))
            words += some
            if len(words) >= BLOCK_WORDS:
                yield _arrays(words, parts)
                words, parts = [], []
    if words:
        yield _arrays(words, parts)


def _arrays(words, parts):
    number = np.concatenate([np.full(n, i) for i, _, n, _ in parts])
    position = np.concatenate([np.arange(at, at + n) for _, at, n, _ in parts])
    left = np.concatenate([np.where(np.arange(n) < own, n - np.arange(n), 0) for _, _, n, own in parts])
    return words, number, position, left


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Hashes of runs of words: quick ones by prefix sums of a polynomial over the words' bytes, and strong ones.

    A quick hash serves to bring runs together; texts can be made whose quick hashes agree, so what is
    equal is decided by the strong one.
    """

    def __init__(self, words: list[bytes]):
        self.text = b" ".join(words)
        joined = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, len(joined) + 1)[:-1], out=self.sums[1:])
        self.inverse = _powers(pow(MULTIPLIER, -1, 1 << 64), len(joined) + 1)

    def strong(self, first: np.ndarray, size: int) -> np.ndarray:
        """XXH3 of the runs of `size` words that start at `first`."""
        spans = zip(self.starts[first].tolist(), self.ends[first + size - 1].tolist())
        digest, text = xxhash.xxh3_64_intdigest, self.text
        return np.fromiter((digest(text[a:b]) for a, b in spans), np.uint64, len(first))

    def runs(self, first: np.ndarray, size: int) -> np.ndarray:
        """Quick hashes of the runs of `size` words that start at `first`."""
        a, b = self.starts[first], self.ends[first + size - 1]
        x = (self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


# --- packed rows --------------------------------------------------------------

#: kind 0: entries of a bucket; kind 1: positions already known, for the home bucket of their documents.
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])
ROWS_DDL = "bucket int, kind byte, payload binary"
FOUND = pa.schema([("_null", pa.bool_()), ("_k", pa.int64()), ("_hash", pa.int64()), ("found", pa.binary())])
FOUND_DDL = "_null boolean, _k long, _hash long, found binary"
#: Bytes kept of an anchor's hash beside its bucket: a false match costs work, no word.
ANCHOR_BYTES = 5


class Keys:
    """The document keys of a batch as arrays."""

    def __init__(self, null, k, hashes):
        self.null, self.k, self.hash = np.asarray(null, np.uint8), np.asarray(k, np.int64), np.asarray(hashes, np.int64)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Keys:
        return cls(*(batch.column(c).to_numpy(zero_copy_only=False) for c in KEY))

    def take(self, index) -> Keys:
        return Keys(self.null[index], self.k[index], self.hash[index])


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low `width` bytes of whole numbers, all first bytes, then all second bytes, ...: high ones compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _differences(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype(np.int64), prepend=np.int64(0)).astype(np.uint64)


def packed(hashes: list[np.ndarray], widths: list[int], number: np.ndarray, position: np.ndarray, flag: np.ndarray, keys: Keys) -> bytes:
    """Entries in the order of text and position, with the keys of the texts they name.

    Each column is written as differences in byte planes, which shuffle compression
    makes small; the first hash repeats in runs and is written against the one before.
    """
    order = np.lexsort((position, number))
    used, counts = np.unique(number, return_counts=True)
    own = keys.take(used)
    columns = [h[order] for h in hashes]
    if columns:
        columns[0] = columns[0] ^ np.concatenate([np.zeros(1, np.uint64), columns[0][:-1]])
    head = struct.pack("<III", len(number), len(used), len(hashes))
    return head + bytes(widths) + b"".join((
        *(_planes(h, w) for h, w in zip(columns, widths)),
        _planes(counts, 4), _planes(_differences(position[order]), 5), flag[order].astype(np.uint8).tobytes(),
        own.null.tobytes(), _planes(_differences(own.k)), own.hash.tobytes()))


def unpacked(payload: bytes):
    """(hashes, text number, position, flag, keys) of a packed row."""
    entries, docs, families = struct.unpack_from("<III", payload)
    widths = payload[12:12 + families]
    at = 12 + families

    def read(kind, count):
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    def planes(count, width):
        out = np.zeros((count, 8), np.uint8)
        out[:, :width] = read(np.uint8, count * width).reshape(width, count).T
        return out.view("<u8").reshape(count)

    hashes = [planes(entries, w) for w in widths]
    if hashes:
        hashes[0] = np.bitwise_xor.accumulate(hashes[0])
    place = np.repeat(np.arange(docs), planes(docs, 4).astype(np.int64))
    # Differences are of 40 bits, negative ones where a text begins.
    steps = (planes(entries, 5).astype(np.int64) << 24) >> 24
    position, flag = np.cumsum(steps), read(np.uint8, entries)
    return hashes, place, position, flag, Keys(read(np.uint8, docs), np.cumsum(planes(docs, 8).astype(np.int64)), read("<i8", docs))


def gathered(payloads: list[bytes]):
    """The entries of several packed rows as one; text numbers count on."""
    parts, base, columns = [unpacked(p) for p in payloads], 0, [[], [], []]
    for _, place, position, flag, keys in parts:
        columns[0].append(place.astype(np.int64) + base)
        columns[1].append(position)
        columns[2].append(flag)
        base += len(keys.k)
    hashes = [np.concatenate([p[0][f] for p in parts]) for f in range(len(parts[0][0]))]
    keys = Keys(*(np.concatenate([getattr(p[4], c) for p in parts]) for c in ("null", "k", "hash")))
    return hashes, *(np.concatenate(c) for c in columns), keys


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, index of its entries) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b]:cuts[b + 1]]


def to_homes(number: np.ndarray, position: np.ndarray, keys: Keys, homes: int) -> Iterator[tuple[int, bytes]]:
    """(home bucket, packed positions) of found positions; a document's home follows from its key."""
    for home, some in by_bucket(keys.hash[number] % homes, homes):
        yield home, packed([], [], number[some], position[some], np.zeros(len(some), bool), keys)


def by_document(payloads: list[bytes]) -> list[tuple]:
    """(key, packed positions) of each document of a home bucket."""
    _, number, position, _, keys = gathered(payloads)
    names, first, place = np.unique(np.rec.fromarrays([keys.null, keys.k, keys.hash]), return_index=True, return_inverse=True)
    number = place[number]
    order = np.lexsort((position, number))
    number, position = number[order], position[order].astype("<u4")
    cuts = np.searchsorted(number, np.arange(len(names) + 1)).tolist()
    return [(bool(keys.null[i]), int(keys.k[i]), int(keys.hash[i]), position[cuts[n]:cuts[n + 1]].tobytes())
            for n, i in enumerate(first.tolist())]


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                      [pa.array([], f.type) for f in schema], schema=schema)


def _sent(bucket, hashes, widths, number, position, flag, keys, known, buckets: int, homes: int) -> pa.RecordBatch:
    """Rows for gathered entries, one per bucket, and for the positions already known, one per home."""
    rows = [(b, 0, packed([h[some] for h in hashes], widths, number[some], position[some], flag[some], keys))
            for b, some in by_bucket(bucket, buckets)]
    return rows_of(ROWS, rows + [(home, 1, payload) for home, payload in to_homes(*known, keys, homes)])


class Pending:
    """Entries of several blocks that wait until a packed row per bucket is worth while."""

    def __init__(self, buckets: int):
        self.limit = min(MOST_PENDING, max(LEAST_PENDING, 256 * buckets))
        self.clear()

    def clear(self) -> None:
        self.size, self.base, self.documents, self.keys, self.entries = 0, 0, 0, [], []

    def batch(self, keys: Keys) -> None:
        self.base = self.documents
        self.documents += len(keys.k)
        self.keys.append(keys)

    def add(self, hashes: list[np.ndarray], number: np.ndarray, position: np.ndarray) -> bool:
        """True once enough is held."""
        self.entries.append((hashes, number + self.base, position))
        self.size += len(number)
        return self.size >= self.limit

    def take(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, Keys]:
        hashes = [np.concatenate(h) for h in zip(*(e[0] for e in self.entries))]
        number, position = (np.concatenate([e[i] for e in self.entries]) for i in (1, 2))
        keys = Keys(*(np.concatenate([getattr(k, c) for k in self.keys]) for c in ("null", "k", "hash")))
        last = self.keys[-1]
        self.clear()
        self.batch(last)
        return hashes, number, position, keys


# --- the four steps -----------------------------------------------------------


def _send_all(batches: Iterator[pa.RecordBatch], entries_of, send, buckets: int, homes: int) -> Iterator[pa.RecordBatch]:
    pending = Pending(buckets)
    for batch in batches:
        pending.batch(Keys.of(batch))
        for entries in entries_of(batch):
            if pending.add(*entries):
                yield send(*pending.take(), buckets, homes)
    if pending.size:
        yield send(*pending.take(), buckets, homes)


def anchors_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(hashes, text numbers, positions) of the anchors of each block."""
    period, cover = cover_for(length)
    size = length - period + 1
    member = np.zeros(period, bool)
    member[list(cover)] = True
    for words, number, position, left in blocks(_texts(batch), length):
        first = np.flatnonzero(member[position % period] & (left >= size))
        if len(first):
            yield [Hasher(words).runs(first, size)], number[first], position[first]


def send_anchors(hashes, number, position, keys, buckets: int, homes: int) -> pa.RecordBatch:
    """Anchors seen twice here are known; of each hash one entry is sent, flagged if it was seen twice."""
    _, entry, place, count = np.unique(hashes[0], return_index=True, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    h = hashes[0][entry]
    bucket = (h >> np.uint64(8 * ANCHOR_BYTES)) % np.uint64(buckets)
    return _sent(bucket.astype(np.int64), [h & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)], [ANCHOR_BYTES], number[entry], position[entry],
                 count > 1, keys, (number[twice], position[twice]), buckets, homes)


def repeated_anchors(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, Keys]:
    """Positions whose anchor occurs in another row too."""
    (h,), number, position, flag, keys = gathered(payloads)
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    # Flagged entries were seen twice where they come from, and are known there.
    hit = (count[place] > 1) & (flag == 0)
    return number[hit], position[hit], keys


def _firsts(hashes, number, position, keys) -> tuple[np.ndarray, np.ndarray]:
    """(first entries, later entries): of equal hashes the first by (null, id, text hash, position).

    An entry of the same document and position as the first is neither.
    """
    null, k, text = keys.null[number], keys.k[number], keys.hash[number]
    order = np.lexsort((position, text, k, null, *reversed(hashes)))
    new = np.ones(len(order), bool)
    same = np.ones(len(order) - 1, bool)
    for h in hashes:
        same &= h[order][1:] == h[order][:-1]
    new[1:] = ~same
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other = ((k[head] != k[order]) | (text[head] != text[order]) | (null[head] != null[order])
             | (position[head] != position[order]))
    return order[new], order[~new & other]


def windows_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """([least short-run hash, window hash], text numbers, positions) of the windows around repeated anchors."""
    period, _ = cover_for(length)
    size = length - period + 1
    anchors = [np.unique(np.frombuffer(p, "<u4")).astype(np.int64) for p in batch.column("found").to_pylist()]
    for words, number, position, left in blocks(_texts(batch), length):
        wanted = np.zeros(len(words), bool)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).tolist()
        for at, end in zip(begins, begins[1:]):
            low, count = int(position[at]), end - at
            some = anchors[number[at]]
            some = some[(some >= low) & (some < low + count + period)] - low
            for shift in range(period):
                place = some - shift
                wanted[at + place[(place >= 0) & (place < count)]] = True
        first = np.flatnonzero(wanted & (left >= length))
        if len(first):
            hasher = Hasher(words)
            short = hasher.runs(np.arange(len(words) - size + 1), size)
            least = np.lib.stride_tricks.sliding_window_view(short, period)[first].min(axis=1)
            yield [least, hasher.strong(first, length)], number[first], position[first]


def send_windows(hashes, number, position, keys, buckets: int, homes: int) -> pa.RecordBatch:
    """Windows that are not the first of their kind here are known; the first ones are sent."""
    ours, later = _firsts(hashes, number, position, keys)
    bucket = (hashes[0][ours] % np.uint64(buckets)).astype(np.int64)
    return _sent(bucket, [h[ours] for h in hashes], [8, 8], number[ours], position[ours], np.zeros(len(ours), bool), keys,
                 (number[later], position[later]), buckets, homes)


def later_windows(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, Keys]:
    """Positions of windows that are not the first of their kind."""
    hashes, number, position, _, keys = gathered(payloads)
    _, later = _firsts(hashes, number, position, keys)
    return number[later], position[later], keys


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() if t else b"" for t in batch.column("_text").to_pylist()]


def _resolved(rows: DataFrame, resolve, homes: int) -> DataFrame:
    """(KEY, found: packed positions) per document, from known positions and what `resolve` finds per bucket.

    What a bucket finds goes to its documents in packed rows too, one per home
    bucket, where the positions of each document come together.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def resolved():
            return rows_of(ROWS, [(home, 1, payload) for home, payload in to_homes(*resolve(held), homes)])

        for batch in batches:
            known = []
            for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    known.append((bucket, 1, payload))
                    continue
                if held and bucket != current:
                    yield resolved()
                    held = []
                current = bucket
                held.append(payload)
            yield rows_of(ROWS, known)
        if held:
            yield resolved()

    def bring_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, _, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if held and bucket != current:
                    yield rows_of(FOUND, by_document(held))
                    held = []
                current = bucket
                held.append(payload)
        if held:
            yield rows_of(FOUND, by_document(held))

    tasks = max(partitions(rows), homes // 2)
    # Numbered buckets are dealt evenly; hashes of so few numbers would put several into one task.
    task = F.col("bucket") % tasks
    found = rows.repartitionById(tasks, task).sortWithinPartitions("kind", "bucket").mapInArrow(find, ROWS_DDL)
    return found.repartitionById(tasks, task).sortWithinPartitions("bucket").mapInArrow(bring_home, FOUND_DDL)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Null ids come last; rows of one id and text are one document."""
    return [F.col(id_col).isNull().alias("_null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_k"),
            F.xxhash64(text_col).alias("_hash")]


def repeated_starts(rows: DataFrame, length: int) -> DataFrame:
    """(KEY, found: packed start positions of windows that occur earlier) from rows (KEY, _text, ...).

    The rows are joined as they are, further columns included: the join that ends
    `remove_repeats` then uses the same shuffle of the texts a second time.
    """
    buckets = homes = 2 * width_for(rows, "_text", TASK_BYTES)
    ask = rows.mapInArrow(
        lambda batches: _send_all(batches, lambda b: anchors_of(b, length), send_anchors, buckets, homes), ROWS_DDL)
    anchors = _resolved(ask, repeated_anchors, homes)
    around = rows.join(anchors, KEY).mapInArrow(
        lambda batches: _send_all(batches, lambda b: windows_of(b, length), send_windows, buckets, homes), ROWS_DDL)
    return _resolved(around, later_windows, homes)


def covered(size: int, packed_starts: bytes | None, length: int) -> np.ndarray:
    """Which of `size` words lie in a window that starts at a packed position."""
    steps = np.zeros(size + 1, np.int64)
    if packed_starts:
        starts = np.unique(np.frombuffer(packed_starts, "<u4")).astype(np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def kept_text(text: str, drop: np.ndarray, join_words: bool) -> str:
    """The text without the dropped words, joined by spaces or with its own layout around the rest."""
    data = text.encode()
    words = data.split()
    if join_words:
        return b" ".join(w for w, d in zip(words, drop.tolist()) if not d).decode()
    if not drop.any():
        return text
    blank = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    # A dropped word goes with the blanks up to the next word; leading blanks stay.
    ends = np.append(starts[1:], len(data))
    return (data[:starts[0]] + b"".join(data[a:b] for a, b, d in zip(starts.tolist(), ends.tolist(), drop.tolist()) if not d)).decode()


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   join_words: bool = False) -> DataFrame:
    """The documents without words covered by a window of `length` words that also starts earlier.

    Earlier: in a smaller id, or further ahead in the same document.  Windows are
    judged on the input.  Adds n_words (before) and n_removed; input columns of
    these names are replaced.  A null text counts as no words and stays null
    unless `join_words`, which joins all kept words by one space; otherwise the
    rest keeps its layout.  Null ids come last, ties of one id go by text hash,
    and rows equal in id and text are one document with equal results.
    """
    rows = keyed(docs, id_col, text_col).select("_text", "_row", *_keys("_id", "_text"))
    starts = repeated_starts(rows, length)

    @F.arrow_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def cut(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in pairs:
            out = []
            for text, some in zip(texts.to_pylist(), found.to_pylist()):
                size = len((text or "").encode().split())
                drop = covered(size, some, length)
                kept = None if text is None and not join_words else kept_text(text or "", drop, join_words)
                out.append((kept, size, int(drop.sum())))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))]
                                             if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())],
                                             names=["text", "n_words", "n_removed"])

    joined = rows.join(starts, KEY, "left").withColumn("_cut", cut("_text", "found"))
    return joined.select(F.col("_cut.text").alias("_text"), "_row", "_cut.n_words", "_cut.n_removed").select(
        *carried(docs, text_col, OUTPUTS), *OUTPUTS)
