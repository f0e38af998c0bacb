"""SentencePiece encoding and decoding in numpy batches of equal-length words.

Hashes of all substrings of a batch probe the sorted keys of the vocabulary.  For
unigram models the words of one length advance together through the Viterbi
recursion: vectorised maxima over the piece lengths store backpointers.  BPE
models are not maxima of sums of scores, so for them the same table of substring
pieces drives the merges: every round merges the best pair of each word at once.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import carried, keyed
from .segments import Store

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What a character outside the vocabulary scores below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Longest word whose merges run in a batch, and characters of one batch.
BATCH_LENGTH, BATCH_CHARS = 48, 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
OUTPUTS = ["n_pieces", "piece_ids"]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message: numbers raw, strings and messages as bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Model:
    """Pieces, scores and settings of a model file, and the tables for batches."""

    def __init__(self, path: str, store_size: int = 300_000):
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        self.path, self.pieces, scores, kinds = path, [], [], []
        for _, message in (p for p in parts if p[0] == 1):
            own = dict(fields(message))
            self.pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
        trainer = dict(fields(next((v for n, v in parts if n == 2), b"")))
        normal = dict(fields(next((v for n, v in parts if n == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.dummy_prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.plain = not normal.get(2) and normal.get(5, 1) and not self.squeeze and not trainer.get(24, 0)
        self.scores, self.kinds = np.array(scores, np.float32), np.array(kinds)
        if self.kind not in (UNIGRAM, BPE) or (self.kinds == USER).any() or (self.kinds == UNUSED).any():
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        bytes_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_ids = [bytes_of.get(f"<0x{b:02X}>") for b in range(256)] if bytes_of else None
        usable = np.flatnonzero((self.kinds == NORMAL) & np.array([bool(p) for p in self.pieces]))
        self.ids = {self.pieces[i]: int(i) for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = float(self.scores[usable].min()) - UNKNOWN_PENALTY if len(usable) else 0.0
        # No piece may span the border between two words.
        split = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if split else r"(?s).+")
        keys = [self._hash(np.frombuffer(p.encode("utf-32-le"), "<u4")[None, :]) for p in self.ids]
        first = np.array([k[0][0, -1] for k in keys], np.uint64)
        second = np.array([k[1][0, -1] for k in keys], np.uint64)
        order = np.argsort(first)
        self.first, self.second = first[order], second[order]
        self.key_ids = np.array(list(self.ids.values()), np.int32)[order]
        if len(np.unique(first)) < len(first):
            raise ValueError("two pieces share a key")
        self.outputs = [self._output(i) for i in range(len(self.pieces))]
        self.store = Store(store_size)
        self.library = None

    @staticmethod
    def _hash(codes: np.ndarray) -> list[np.ndarray]:
        """Per family: prefix sums with the length mixed in, for keys of whole rows."""
        out = []
        for base in BASES:
            powers = _powers(base, codes.shape[1])
            out.append(np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, axis=1))
        return out

    def _output(self, number: int) -> bytes:
        if self.kinds[number] == BYTE:
            return bytes([int(self.pieces[number][3:5], 16)])
        if self.kinds[number] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[number] == UNKNOWN else self.pieces[number].replace(BLANK, " ").encode()

    # --- pieces of all substrings --------------------------------------------

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids (-1: none) of codes[r, i:i + l + 1] as an array [r, i, l]."""
        rows, length = codes.shape
        widest = min(self.longest, length)
        out = np.full((rows, length, widest), -1, np.int32)
        sums, inverses = [], []
        for base, prefix in zip(BASES, self._hash(codes)):
            sums.append(np.concatenate([np.zeros((rows, 1), np.uint64), prefix], axis=1))
            inverses.append(_powers(pow(base, -1, 1 << 64), length))
        for size in range(1, widest + 1):
            starts = length - size + 1
            a, b = ((s[:, size:] - s[:, :starts]) * v[:starts] for s, v in zip(sums, inverses))
            at = np.minimum(np.searchsorted(self.first, a), len(self.first) - 1)
            hit = (self.first[at] == a) & (self.second[at] == b)
            out[:, :starts, size - 1] = np.where(hit, self.key_ids[at], -1)
        return out

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Backpointers of the best segmentations: where the piece that ends at each position starts."""
        rows, length = codes.shape
        table = self.substrings(codes)
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(end, table.shape[2]), 0, -1)
            piece = table[:, end - sizes, sizes - 1]
            value = best[:, end - sizes] + np.where(piece >= 0, self.scores[piece].astype(float), -np.inf)
            # A character that is no piece itself may stand alone, at a price.
            value[:, -1] = np.where(piece[:, -1] < 0, best[:, end - 1] + self.floor, value[:, -1])
            pick = value.argmax(axis=1)
            best[:, end], back[:, end] = value[np.arange(rows), pick], end - sizes[pick]
        return back

    def merges(self, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Ends of the symbols that start at each position (-1: none starts) after all merges."""
        rows, length = codes.shape
        ends = np.tile(np.arange(1, length + 1), (rows, 1))
        active = np.arange(rows)
        places = np.arange(length)
        while len(active):
            own = ends[active]
            after = np.where((own >= 0) & (own < length), np.take_along_axis(own, np.clip(own, 0, length - 1), 1), -1)
            size = after - places
            fits = (after >= 0) & (size <= table.shape[2])
            piece = np.where(fits, table[active[:, None], places, np.clip(size - 1, 0, table.shape[2] - 1)], -1)
            value = np.where(piece >= 0, self.scores[piece], -np.inf)
            pick = value.argmax(axis=1)
            going = value[np.arange(len(active)), pick] > -np.inf
            active, pick = active[going], pick[going]
            middle = ends[active, pick]
            ends[active, pick] = after[going][np.arange(len(active)), pick]
            ends[active, middle] = -1
        return ends

    def merge_long(self, word: str) -> list[int]:
        """The same merges for one long word, with a heap."""
        size = len(word)
        ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a):
            middle = ends[a]
            if middle < size and (piece := self.ids.get(word[a:ends[middle]])) is not None:
                heapq.heappush(heap, (-float(self.scores[piece]), a, ends[middle]))

        for i in range(size):
            offer(i)
        alive = [True] * size
        while heap:
            _, a, end = heapq.heappop(heap)
            if not alive[a] or ends[a] >= size or ends[ends[a]] != end or not alive[ends[a]]:
                continue
            alive[ends[a]] = False
            ends[a] = end
            if end < size:
                before[end] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        cuts = [i for i in range(size) if alive[i]]
        return [*cuts, size]

    # --- words and texts ------------------------------------------------------

    def _ids(self, word: str, cuts: list[int]) -> bytes:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            piece = self.ids.get(word[a:b])
            if piece is not None:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[x] for x in word[a:b].encode()]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        known, by_length = {}, {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            if self.kind == BPE and length > BATCH_LENGTH:
                known.update((w, self._ids(w, self.merge_long(w))) for w in group)
                continue
            step = max(1, BATCH_CHARS // (length * min(length, self.longest)))
            for at in range(0, len(group), step):
                some = group[at:at + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(len(some), length)
                if self.kind == BPE:
                    table = self.substrings(codes)
                    ends = self.merges(codes, table)
                    row, start = np.nonzero(ends >= 0)
                    piece = table[row, start, ends[row, start] - start - 1]
                    cuts = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
                    missing = np.zeros(len(some), bool)
                    missing[row[piece < 0]] = True
                    data = piece.astype("<u4").tobytes()
                    for i, word in enumerate(some):
                        known[word] = (self._ids(word, [*start[cuts[i]:cuts[i + 1]].tolist(), length]) if missing[i]
                                       else data[4 * cuts[i]:4 * cuts[i + 1]])
                else:
                    for word, row in zip(some, self.viterbi(codes).tolist()):
                        cuts = [length]
                        while cuts[-1]:
                            cuts.append(row[cuts[-1]])
                        known[word] = self._ids(word, cuts[::-1])
        return known

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)
        if self.library is None:  # character maps and squeezing are the library's
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.library.normalize(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; null is empty."""
        out, batch, size = [], [], 0
        for text in texts:
            batch.append(self.words.findall(self.normalise(text or "")))
            size += len(text or "")
            if size > 1 << 20:
                out += self._known(batch)
                batch, size = [], 0
        return out + self._known(batch)

    def _known(self, batch: list[list[str]]) -> list[bytes]:
        known = self.store.fill(set().union(*batch), self.encode_words)
        return [b"".join(map(known.__getitem__, words)) for words in batch]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.outputs.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (data[1:] if self.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with n_pieces and piece_ids (binary, little-endian unsigned 32-bit).

    Ids are those of the sentencepiece library for the model at `path`, without
    begin and end pieces.  A null text has no ids.  Input columns named like an
    output are replaced.  Nothing is shuffled; each worker process remembers the
    ids of words in a store of bounded size.
    """
    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model(path).encode(batch.to_pylist()), pa.binary())

    rows = keyed(docs, docs.columns[0], text_col).withColumn("piece_ids", encoded("_text"))
    return rows.select(*carried(docs, text_col, OUTPUTS), (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"), "piece_ids")


def decode_pieces(rows: DataFrame, path: str, output: str = "decoded") -> DataFrame:
    """`rows` (with piece_ids) and the text of the ids; null ids give a null text, broken bytes U+FFFD."""
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if b is None else model(path).decode(b) for b in batch.to_pylist()], pa.string())

    return rows.withColumn(output, decoded("piece_ids"))


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The documents with n_pieces, ids_crc32 and round_trip (decoding gives the text back).

    Both directions run in one Python pass and only these three values leave it.
    """
    @F.arrow_udf("struct<n_pieces:bigint,ids_crc32:bigint,round_trip:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, own = batch.to_pylist(), model(path)
            ids = own.encode(texts)
            yield pa.StructArray.from_arrays(
                [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                 pa.array([own.decode(b) == (t or "") for b, t in zip(ids, texts)], pa.bool_())],
                names=["n_pieces", "ids_crc32", "round_trip"])

    names = ["n_pieces", "ids_crc32", "round_trip"]
    rows = keyed(docs, docs.columns[0], text_col).withColumn("_both", both("_text"))
    return rows.select(*carried(docs, text_col, names), "_both.*")
