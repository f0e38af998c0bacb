"""Packing documents into sequences by an order-preserving dynamic program.

Documents stay in the order in which they come; the stream of their ids is cut
into windows of at most `length` ids.  Cuts may fall at document ends, sentence
ends or, dearer, anywhere on a coarse grid; the program minimises padding plus
these penalties.  For windows that are padded to the full length the best start
of a window is a sliding minimum, kept in a monotone queue; a few windows of
power-of-two length need no padding and are looked up directly.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import column
from .segments import segmented

#: Penalties in tokens of padding: a cut at a sentence end, a cut inside a
#: sentence, and a sequence shorter than the full length.
AT_SENTENCE, INSIDE, SHORT = 12, 96, 64
#: Sentence ends nearer than this to the last candidate are passed over; longer
#: stretches without one get candidates on a grid.
NEAR, GRID = 24, 192
#: A run of the program ends at the first document end after so many ids.
SEGMENT = 1 << 20
SENTENCE_ENDS = ".!?…。！？"
#: Words whose ids a worker remembers; packing meets them in the order of the input, so rare ones come back late.
STORE_WORDS = 700_000


def sentence_ends(path: str) -> np.ndarray:
    """Per token id: does it close a sentence?"""
    vocabulary = segmented(path, False, STORE_WORDS).library.get_vocab()
    table = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for token, number in vocabulary.items():
        core = token.removesuffix("</w>")
        table[number] = bool(core) and all(c in SENTENCE_ENDS for c in core)
    return table


def _tail(size: int, length: int) -> tuple[int, bool]:
    """Cost of a last window, and whether to cut it into powers of two."""
    if size == length or size & (size - 1) == 0:
        return 0, False
    split = (size.bit_count() - 1) * INSIDE
    return min(length - size, split), split < length - size


def cut_points(stops: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """The positions of the best cuts; `stops` ascend from 0 to the end of the segment."""
    pos, pen = stops.tolist(), penalties.tolist()
    cost, came = [0.0] * len(pos), [0] * len(pos)
    # Where a window of a power of two could start, for the few stops that have such a place.
    starts: dict[int, list[int]] = {}
    for size in (1 << k for k in range(9, length.bit_length()) if 1 << k < length):
        at = np.searchsorted(stops, stops - size)
        hits = np.flatnonzero(stops[at] == stops - size)
        for j, i in zip(hits.tolist(), at[hits].tolist()):
            starts.setdefault(j, []).append(i)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    last = len(pos) - 1
    for j in range(1, len(pos)):
        end = pos[j]
        while pos[queue[0][1]] < end - length:
            queue.popleft()
        best, start = queue[0]
        best += length - end
        for i in starts.get(j, ()):
            if cost[i] + SHORT < best:
                best, start = cost[i] + SHORT, i
        if j == last:
            for i in range(j - 1, -1, -1):
                if end - pos[i] > length:
                    break
                tail = cost[i] + _tail(end - pos[i], length)[0]
                if tail < best:
                    best, start = tail, i
        cost[j], came[j] = best + pen[j], start
        value = cost[j] + end
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], last
    while j:
        cuts.append(pos[j])
        j = came[j]
    cuts = [0, *reversed(cuts)]
    size = cuts[-1] - cuts[-2]
    if _tail(size, length)[1]:
        at, extra = cuts[-2], []
        for k in range(size.bit_length() - 1, 0, -1):
            if size >> k & 1:
                at += 1 << k
                extra.append(at)
        cuts[-1:] = extra if extra[-1] == cuts[-1] else [*extra, cuts[-1]]
    return cuts


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and the penalty of each place."""
    is_doc, is_sentence = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
    is_doc[doc_ends] = True
    is_sentence[1:] = ends[ids]
    is_stop = is_doc | is_sentence
    is_stop[0] = True
    marks = np.flatnonzero(is_stop)
    # A mark far enough from the one before it stays in any case; only the others are gone through.
    keep, previous = np.ones(len(marks), bool), 0
    near = np.flatnonzero((np.diff(marks) < NEAR) & ~is_doc[marks[1:]]) + 1
    for k, before, p in zip(near.tolist(), marks[near - 1].tolist(), marks[near].tolist()):
        if keep[k - 1]:
            previous = before
        keep[k] = p - previous >= NEAR
    marks = marks[keep]
    gaps = np.diff(marks)
    grid = [np.arange(a + GRID, a + g, GRID) for a, g in zip(marks[:-1][gaps > GRID].tolist(), gaps[gaps > GRID].tolist())]
    stops = np.sort(np.concatenate([marks, *grid])) if grid else marks
    return stops, np.where(is_doc[stops], 0, np.where(is_sentence[stops], AT_SENTENCE, INSIDE))


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(keys: list, blobs: list[bytes], ends: np.ndarray, length: int, first_sequence: int) -> tuple[list, int]:
    """Rows of PIECES for one segment, and the number of its sequences."""
    stream = b"".join(blobs)
    doc_ends = np.cumsum([len(b) // 4 for b in blobs])
    cuts = cut_points(*candidates(np.frombuffer(stream, "<u4"), doc_ends, ends), length)
    rows, window, doc_start = [], 0, 0
    for key, doc_end in zip(keys, doc_ends.tolist()):
        at = doc_start
        while at < doc_end:
            if at >= cuts[window + 1]:
                window += 1
                continue
            upto = min(doc_end, cuts[window + 1])
            rows.append((key, at - doc_start, upto - at, stream[4 * at:4 * upto], doc_end - doc_start,
                         first_sequence + window, at - cuts[window]))
            at = upto
        doc_start = doc_end
    return rows, len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset) per piece of a document.

    A null text is empty and gives the end token alone; a null id stays null;
    repeated rows are packed as often as they occur; an empty table gives no
    row.  Other input columns are not read.

    Documents are packed within the partition they are read in, in its order:
    no shuffle, and only the last window of a partition may be short.  That
    window is cut into powers of two where this saves padding.  A task holds
    about a million ids, or one document if that is longer.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = segmented(tokenizer, False, STORE_WORDS), sentence_ends(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        sequence, keys, blobs, size = TaskContext.get().partitionId() << 33, [], [], 0

        def flush():
            nonlocal sequence, keys, blobs, size
            rows, used = _pieces(keys, blobs, ends, length, sequence)
            sequence, keys, blobs, size = sequence + used, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                keys.append(key)
                blobs.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
