"""The trie of shared conversation prefixes, from sorted sequences and their common prefixes.

A turn is a 128-bit digest, a conversation the sequence of its turns' digests.  Sequences are
sorted over the cluster; the members of a trie node are then a run of neighbours whose
common prefixes (LCPs) all reach the node's depth.  Within a task a sparse table answers
range minima over the LCPs, and every prefix finds the left and the right end of its run by a
binary search of its own.

What a node reports is a sum (or minimum) over its members once each sequence knows the LCPs
to both neighbours, so a run may be cut anywhere: tasks work on bounded stretches of the order,
and a node that spans stretches is the sum of its rows.  A hot prefix is therefore never
gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwork.session import materialise

from .common import column, partitions

DIGEST = 16
#: Most turns (plus conversations) of one stretch, unless a single conversation has more, and most
#: conversations of one piece of the list of a node's ends.
STRETCH, PIECE = 1 << 18, 1 << 16
BEFORE, OWN, AFTER = 0, 1, 2
NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
                   ("ends", pa.string())])


def shared(a: bytes, b: bytes) -> int:
    """Number of turns that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:DIGEST * high] == b[:DIGEST * high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[DIGEST * low:DIGEST * middle] == b[DIGEST * low:DIGEST * middle]:
            low = middle
        else:
            high = middle
    return low


class SparseTable:
    """Range minima: level k holds the minimum of every run of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << len(self.levels) - 1) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], ends included, for arrays of ranges."""
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            here = level == k
            out[here] = np.minimum(self.levels[k][first[here]], self.levels[k][last[here] + 1 - (1 << k)])
        return out

    def reach_right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest e with values[start..e-1] all at `bound` or more."""
        end = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = end + (1 << k) <= len(self.levels[0])
            fits[fits] = self.levels[k][end[fits]] >= bound[fits]
            end[fits] += 1 << k
        return end

    def reach_left(self, stop: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest s with values[s..stop-1] all at `bound` or more."""
        start = stop.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = start - (1 << k) >= 0
            fits[fits] = self.levels[k][start[fits] - (1 << k)] >= bound[fits]
            start[fits] -= 1 << k
        return start


class Stretch:
    """Neighbours in the sorted order, copies combined, between the sequences `before` and `after` (None: no such)."""

    def __init__(self, rows: list[tuple[bytes, int, np.ndarray]], before: bytes | None, after: bytes | None):
        self.seqs: list[bytes] = []
        self.ids: list[list[int]] = []
        chars: list[np.ndarray] = []
        for seq, conv, lengths in rows:
            if self.seqs and self.seqs[-1] == seq:
                self.ids[-1].append(conv)
            else:
                self.seqs.append(seq)
                self.ids.append([conv])
                chars.append(lengths)
        self.sizes = np.array([len(s) // DIGEST for s in self.seqs], np.int64)
        inner = [shared(a, b) for a, b in zip(self.seqs, self.seqs[1:])]
        # lcp[g] is shared by g - 1 and g; at the ends with the neighbours outside.
        self.lcp = np.array([-1 if before is None else shared(before, self.seqs[0]), *inner,
                             -1 if after is None else shared(self.seqs[-1], after)], np.int64)
        # Code points up to each depth, one run of size + 1 numbers per sequence.
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.chars = np.concatenate([np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in chars])

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, depth) of the members of every distinct prefix."""
        table = SparseTable(self.lcp[1:-1])
        own = np.repeat(np.arange(len(self.seqs)), self.sizes + 1)
        depth = np.arange(self.at[-1]) - self.at[own]
        left, right = table.reach_left(own, depth), table.reach_right(own, depth)
        once = left == own
        return left[once], right[once], depth[once]

    def nodes(self) -> list[list]:
        """Columns of NODES, without the ends."""
        first, last, depth = self.intervals()
        copies = np.array([len(i) for i in self.ids], np.int64)
        count = np.concatenate([[0], np.cumsum(copies)])
        n_convs = count[last + 1] - count[first]
        least = SparseTable(np.array([i[0] for i in self.ids], np.int64)).least(first, last)

        def added(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return sums[last + 1] - sums[first]

        # A sequence is a leaf where the next one does not go on from it; the last of its copies counts.
        n_leaves = added(self.lcp[1:] < self.sizes)
        # A member after the first opens a child where its LCP is the depth; the first one if it is longer and nothing
        # before this stretch opened it.
        groups = len(self.seqs)
        places = np.sort(np.maximum(self.lcp[:-1], 0) * groups + np.arange(groups))
        inside = np.searchsorted(places, depth * groups + last + 1) - np.searchsorted(places, depth * groups + first + 1)
        n_children = inside + ((self.sizes[first] > depth) & (self.lcp[first] <= depth))
        # Code points of all members from this depth on, less those of each distinct node once.
        whole = self.chars[self.at[1:] - 1]
        upto = lambda rows, d: self.chars[self.at[rows] + np.maximum(d, 0)]
        members = added(copies * whole) - n_convs * upto(first, depth - 1)
        new = whole - upto(np.arange(groups), self.lcp[:-1])
        distinct = added(new) - new[first] + whole[first] - upto(first, np.maximum(self.lcp[first], depth - 1))
        keys, parents = [], []
        own = -1
        for g, d in zip(first.tolist(), depth.tolist()):
            seq = self.seqs[g]
            if g != own:
                own, chain = g, hashlib.sha256(seq[:DIGEST * max(d - 1, 0)])
                parent = chain.digest()[:DIGEST] if d else None
            if d:
                chain.update(seq[DIGEST * (d - 1):DIGEST * d])
            keys.append(chain.digest()[:DIGEST])
            parents.append(parent)
            parent = keys[-1]
        return [keys, parents, depth, least, n_convs, n_children, n_leaves, members - distinct]

    def ends(self) -> list[tuple[bytes, int, str]]:
        """(key, first id, ascending ids joined) of the conversations that end in each node, in pieces."""
        return [(hashlib.sha256(seq).digest()[:DIGEST], ids[a], ",".join(map(str, ids[a:a + PIECE])))
                for seq, ids in zip(self.seqs, self.ids) for a in range(0, len(ids), PIECE)]

    def batch(self) -> pa.RecordBatch:
        keys, parents, *numbers = self.nodes()
        ends = self.ends()
        none = [None] * len(ends)
        columns = [keys + [e[0] for e in ends], parents + none, *[n.tolist() + none for n in numbers],
                   [None] * len(keys) + [e[2] for e in ends]]
        columns[3][len(keys):] = [e[1] for e in ends]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODES)], schema=NODES)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, place, seq, conv_id, chars) in order to rows of NODES."""
    held: list[tuple[bytes, int, np.ndarray]] = []
    part, before, size = None, None, 0
    for batch in batches:
        chars = batch.column(4)
        values, offsets = chars.values.to_numpy(), chars.offsets.to_numpy()
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for i, (at, place, seq, conv) in enumerate(rows):
            if at != part:
                if held:
                    yield Stretch(held, before, None).batch()
                part, held, before, size = at, [], None, 0
            if place == BEFORE:
                before = seq
            elif place == AFTER or size > STRETCH:
                if held:
                    yield Stretch(held, before, seq).batch()
                    before = held[-1][0]
                held, size = [], 0
            if place == OWN:
                held.append((seq, conv, values[offsets[i]:offsets[i + 1]].copy()))
                size += len(seq) // DIGEST + 1
    if held:
        yield Stretch(held, before, None).batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, first, ends), all of a key together and in order, to (key, ends_sha256)."""
    names, key, hasher = ["key", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if hasher is not None:
                    done.append((key, hasher.hexdigest()))
                key, hasher = k, hashlib.sha256(text.encode())
            else:
                hasher.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=names)
    if hasher is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hasher.hexdigest()])], names=names)


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id long, turns array<struct<digest, chars>>) per conversation, in the order of `turn`, null first.

    A null role or text is empty; turns of equal number go by digest, so repeated rows are
    turns of their own.  Rows without a conversation id belong to none.  Texts leave as 16 bytes of
    their SHA-256 and a length before anything moves: a conversation of n turns is one
    row of about 60 n bytes.
    """
    role, text = F.coalesce(column(role_col), F.lit("")), F.coalesce(column(text_col), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST))
    rows = turns.where(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("conv_id"), column(turn_col).alias("turn"), digest.alias("digest"),
        F.char_length(text).cast("long").alias("chars"))
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "digest", "chars")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("all")).select(
        "conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(sequences: DataFrame, every: int = 100, modulus: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % every; h = crc32(decimal c) % modulus.

    All turns of that conversation if it has fewer, none if there is no such; c's own turns follow
    after its first h.
    """
    heads = sequences.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, max(modulus - 1, 0)).alias("_head"))
    h = F.expr(f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {modulus} AS INT)")
    joined = (sequences.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "_base", "left")
              .withColumn("_h", h))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h")))
    return joined.select("conv_id", F.when(head.isNull(), own).otherwise(F.concat(head, own)).alias("turns"))


def _neighbours(ranged: DataFrame) -> DataFrame:
    """For each part of the order the last row before it and the first one after it: two rows a part."""
    edges = materialise(ranged.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), "prefix-edges")
    order = Window.orderBy("part")  # one row a part
    seen = edges.select("part", F.lag("high").over(order).alias("b"), F.lead("low").over(order).alias("a"))
    none = [F.lit(None).cast("long").alias("conv_id"), F.array().cast("array<bigint>").alias("chars")]
    return (seen.where("b is not null").select("part", F.lit(BEFORE).alias("place"), F.col("b").alias("seq"), *none)
            .unionByName(seen.where("a is not null").select("part", F.lit(AFTER).alias("place"), F.col("a").alias("seq"), *none)))


def prefix_tree(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included.

    conv_id is the smallest member, parent_conv_id that of the prefix one turn shorter (null for the
    root); depth counts turns; n_convs members; n_children prefixes one turn longer; n_leaves
    those below (itself included) that nothing continues; saved_tokens sums over these (members - 1)
    times the code points of the last turn; ends_sha256 hashes the comma-joined ascending ids
    of the members that end here, or the empty string.

    Prefixes are equal if the digests of all turns are.  No conversation gives no row, one without
    turns belongs to the root only.  Copies share one sequence per stretch.
    """
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = materialise(sequences.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["chars"]).alias("chars")),
                       "prefix-sequences")
    wide = partitions(sequences)
    # Ids are part of the order, so copies of one sequence spread over parts.
    ranged = materialise(rows.repartitionByRange(wide, "seq", "conv_id").select(F.spark_partition_id().alias("part"), "*"), "prefix-ranges")
    marked = ranged.select("part", F.lit(OWN).alias("place"), "seq", "conv_id", "chars").unionByName(_neighbours(ranged))
    found = (marked.select("part", "place", "seq", "conv_id", "chars").repartition(wide, "part")
             .sortWithinPartitions("part", "place", "seq", "conv_id"))
    found = materialise(found.mapInArrow(_stretches, "key binary, parent binary, depth long, first long, n_convs long, "
                                                     "n_children long, n_leaves long, saved long, ends string"), "prefix-rows")
    nodes = materialise(found.where("ends is null").groupBy("key", "parent", "depth").agg(
        F.min("first").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")],
        F.sum("saved").alias("saved_tokens")), "prefix-nodes")
    ends = (found.where("ends is not null").select("key", "first", "ends").repartition(wide, "key")
            .sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
