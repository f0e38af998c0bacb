"""Near duplicates by SimHash fingerprints, joined by the generalised pigeonhole principle.

The 64 bits are split into parts of correlated bits.  Part i gets a threshold
t_i of its own (-1: not used) with sum(t_i) = tau - parts + 1; then any two
fingerprints within tau bits agree in some part up to its t_i bits.  The split and
the thresholds are the cheapest by estimated candidate counts (dynamic
programming over the parts).  Each fingerprint goes to the buckets of its part
values with up to t_i further bits set, where any two such fingerprints meet;
buckets are compared by vectorised XOR and population count.

Buckets are cut into cells of bounded size, and a cell gives only the links that join
what it has not joined yet, so a group of k near copies costs fewer than k rows
per cell instead of k * k pairs, and no component is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftwork.session import materialise

from .common import carried, column, keyed, partitions
from .components import connected_components
from .shingles import shingle_hashes, words_of

BITS = 64
#: Most fingerprints of one block of a bucket; a cell compares two blocks.
BLOCK = 4096
#: What a bucket row costs, in comparisons.
ROW_COST = 600
MOST_PARTS, MOST_RADIUS = 9, 3

# --- fingerprints -------------------------------------------------------------


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The fingerprint whose bits are set in over half the (weighted) hashes, as a signed 64-bit number."""
    total, ones = 0.0, np.zeros(BITS)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        part = None if weights is None else weights[at:at + (1 << 15)]
        ones += bits.sum(axis=0, dtype=np.int64) if part is None else part @ bits
        total += len(bits) if part is None else part.sum()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def shingle_fingerprint(text: str | None, size: int) -> int:
    return majority(shingle_hashes(words_of(text), size))


# --- parts and thresholds -----------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all rows.

    Tasks send one 64 x 64 matrix each as rows that are summed before the driver
    reads them: some 2,000 numbers whatever the input.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, rows = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(">i8")
            bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            together += (bits.T @ bits).astype(np.int64)
            rows += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, BITS), pa.int32()), pa.array(np.append(j, BITS), pa.int32()),
             pa.array(np.append(together[i, j], rows), pa.int64())], names=["i", "j", "n"])

    rows = nodes.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r.i == BITS:
            total = r.n
        else:
            together[r.i, r.j] = together[r.j, r.i] = r.n
    return total, together


def group_bits(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, the most correlated ones together."""
    share = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    linked = np.abs((together / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (linked[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (linked[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def estimated_pairs(together: np.ndarray, total: int, group: list[int]) -> list[float]:
    """Expected pairs that differ in up to t bits of the part, for t = 0 .. MOST_RADIUS.

    Bits are chained, each on the bit before it: the chance that two rows agree
    on a bit given that they agree on the last one.
    """
    n = max(total, 1)
    agree = lambda i: (together[i, i] / n) ** 2 + (1 - together[i, i] / n) ** 2

    def agree_both(i, j):
        both, a, b = together[i, j] / n, together[i, i] / n, together[j, j] / n
        return both ** 2 + max(a - both, 0) ** 2 + max(b - both, 0) ** 2 + max(1 - a - b + both, 0) ** 2

    chance = [agree(group[0])] + [min(1.0, agree_both(i, j) / agree(i)) for i, j in zip(group, group[1:])]
    spread = np.zeros(len(group) + 1)
    spread[0] = 1
    for p in chance:
        spread[1:] = spread[1:] * p + spread[:-1] * (1 - p)
        spread[0] *= p
    return (np.cumsum(spread)[:MOST_RADIUS + 1] * n * n / 2).tolist()


def allocate(together: np.ndarray, total: int, tau: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits of a part, threshold) list for distance `tau`; parts with threshold -1 are left out."""
    best_cost, best = math.inf, []
    for parts in range(2, MOST_PARTS + 1):
        groups = group_bits(together, total, parts)
        goal = tau - parts + 1
        # state: sum of thresholds so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            pairs = estimated_pairs(together, total, group)
            zeros = sum(1 - together[b, b] / max(total, 1) for b in group)
            following: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, chosen) in states.items():
                for t in range(-1, MOST_RADIUS + 1):
                    rows = sum(math.comb(round(zeros), k) for k in range(t + 1))
                    more = cost + (pairs[t] + ROW_COST * rows * total if t >= 0 else 0)
                    if done + t not in following or more < following[done + t][0]:
                        following[done + t] = (more, [*chosen, t])
            states = following
        if goal in states and states[goal][0] < best_cost:
            best_cost, best = states[goal][0], [(g, t) for g, t in zip(groups, states[goal][1]) if t >= 0]
    return best


# --- probe and verify ---------------------------------------------------------


def bucket_rows(prints: np.ndarray, plan: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, bucket numbers): each part value with up to its threshold of unset bits set."""
    for part, (group, radius) in enumerate(plan):
        value = np.zeros(len(prints), np.int64)
        for place, bit in enumerate(group):
            value |= ((prints >> np.int64(BITS - 1 - bit)) & 1) << np.int64(place)
        for k in range(radius + 1):
            for places in combinations(range(len(group)), k):
                mask = np.int64(sum(1 << p for p in places))
                rows = np.flatnonzero((value & mask) == 0)
                yield rows, (value[rows] | mask) * np.int64(16) + np.int64(part)


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, key, fp) rows of nodes (key, fp)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, buckets in bucket_rows(prints, plan):
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *taken.columns], names=["bucket", "key", "fp"])

    return nodes.select("key", "fp").mapInArrow(spread, "bucket long, key long, fp long")


class Forest:
    """Union by index with the links that joined something."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        parent, links = self.parent, []
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
        while True:
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent[:] = flat
        return links


def cell_links(cells: np.ndarray, keys: np.ndarray, prints: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links that span what each run of equal `cells` joins within tau bits."""
    nodes, place = np.unique(keys, return_inverse=True)
    forest, links = Forest(len(nodes)), []
    index, step = np.arange(len(cells)), 1
    while True:
        index = index[index + step < len(cells)]
        index = index[cells[index + step] == cells[index]]
        if not len(index):
            break
        near = index[np.bitwise_count(prints[index] ^ prints[index + step]) <= tau]
        near = near[forest.parent[place[near]] != forest.parent[place[near + step]]]
        if len(near):
            links += [(nodes[a], nodes[b]) for a, b in forest.join(place[near], place[near + step])]
        step += 1
    return links


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """Edges (a, b) between node keys that keep all components of the nodes' near pairs.

    Buckets over BLOCK rows are found by count; their rows are dealt to blocks by
    hash, and each two blocks meet in one cell, so the work of a hot bucket
    spreads over many tasks that hold at most two blocks each.
    """
    rows = materialise(probes(nodes, plan), "simhash-buckets")
    large = (rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
             .select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = (rows.join(large, "bucket", "left")
             .withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("cell", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def work(table: pa.Table) -> pa.RecordBatch:
            number = lambda c: table.column(c).to_numpy().astype(np.int64)
            found = cell_links(number("cell"), number("key"), number("fp"), tau)
            return pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cells = held.column("cell").to_numpy()
            last = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            if last:
                yield work(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield work(held)

    return (dealt.select("cell", "key", "fp").repartition(partitions(nodes), "cell").sortWithinPartitions("cell")
            .mapInArrow(compare, "a long, b long"))


def _node_components(nodes: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """Nodes (key, ...) with `component`: the least `order` of all nodes that edges connect."""
    roots = connected_components(edges)
    linked = nodes.select("key", order).join(roots.withColumnRenamed("node", "key"), "key")
    least = linked.groupBy("root").agg(F.min(order).alias("component"))
    found = linked.join(least, "root").select("key", "component")
    return nodes.join(found, "key", "left").withColumn("component", F.coalesce("component", order))


def _fingerprints(shingle: int):
    @F.arrow_udf("long")
    def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([shingle_fingerprint(t.as_py(), shingle) for t in batch], pa.int64())
    return fingerprint


def _components(nodes: DataFrame, order: str, tau: int) -> DataFrame:
    """Nodes (fp, order) with `component`: the least `order` of all fingerprints that links of tau bits connect."""
    nodes = nodes.withColumn("key", F.col("fp"))
    total, together = bit_statistics(nodes)
    return _node_components(nodes, links(nodes, allocate(together, total, tau), tau), order)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, tau: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id) per row: fingerprints of `shingle`-word runs linked at tau bits.

    A null text or one without words has fingerprint zero.  component_id is the
    smallest id that links reach, null only if all ids reached are null; repeated
    rows share it.  Equal fingerprints are one node, so copies cost nothing after
    the first aggregation.  Texts are hashed whole, however long; an empty table
    gives an empty table; input columns other than the id and the text are not read.
    """
    fingerprint = _fingerprints(shingle)
    rows = materialise(docs.select(column(id_col).alias("_id"), fingerprint(column(text_col)).alias("fp")), "simhash-prints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-nodes")
    found = _components(nodes, "least", tau).select("fp", "component")
    return rows.join(found, "fp").select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"),
                                         F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, tau: int = 3) -> DataFrame:
    """The documents without their near duplicates: of each component of `near_duplicates` the row with the smallest id stays.

    Null ids come last in the order and ties go by text hash; of repeated rows
    one stays; texts without words are alike.  Columns are unchanged, whatever
    their names; an empty table gives an empty table.

    Narrow rows (id, text hash, fingerprint) are written and decide; texts move once at most,
    to leave out the rows that go.
    """
    names = ["_k", "_null", "_h1", "_h2"]
    own = keyed(docs, id_col, text_col).select(
        "_text", "_row", F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("_k"), F.col("_id").isNull().alias("_null"),
        F.xxhash64("_text").alias("_h1"), F.xxhash64(F.lit("text"), "_text").alias("_h2"))
    rows = materialise(own.select(*names, _fingerprints(shingle)("_text").alias("fp")), "simhash-rows")
    least = F.struct("_null", "_k", "_h1", "_h2")
    nodes = materialise(rows.groupBy("fp").agg(F.min(least).alias("least")), "simhash-nodes")
    found = _components(nodes, "least", tau).select("fp", "component")
    gone = materialise(rows.join(found, "fp").where(least != F.col("component")).select(*names).distinct(), "simhash-gone")
    repeated = materialise(rows.groupBy(*names).count().where("count > 1").select(*names), "simhash-repeated")
    # Merge joins at every size: one shuffle of the texts serves all three, and nothing that grows is broadcast.
    stay = own.join(gone.hint("merge"), names, "left_anti")
    repeated = repeated.hint("merge")
    # Repeated rows alone meet to become one.
    return (stay.join(repeated, names, "left_anti")
            .unionByName(stay.join(repeated, names, "left_semi").dropDuplicates(names)).select(*carried(docs, text_col, [])))


def fingerprint_hex(fingerprint: str) -> F.col:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
