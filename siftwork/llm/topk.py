"""Exact top-k by inner product: ball trees over shards, searched best bound first.

Vectors are dealt to shards, a group of shards to a task.  The task builds a ball tree over
each of its shards once and streams all queries past them.  No vector of a ball can score more
than q . centre + |q| * radius; a query takes the nodes of a tree in falling order of this
bound and stops when the bound is below its k-th score so far.  That score is shared: it
goes on from shard to shard of a task, and every task starts from the one that a
first pass over a single group of shards gave.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftwork.session import materialise

from .codebooks import integers, usable
from .common import column, partitions

SCALE = 1024
SHARD_ROWS, SHARDS_PER_GROUP, LEAF_ROWS = 4096, 4, 64
#: Beyond this, squares of doubles could overflow: shards and queries with such components are scored one by one.
ROOM = 1e140
INT64 = np.iinfo(np.int64)
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query long, query_id long, vec_id long, copies long, score long"


def as_floats(rows: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles, cut off far beyond ROOM."""
    if rows.dtype != object:
        return rows.astype(np.float64)
    return np.array([float(min(max(x, -10 ** 300), 10 ** 300)) for x in rows.ravel().tolist()]).reshape(rows.shape)


class BallTree:
    """Nodes as arrays; children of node i are 2i + 1 and 2i + 2, leaves are runs of the row order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        """`keys` has a row (number, id, copies) for each of `rows`, whole numbers as doubles or as Python numbers."""
        points = as_floats(rows)
        largest = float(np.abs(points).max()) if rows.size else 0.0
        self.exact = largest * largest * rows.shape[1] < 2.0 ** 52
        self.bounded = largest < ROOM
        order = np.arange(len(keys))
        if not self.bounded:
            self.keys, self.rows, self.floats = keys, rows, points
            return
        self.spans: dict[int, tuple[int, int]] = {}
        self.leaves: set[int] = set()
        numbers, centres, radii = [], [], []
        stack = [(0, 0, len(keys))]
        while stack:
            node, a, b = stack.pop()
            own = points[order[a:b]]
            centre = own.mean(axis=0)
            numbers.append(node)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            self.spans[node] = (a, b)
            if b - a <= LEAF_ROWS or radii[-1] == 0:
                self.leaves.add(node)
                continue
            # Two far points give the direction; half the rows go to each side.
            far = own[((own - own[0]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - far), half)]
            stack += [(2 * node + 1, a, a + half), (2 * node + 2, a + half, b)]
        self.keys, self.rows = keys[order], rows[order]
        self.floats = points[order]
        self.column = {n: i for i, n in enumerate(numbers)}
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all queries and nodes, rounding errors allowed for."""
        size = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii
        bounds = queries @ self.centres.T + size * self.radii + 1e-9 * size * reach + 1.0
        return np.maximum(bounds, float(INT64.min))  # where scores stop

    def scores(self, a: int, b: int, query: np.ndarray, floats: np.ndarray, small: bool) -> np.ndarray:
        """Exact inner products; beyond the range of long they stop at its ends."""
        if self.exact and small:
            return (self.floats[a:b] @ floats).astype(np.int64)
        other = [int(x) for x in query.tolist()]
        wide = (sum(int(x) * y for x, y in zip(row, other)) for row in self.rows[a:b].tolist())
        return np.array([min(max(x, INT64.min), INT64.max) for x in wide], np.int64)


class Best:
    """The k best (score, smaller id first) of one query, and the score that a candidate must reach.

    `copies` rows stand behind each candidate; k candidates are at least k rows.
    """

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor = k, float("-inf") if floor is None else floor
        self.scores, self.ids, self.copies = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, scores: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        take = (scores >= self.floor) & (copies > 0)
        scores, ids, copies = (np.concatenate(x) for x in ((self.scores, scores[take]), (self.ids, ids[take]), (self.copies, copies[take])))
        # ~x falls as x grows and cannot overflow.
        order = np.lexsort((ids, ~scores))
        full = np.searchsorted(np.cumsum(copies[order]), self.k)
        order = order[:full + 1]
        self.scores, self.ids, self.copies = scores[order], ids[order], copies[order]
        if full < len(order):
            self.floor = max(self.floor, int(self.scores[-1]))


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, best: list[Best]) -> None:
    """Bring the best lists of some queries (row numbers `own`) up to date with one tree."""
    if not len(tree.keys):
        return
    floats = as_floats(queries)
    reach = np.abs(floats).max(axis=1, initial=0)
    limit = float(np.abs(tree.floats).max()) if tree.floats.size else 0.0
    bounds = tree.bounds(np.where(reach[:, None] < ROOM, floats, 0)) if tree.bounded else None

    def leaf(i: int, a: int, b: int) -> None:
        small = limit * float(reach[i]) * floats.shape[1] < 2.0 ** 52
        number, ids, copies = tree.keys[a:b].T
        # A row is no candidate of its own; its copies are.
        best[i].offer(tree.scores(a, b, queries[i], floats[i], small), ids, copies - (number == own[i]))

    for i, result in enumerate(best):
        if bounds is None or reach[i] >= ROOM:
            leaf(i, 0, len(tree.keys))
            continue
        row = bounds[i]
        frontier = [(-row[tree.column[0]], 0)]
        while frontier:
            bound, node = heapq.heappop(frontier)
            if -bound < result.floor:
                break
            if node in tree.leaves:
                leaf(i, *tree.spans[node])
            else:
                for child in (2 * node + 1, 2 * node + 2):
                    if row[tree.column[child]] >= result.floor:
                        heapq.heappush(frontier, (-row[tree.column[child]], child))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return integers(flat.reshape(len(vectors), dim), SCALE)


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, group, shard, number, vec_id, copies, floor, vector), the shards of a group before its queries (shard null)."""
    group, trees, held = None, [], []

    def planted() -> None:
        """The tree of the shard whose rows are held."""
        if held:
            rows = [m for _, m in held]
            wide = any(m.dtype == object for m in rows)
            trees.append(BallTree(np.concatenate([x for x, _ in held]), np.concatenate([m.astype(object) if wide else m for m in rows])))
            held.clear()

    shard = None
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(3)]
        marks = list(zip(*names))
        cuts = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]] + [len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            dim, number, part = marks[a]
            some = batch.slice(a, b - a)
            if (dim, number) != group:
                held.clear()
                group, trees, shard = (dim, number), [], None
            keys = np.stack([some.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5)], axis=1)
            matrix = _matrix(some.column(7), dim)
            if part is not None:
                if part != shard:
                    planted()
                shard = part
                held.append((keys, matrix))
                continue
            planted()
            best = [Best(k, f) for f in some.column(6).to_pylist()]
            for tree in trees:
                search(tree, matrix, keys[:, 0], best)
            sizes = [len(x.ids) for x in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (
                    np.repeat(keys[:, 0], sizes), np.repeat(keys[:, 1], sizes), np.concatenate([x.ids for x in best]),
                    np.concatenate([x.copies for x in best]), np.concatenate([x.scores for x in best]))], schema=FOUND)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The candidates that the k best rows of each query come from, with the number of rows ahead of each."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "copies")
    ahead = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k best rows by integer inner product of floor(1024 * x).

    Queries are the rows for which `is_query` (over `vec_id`) holds, candidates
    all rows but the query's own row.  Rows with a null id, or whose vector is null or
    holds null or non-finite components, take no part.  Repeated rows are rows: each is a
    query and a candidate, also of its copies; rows that repeat an id with another vector are
    too.  Only vectors of equal length meet; ties go to the smaller id.  Components of any
    size count exactly; scores stop at the ends of long.  Other input columns are not read;
    an empty table gives an empty table.

    Rows are dealt to groups of some 16,384 whatever the total.  A task holds one group and streams the
    queries, so a row moves once and a query once per group; each gives at most k candidates per
    query and group.  Copies are one row with a count.
    """
    rows = (vectors.where(column(id_col).isNotNull() & usable(column(vector_col)))
            .select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("vector"))
            .groupBy("vec_id", "vector").agg(F.count("*").alias("copies")))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("number"), "*", F.size("vector").alias("dim")), "topk-vectors")
    # Written as well, so that the two sides of a cell are different tables.
    queries = materialise(rows.where(is_query), "topk-queries")
    groups = max(1, -(-rows.count() // (SHARD_ROWS * SHARDS_PER_GROUP)))
    spread = F.xxhash64("vec_id", "vector")
    names = ["dim", "group", "shard", "number", "vec_id", "copies", "floor", "vector"]
    none = F.lit(None).cast("long")
    dealt = rows.withColumn("group", F.pmod(spread, F.lit(groups)).cast("int")).withColumn(
        "shard", F.pmod(F.shiftright(spread, 32), F.lit(SHARDS_PER_GROUP)).cast("int")).withColumn("floor", none)

    def cells(first: int, last: int, asked: DataFrame) -> DataFrame:
        if last < first:
            return spark.createDataFrame([], FOUND_DDL)
        copies = asked.withColumn("shard", F.lit(None).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(first), F.lit(last))))
        some = dealt.where(F.col("group").between(first, last)).select(*names).unionByName(copies.select(*names))
        return (some.repartition(partitions(vectors), "dim", "group")
                .sortWithinPartitions("dim", "group", F.col("shard").asc_nulls_last())
                .mapInArrow(lambda batches: _answers(batches, k), FOUND_DDL))

    spark = vectors.sparkSession
    # One group first: its k-th score is a floor for all others.
    seeds = materialise(_best_of(cells(0, 0, queries.withColumn("floor", none)), k), "topk-seeds")
    floors = (seeds.where(F.col("ahead") + F.col("copies") >= k).groupBy("query").agg(F.min("score").alias("floor"))
              .withColumnRenamed("query", "number"))
    rest = cells(1, groups - 1, queries.join(floors, "number", "left"))
    best = _best_of(seeds.drop("ahead").unionByName(rest), k)
    # A candidate stands for as many ranks as it has copies, a query row for as many lists.
    ranks = best.select("query", "query_id", "vec_id", "score", F.explode(F.sequence(
        F.col("ahead") + 1, F.least(F.col("ahead") + F.col("copies"), F.lit(k)))).alias("rank"))
    lists = queries.where("copies > 1").select(F.col("number").alias("query"), F.explode(F.sequence(F.lit(2).cast("long"), "copies")).alias("_list"))
    again = ranks.join(lists, "query").drop("_list")
    return ranks.unionByName(again).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
