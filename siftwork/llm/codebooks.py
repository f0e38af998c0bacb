"""Vector compression: a code per vector, one small integer codebook per part, fitted by Lloyd rounds.

Components become integers and vectors are cut into equal parts; a part's code is the
index of the nearest entry of its codebook.  A round assigns every part and then moves
each entry to the floored mean of its parts.

Rounds are cheap after the first one: a part whose assigned entry did not move keeps its
exact distance, so only the entries that moved can beat it and only those are compared;
all other parts rescan the whole codebook.  Ties go to the lower index either way.

All arithmetic is exact: doubles where every intermediate is below 2^52, whole numbers of
any size elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftwork.session import materialise

from .common import column

OUTPUTS = ["code", "error"]
#: Whole numbers below this are exact as doubles, with room for one more addition.
EXACT = 2.0 ** 52
#: A stored distance that is not known; its part rescans.
UNKNOWN = -1
LONG_MAX = 2 ** 63 - 1
LIMB = 32


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles that hold whole numbers, or as Python numbers where one is too large for that.

    The scale is a power of two, so the product is exact.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if values.size == 0 or float(np.abs(scaled).max()) < EXACT:
        return scaled
    whole = [int(x) * scale if abs(x) >= EXACT else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def _size(values: np.ndarray) -> np.ndarray:
    """The largest magnitude of each row, as doubles."""
    if values.shape[1] == 0:
        return np.zeros(len(values))
    return np.abs(values).max(axis=1).astype(np.float64)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; ties go to the lower index."""
    at, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    reach = float(_size(entries).max())
    small = rows.shape[1] * (_size(rows) + reach) ** 2 < EXACT
    if small.any():
        x, y = rows[small].astype(np.float64), entries.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)
        best = d.argmin(axis=1)
        at[small] = best
        if small.all():
            return at, d[np.arange(len(d)), best].astype(np.int64)
        distance[small] = d[np.arange(len(d)), best].astype(np.int64).tolist()
    whole = [[int(v) for v in entry] for entry in entries.tolist()]
    for i in np.flatnonzero(~small).tolist():
        row = [int(v) for v in rows[i].tolist()]
        distance[i], at[i] = min((sum((a - b) ** 2 for a, b in zip(row, entry)), j) for j, entry in enumerate(whole))
    return at, distance


class Codebooks:
    """Entries of each part, and which of them the last update moved."""

    def __init__(self, entries: list[list[list[int]]], moved: list[list[bool]] | None = None):
        self.entries, self.moved = entries, moved

    def arrays(self) -> list[np.ndarray]:
        def array(part: list[list[int]]) -> np.ndarray:
            fits = all(abs(v) < EXACT for entry in part for v in entry)
            width = len(part[0]) if part else 0
            return np.array(part, np.float64 if fits else object).reshape(len(part), width)
        return [array(part) for part in self.entries]

    def assign(self, parts: list[np.ndarray], code: np.ndarray | None, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and exact distances of all parts; `code` and `kept` are those of the round before, if there was one."""
        n = len(parts[0]) if parts else 0
        new = np.zeros((n, len(parts)), np.uint8)
        exact = np.zeros((n, len(parts)), object)
        for p, (rows, entries) in enumerate(zip(parts, self.arrays())):
            if code is None or self.moved is None:
                new[:, p], exact[:, p] = nearest(rows, entries)
                continue
            moved = np.array(self.moved[p], bool)
            stays = ~moved[code[:, p]] & (kept[:, p] != UNKNOWN)
            if not stays.all():
                new[~stays, p], exact[~stays, p] = nearest(rows[~stays], entries)
            at, distance = code[stays, p].astype(np.int64), kept[stays, p].astype(np.int64)
            if moved.any() and stays.any():
                rivals = np.flatnonzero(moved)
                j, d = nearest(rows[stays], entries[rivals])
                j = rivals[j]
                wins = ((d < distance) | ((d == distance) & (j < at))).astype(bool)
                at, distance = np.where(wins, j, at), np.where(wins, d, distance)
            new[stays, p], exact[stays, p] = at, distance
        return new, exact

    def updated(self, sums: dict[tuple[int, int, int], int], width: int) -> Codebooks:
        """Each entry at the floored mean of its parts; sums by (part, entry, position), the count at position `width`."""
        entries, moved = [], []
        for p, part in enumerate(self.entries):
            entries.append([[sums.get((p, e, i), 0) // sums[p, e, width] for i in range(width)]
                            if sums.get((p, e, width)) else entry for e, entry in enumerate(part)])
            moved.append([new != old for new, old in zip(entries[-1], part)])
        return Codebooks(entries, moved)

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position, as comma-joined decimals."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


class _Cutter:
    """Arrow vectors of one length to parts; a length that is no multiple of the parts is filled up with zeros."""

    def __init__(self, size: int, parts: int, scale: int):
        self.size, self.parts, self.scale = size, parts, scale
        self.width = -(-size // parts)

    def cut(self, vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which rows have the length, and the parts of these."""
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), self.size), False)
        flat = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = integers(flat.reshape(-1, self.size) if self.size else flat.reshape(fits.true_count, 0), self.scale)
        filled = np.zeros((len(whole), self.width * self.parts), whole.dtype)
        filled[:, :self.size] = whole
        return np.asarray(fits), [filled[:, p * self.width:(p + 1) * self.width] for p in range(self.parts)]


def _assigned(rows: DataFrame, books: Codebooks, cutter: _Cutter, again: bool, last: bool) -> DataFrame:
    """`rows` (_vector, ...) with `_code` and `_kept` (`error` after the last round) of this round in place of the one before."""
    parts = cutter.parts
    kept = [c for c in rows.columns if c not in ("_code", "_kept")]
    schema = StructType([rows.schema[c] for c in kept] + [StructField("_code", BinaryType()),
                        StructField("error", LongType()) if last else StructField("_kept", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, cut = cutter.cut(batch.column("_vector"))
            code = held = None
            if again:
                # Null where the length does not fit, so these are the rows of `fits`.
                code = np.frombuffer(b"".join(batch.column("_code").drop_null().to_pylist()), np.uint8).reshape(-1, parts)
                held = np.frombuffer(b"".join(batch.column("_kept").drop_null().to_pylist()), "<i4").reshape(-1, parts)
            code, exact = books.assign(cut, code, held)
            codes = iter([row.tobytes() for row in code])
            if last:
                totals = exact.sum(axis=1) if len(exact) else []
                values = iter([int(t) if t <= LONG_MAX else None for t in totals])
                kind = pa.int64()
            else:
                stored = np.where(exact < 2 ** 31, exact, UNKNOWN).astype("<i4")
                values, kind = iter([row.tobytes() for row in stored]), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array([next(codes) if f else None for f in fits], pa.binary()),
                 pa.array([next(values) if f else None for f in fits], kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, cutter: _Cutter) -> dict[tuple[int, int, int], int]:
    """Components summed by (part, entry, position) over all rows, and counts at position `width`.

    A task sends its sums once, as limbs of 32 bits that cannot overflow when added, and
    Spark adds them up: what the driver reads is as large as the codebooks.
    """
    parts, width = cutter.parts, cutter.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            _, cut = cutter.cut(batch.column("_vector"))
            code = np.frombuffer(b"".join(batch.column("_code").drop_null().to_pylist()), np.uint8).reshape(-1, parts)
            for p, rows_ in enumerate(cut):
                at = code[:, p]
                counts = np.bincount(at, minlength=1).tolist()
                big = rows_.dtype == object or rows_.size and float(np.abs(rows_).max()) * len(rows_) >= EXACT
                for i in range(width):
                    if big:
                        for e, v in zip(at.tolist(), rows_[:, i].tolist()):
                            sums[p, e, i] = sums.get((p, e, i), 0) + int(v)
                    else:
                        for e, v in enumerate(np.bincount(at, weights=rows_[:, i], minlength=1).tolist()):
                            if counts[e]:
                                sums[p, e, i] = sums.get((p, e, i), 0) + int(v)
                for e, c in enumerate(counts):
                    if c:
                        sums[p, e, width] = sums.get((p, e, width), 0) + c
        out = []
        for (p, e, i), total in sums.items():
            limb = 0
            while not -(1 << LIMB) <= total < 1 << LIMB:
                out.append((p, e, i, limb, total & (1 << LIMB) - 1))
                total, limb = total >> LIMB, limb + 1
            out.append((p, e, i, limb, total))
        columns = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["part", "entry", "position", "limb", "value"])

    totals: dict[tuple[int, int, int], int] = {}
    limbs = rows.where("_code is not null").select("_vector", "_code").mapInArrow(run, "part long, entry long, position long, limb long, value long")
    for r in limbs.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
        key = (r.part, r.entry, r.position)
        totals[key] = totals.get(key, 0) + (r.value << LIMB * r.limb)
    return totals


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16,
             entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """The rows with a usable vector, with `code` (binary, one byte a part) and `error` (long), and the codebooks.

    Components become floor(scale * x); `scale` is a power of two, `entries` at most 256.  Each part's
    codebook starts as that part of the vectors of the smallest ids (ties by vector, null ids
    last; fewer entries if there are fewer vectors).  `rounds` times all parts are assigned and
    used entries move to the floored mean; then parts are assigned once more.  error is the
    squared distance summed over the parts, null beyond the range of long.

    Vectors that are null or hold null or non-finite components leave.  Repeated rows and null ids
    are rows like any other.  Vectors are compared at the commonest length (the longest of
    those), filled up with zeros to a multiple of `parts`; rows of another length stay with null
    code and error.  An empty table gives an empty table and empty codebooks.  Input columns named
    code or error are replaced, all others are kept, whatever their names.

    Each round writes its codes and distances beside the vectors to the shared folder; the driver
    sees codebooks only.
    """
    if not 0 < entries <= 256 or scale & (scale - 1):
        raise ValueError("at most 256 entries, and a scale that is a power of two")
    taken = [c for c in vectors.columns if c.lower() not in OUTPUTS]
    own = [c for c in taken if c != vector_col]
    rows = vectors.where(usable(column(vector_col))).select(
        F.struct(*[column(c) for c in own] or [F.lit(True)]).alias("_row"),
        column(vector_col).alias("_vector"), column(id_col).alias("_id"))
    sizes = rows.groupBy(F.size("_vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    cutter = _Cutter(common.size if common else 0, parts, scale)
    least = rows.where(F.size("_vector") == cutter.size).orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector")
    first = [list(r._vector) for r in least.collect()]
    _, cut = cutter.cut(pa.array(first, pa.list_(pa.float64())))
    books = Codebooks([[[int(v) for v in row] for row in part.tolist()] for part in cut])
    state = rows.drop("_id")
    for k in range(rounds if common else 0):
        state = materialise(_assigned(state, books, cutter, again=k > 0, last=False), "codebooks-round")
        books = books.updated(_sums(state, cutter), cutter.width)
    coded = _assigned(state, books, cutter, again=rounds > 0, last=True) if common else state.select(
        "*", F.lit(None).cast("binary").alias("_code"), F.lit(None).cast("long").alias("error"))
    names = [(F.col("_vector") if c == vector_col else F.col("_row").getField(c)).alias(c) for c in taken]
    return coded.select(*names, F.col("_code").alias("code"), "error"), books


def with_group_error(coded: DataFrame, group_col: str, name: str) -> DataFrame:
    """`coded` with `error` summed over the rows of equal `group_col` as column `name`; nulls are one group.

    The sum is made before anything moves, so a hot group is a row per task; a sum beyond long is null.
    """
    totals = (coded.groupBy(column(group_col).alias("_group"))
              .agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38, 0))) AS BIGINT)").alias(name)))
    joined = coded.join(totals, column(group_col).eqNullSafe(F.col("_group")), "left")
    return joined.select(*[column(c) for c in coded.columns if c.lower() != name.lower()], column(name))
