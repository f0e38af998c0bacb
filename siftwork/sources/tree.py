"""Source trees on a file system or store all executors can open.

`source_tree` is a Spark data source that lists files; it exists because Spark's
file index silently hides names starting with `_` or `.`.  The driver only cuts
the tree into directory units; executors list names; files are then spread
evenly over tasks that check and read them, so one directory holding most files
costs one task no more than reading its names.  As a stream, files are taken by
change time.  Roots and paths are local paths or URIs (`stores`).
"""

from __future__ import annotations

import codecs
import hashlib
import io
import json
import os
import sys
import time
from collections import deque
from itertools import islice
from pathlib import PurePosixPath
from zlib import crc32

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import fixed
from ..functions.paths import is_scannable
from ..session import materialise
from . import stores

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: `since_ns` and `until_ns` bound the change time of files taken from a stream.
LISTING_SCHEMA = "file_path string, relative_path string, explicit boolean, since_ns bigint, until_ns bigint"
CONTENT_SCHEMA = "file_path string, relative_path string, content binary, error string"
#: `first_line` numbers the first line of a piece; `last` rows carry the hash of the whole text, or the error.
PIECE_SCHEMA = ("file_path string, relative_path string, piece bigint, first_line bigint, text string, last boolean, "
                "file_hash string, error string")
FLUSH_BYTES = 16 << 20
#: A line that outgrows this is cut, and the next piece begins with the end of the one before.
LINE_CHARS, LINE_OVERLAP = 1 << 28, 1 << 20


class _Unit(InputPartition):
    """A directory to list, either with everything below it or on its own; of a
    directory with very many entries one slice of them, by a hash of their names."""

    def __init__(self, root, directory, deep, since=None, until=None, part=0, parts=1):
        self.root, self.directory, self.deep = root, directory, deep
        self.since, self.until, self.part, self.parts = since, until, part, parts


def _subdirectories(directory, skip):
    return (path for name, path, is_directory, _ in stores.entries(directory) if is_directory and name not in skip)


def _units(root, skip, wanted, since=None, until=None):
    """Cut a tree into units, widest level first; at most three times `wanted`.

    The driver looks at no more than `wanted` + 1 subdirectories of a directory: one
    that has more is cut into slices, which the tasks tell apart themselves.
    """
    pending, done = deque([root]), []
    while pending and len(pending) + len(done) < wanted:
        directory = pending.popleft()
        try:
            below = list(islice(_subdirectories(directory, skip), wanted + 1))
        except OSError:  # the task that lists it reports the error
            below = []
        if len(below) > wanted:
            done += [_Unit(root, directory, True, since, until, i, wanted) for i in range(wanted)]
        else:
            done.append(_Unit(root, directory, False, since, until))
            pending.extend(below)
    return done + [_Unit(root, d, True, since, until) for d in pending]


def _suffix(name):
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def _changed(changed_ns, unit):
    """Is a file in the window of a stream?  The reader of the file tests it again."""
    try:
        at = None if unit.until is None else changed_ns()
        return at is None or unit.since < at <= unit.until
    except OSError:
        return True


def _file_path(path, relative, root):
    return path if stores.is_uri(path) else str(PurePosixPath(root) / relative)


def _walk(unit, suffixes, skip):
    """Names below one unit; scope rules are applied before any file is opened.

    A directory that cannot be listed comes as an explicit name of its own, which
    the reader turns into an error row.
    """
    todo = [unit.directory]
    while todo:
        yield from _list_one(todo.pop(), unit, suffixes, skip, todo, _Seen())


class _Seen:
    """What the listing of one directory leaves to look at again: a file after the window, or a failure."""

    unsettled = False


def _list_one(directory, unit, suffixes, skip, found, seen):
    """Names in one directory; its subdirectories go to `found`."""
    parts = unit.parts if directory == unit.directory else 1
    try:
        for name, path, is_directory, changed_ns in stores.entries(directory):
            if name in skip or parts > 1 and crc32(os.fsencode(name)) % parts != unit.part:
                continue
            if is_directory:
                if unit.deep:
                    found.append(path)
            elif not suffixes or _suffix(name) in suffixes:
                if _changed(changed_ns, unit):
                    relative = stores.relative_to(path, unit.root)
                    yield _file_path(path, relative, unit.root), relative, False, unit.since, unit.until
                elif unit.until is not None and (changed_ns() or 0) > unit.until:
                    seen.unsettled = True
    except OSError:
        seen.unsettled = True
        if unit.part == 0 or directory != unit.directory:
            yield directory, stores.relative_to(directory, unit.root), True, None, None


def _known_file(folder, unit, offset):
    name = json.dumps([unit.root, unit.directory, unit.deep, unit.part, unit.parts])
    return stores.below(stores.below(folder, str(offset)), hashlib.sha256(name.encode()).hexdigest() + ".json")


def _walk_changed(unit, suffixes, skip, folder):
    """As `_walk`, but a directory known from the last trigger is listed only if it changed since.

    What is known of a unit is written for the end of its window and read at the next trigger:
    its directories, each with the mark of having been left unsettled.  Where that is missing (first
    trigger, tree cut otherwise) the unit is walked.
    """
    try:
        with stores.reading(_known_file(folder, unit, unit.since)) as handle:
            known = json.loads(handle.read())
    except FileNotFoundError:
        known = []
    marks = dict(map(tuple, known))
    todo, after = [unit.directory, *(d for d in marks if d != unit.directory)], {}
    while todo:
        directory = todo.pop()
        if directory in after:
            continue
        seen, found = _Seen(), []
        if directory in marks:
            try:
                info = stores.facts(directory)
                gone, changed = info.kind != "directory", info.changed_ns
            except OSError as failure:  # the listing says what is wrong with others
                gone, changed = isinstance(failure, FileNotFoundError), None
            if gone and directory != unit.directory:
                continue
            if not gone and not marks[directory] and changed is not None and changed <= unit.since:
                after[directory] = False
                continue
        yield from _list_one(directory, unit, suffixes, skip, found, seen)
        after[directory] = seen.unsettled
        todo += [d for d in found if d not in marks]
    stores.write_whole(_known_file(folder, unit, unit.until), json.dumps(sorted(after.items())).encode())


class _TreeOptions:
    def __init__(self, options):
        self.roots = [stores.normal(r) if stores.is_uri(r) else r for r in json.loads(options.get("roots", "[]"))]
        self.suffixes = frozenset(json.loads(options.get("suffixes", "[]")))
        self.skip = frozenset(json.loads(options.get("skip_dirs", "[]")))
        self.wanted = int(options.get("units", "256"))
        self.known = options.get("known_directories", "")
        self.settle_ns = int(float(options.get("settle_seconds", "2")) * 1e9)


class _TreeReader(DataSourceReader):
    def __init__(self, opts):
        self.opts = opts

    def partitions(self):
        opts = self.opts
        return [u for root in opts.roots for u in _units(root, opts.skip, opts.wanted)]

    def read(self, partition):
        yield from _walk(partition, self.opts.suffixes, self.opts.skip)


class _TreeStream(DataSourceStreamReader):
    """Files by inode change time.

    An offset is a point in time, so the driver lists nothing and keeps nothing.
    Change time moves when a file is written, copied or renamed into place,
    whatever its modification time says.  The offset trails the clock by
    `settle_seconds` so that slow writers and clock differences of the file
    system fall into a later batch instead of between two.

    Every trigger looks at every file, unless `known_directories` names a folder: then it looks at
    every directory and lists those that changed, which holds where files are created or renamed into
    place, as checkouts do.  Stores keep no change time of directories, theirs are always listed.
    """

    def __init__(self, opts):
        self.opts = opts

    def initialOffset(self):
        return {"changed_ns": 0}

    def latestOffset(self):
        return {"changed_ns": time.time_ns() - self.opts.settle_ns}

    def partitions(self, start, end):
        opts = self.opts
        return [u for root in opts.roots
                for u in _units(root, opts.skip, opts.wanted, start["changed_ns"], end["changed_ns"])]

    def read(self, partition):
        opts = self.opts
        if opts.known:
            yield from _walk_changed(partition, opts.suffixes, opts.skip, opts.known)
        else:
            yield from _walk(partition, opts.suffixes, opts.skip)

    def commit(self, end):
        if self.opts.known:
            stores.drop_folders(self.opts.known, lambda name: not name.isdigit() or int(name) >= end["changed_ns"])


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTING_SCHEMA

    def reader(self, schema):
        return _TreeReader(_TreeOptions(self.options))

    def streamReader(self, schema):
        return _TreeStream(_TreeOptions(self.options))


def _options(roots, suffixes, skip_dirs, units, settle_seconds=2.0, known_directories=None):
    return {
        "roots": json.dumps([str(r) for r in roots]), "suffixes": json.dumps(sorted(suffixes)),
        "skip_dirs": json.dumps(sorted(skip_dirs)), "units": str(units), "settle_seconds": str(settle_seconds),
        "known_directories": stores.normal(known_directories) if known_directories else "",
    }


def _problem(info, path, explicit, since, until):
    """"" for a file of the listing, None for what is no part of it after all, else what is wrong."""
    if info.kind != "file":
        if explicit:
            next(stores.entries(path), None)  # says why a directory could not be listed
            return "not a regular file"
        return None
    if until is None:
        return ""
    if info.changed_ns is None:
        return "its store gives no change time"
    return "" if since < info.changed_ns <= until else None


def _read_one(path, explicit, since, until, max_bytes):
    """(content, error) of a file, or None where it is not part of the listing after all."""
    try:
        info = stores.facts(path)
        problem = _problem(info, path, explicit, since, until)
        if problem is None:
            return None
        if problem:
            return None, problem
        if info.size > max_bytes:
            return None, f"file has {info.size} bytes, more than one row can hold"
        with stores.reading(path) as handle:
            return handle.read(), None
    except OSError as failure:
        return None, str(failure)


def _read_contents(max_bytes):
    columns = ["file_path", "relative_path", "content", "error"]

    def run(batches):
        out, held = [], 0
        for batch in batches:
            windows = zip(batch["since_ns"].astype("Int64"), batch["until_ns"].astype("Int64"))
            for path, relative, explicit, (since, until) in zip(
                    batch["file_path"], batch["relative_path"], batch["explicit"], windows):
                bounded = until is not pd.NA
                found = _read_one(path, explicit, since if bounded else None, until if bounded else None, max_bytes)
                if found is None:
                    continue
                out.append((path, relative, *found))
                held += len(found[0] or b"")
                if held >= FLUSH_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)
    return run


def _text_pieces(handle, piece_bytes, line_chars=LINE_CHARS, overlap=LINE_OVERLAP):
    """(piece, first line, text, last, hash) of a file read `piece_bytes` at a time.

    Bytes are decoded with replacement and newlines normalised as they come, sequences and line
    ends that a read cuts in two included; the hash is carried along.  Pieces are whole lines, so
    a piece is longer than a read where a line is.
    """
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), translate=True)
    digest, held, line, piece = hashlib.sha256(), "", 1, 0
    ahead = handle.read(piece_bytes)
    while True:
        data, ahead = ahead, handle.read(piece_bytes) if ahead else b""
        text = decoder.decode(data, final=not ahead)
        digest.update(text.encode("utf-8"))
        held += text
        if not ahead:
            yield piece, line, held, True, digest.hexdigest()
            return
        cut = held.rfind("\n") + 1
        if cut:
            done, held = held[:cut], held[cut:]
            step = len(done.splitlines())
        elif len(held) >= line_chars:
            done, held = held, held[-overlap:]
            step = len(done.splitlines()) - len(held.splitlines())
        else:
            continue
        yield piece, line, done, False, None
        piece, line = piece + 1, line + step


def _read_pieces(piece_bytes):
    columns = ["file_path", "relative_path", "piece", "first_line", "text", "last", "file_hash", "error"]

    def pieces(path, explicit, since, until):
        try:
            problem = _problem(stores.facts(path), path, explicit, since, until)
            if problem:
                yield 0, 1, None, True, None, problem
            elif problem is not None:
                with stores.reading(path) as handle:
                    for found in _text_pieces(handle, piece_bytes):
                        yield *found, None
        except OSError as failure:
            yield 0, 1, None, True, None, str(failure)

    def run(batches):
        out, held = [], 0
        for batch in batches:
            windows = zip(batch["since_ns"].astype("Int64"), batch["until_ns"].astype("Int64"))
            for path, relative, explicit, (since, until) in zip(
                    batch["file_path"], batch["relative_path"], batch["explicit"], windows):
                bounded = until is not pd.NA
                for found in pieces(path, explicit, since if bounded else None, until if bounded else None):
                    out.append((path, relative, *found))
                    held += len(found[2] or "")
                    if held >= FLUSH_BYTES:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)
    return run


def load_pieces(listing: DataFrame, piece_bytes: int = 64 << 20) -> DataFrame:
    """Decoded texts of listed files in pieces of whole lines; files have no largest size.

    A file that cannot be read to its end has an error in its `last` row; pieces before it do not count.
    """
    return listing.mapInPandas(_read_pieces(piece_bytes), PIECE_SCHEMA)


def load_contents(listing: DataFrame, max_file_bytes: int = 1 << 30) -> DataFrame:
    """Read listed files; one that cannot be read becomes an error row."""
    return listing.mapInPandas(_read_contents(max_file_bytes), CONTENT_SCHEMA)


def spread_listing(listing: DataFrame, files_per_task: int = 2_000) -> DataFrame:
    """Spread a written listing evenly over tasks.

    Only paths are shuffled.  The number of tasks is fixed, because adaptive
    execution would otherwise merge these small rows into a handful of tasks.
    """
    count = listing.count()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    return listing.repartition(max(1, min(count, cores), -(-count // files_per_task)), "file_path")


def list_tree(spark: SparkSession, roots, suffixes=tuple(fixed.SUFFIX_LANGUAGES),
              skip_dirs=fixed.SKIP_DIRS, units: int = 256) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return (spark.read.format("source_tree")
            .options(**_options(roots, suffixes, skip_dirs, units)).load())


def list_files(spark: SparkSession, paths) -> DataFrame:
    """Explicit paths, as a list or as a table with `file_path`: no suffix or
    directory rule applies to them."""
    named = paths if isinstance(paths, DataFrame) else spark.createDataFrame(
        [(stores.normal(p),) for p in paths], "file_path string")
    no_bound = F.lit(None).cast("bigint")
    return named.select("file_path").distinct().select(
        "file_path", F.col("file_path").alias("relative_path"), F.lit(True).alias("explicit"),
        no_bound.alias("since_ns"), no_bound.alias("until_ns"))


def _once(listing: DataFrame) -> DataFrame:
    """Each path once; a path that is also named explicitly counts as explicit."""
    return listing.groupBy("file_path").agg(
        F.min("relative_path").alias("relative_path"), F.bool_or("explicit").alias("explicit"),
        F.min("since_ns").alias("since_ns"), F.max("until_ns").alias("until_ns"))


def _read(listing: DataFrame) -> DataFrame:
    return load_contents(spread_listing(materialise(listing, "listing")))


def read_source_tree(spark: SparkSession, roots, suffixes=tuple(fixed.SUFFIX_LANGUAGES),
                     skip_dirs=fixed.SKIP_DIRS) -> DataFrame:
    """Contents of all scannable files below the roots; a root or directory that cannot be listed is an error row."""
    return _read(_once(list_tree(spark, roots, suffixes, skip_dirs)))


def read_source_files(spark: SparkSession, paths) -> DataFrame:
    """Contents of explicitly named files; missing ones become error rows."""
    return _read(list_files(spark, paths))


def read_sources(spark: SparkSession, roots=(), paths=()) -> DataFrame:
    """Directories and explicit files together, each path once."""
    return _read(_once(list_tree(spark, roots).unionByName(list_files(spark, paths))))


def read_pieces(spark: SparkSession, roots=(), paths=(), piece_bytes: int = 64 << 20) -> DataFrame:
    """Directories and explicit files as text pieces (PIECE_SCHEMA), each path once, whatever the size of a file."""
    listing = _once(list_tree(spark, roots).unionByName(list_files(spark, paths)))
    return load_pieces(spread_listing(materialise(listing, "listing")), piece_bytes)


def read_listing(listing: DataFrame, piece_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of a micro-batch of listed files, each path once."""
    return load_pieces(spread_listing(materialise(_once(listing), "listing")), piece_bytes)


def stream_listing(spark: SparkSession, roots, suffixes=tuple(fixed.SUFFIX_LANGUAGES),
                   skip_dirs=fixed.SKIP_DIRS, units: int = 256, settle_seconds: float = 2.0,
                   known_directories: str | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return (spark.readStream.format("source_tree")
            .options(**_options(roots, suffixes, skip_dirs, units, settle_seconds, known_directories)).load())


def scannable_only(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.where(is_scannable(F.col(path)))
