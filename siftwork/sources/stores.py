"""Files by local path, or by URI in the stores that `pyarrow.fs` knows (object stores, HDFS).

A path below a URI is a URI too, its names percent-encoded.  Settings of a store come
from its environment: a URI with a query is refused, as its files would not end in their suffix.
"""

from __future__ import annotations

import os
import stat
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import PurePosixPath
from typing import NamedTuple
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Facts(NamedTuple):
    kind: str  # file, directory or other
    size: int
    changed_ns: int | None  # inode change time; of a store the time of the last write, which directories lack


def is_uri(path: str) -> bool:
    return "://" in path


def normal(path) -> str:
    """A path without doubled separators; `file:` URIs become local paths, other URIs stay."""
    path = str(path)
    parts = urlsplit(path) if is_uri(path) else None
    if parts and parts.query:
        raise ValueError(f"a URI of sources has no query: {path}")
    if parts and parts.scheme != "file":
        return path
    return str(PurePosixPath(unquote(parts.path) if parts else path))


def located(path: str) -> tuple[fs.FileSystem, str]:
    if not is_uri(path):
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowException as failure:
        raise OSError(str(failure)) from None


def below(directory: str, name: str) -> str:
    if not is_uri(directory):
        return os.path.join(directory, name)
    return f"{directory}{'' if directory.endswith('/') else '/'}{quote(name)}"


def relative_to(path: str, root: str) -> str:
    if not is_uri(root):
        return os.path.relpath(path, root)
    return unquote(path[len(root):].lstrip("/")) or "."


def _local_change(entry: os.DirEntry) -> int:
    return entry.stat().st_ctime_ns


def entries(directory: str) -> Iterator[tuple[str, str, bool, Callable[[], int | None]]]:
    """(name, path, is it a directory, what tells its change time) of all that a directory holds.

    A local directory is read as it is consumed.  Of a store a directory's names are held at once.
    """
    if is_uri(directory):
        store, inside = located(directory)
        for info in store.get_file_info(fs.FileSelector(inside)):
            yield (info.base_name, below(directory, info.base_name), info.type == fs.FileType.Directory,
                   partial(getattr, info, "mtime_ns"))
        return
    with os.scandir(directory) as found:
        for entry in found:
            yield entry.name, entry.path, entry.is_dir(follow_symlinks=False), partial(_local_change, entry)


def facts(path: str) -> Facts:
    """What a path is; an OSError where there is nothing."""
    if is_uri(path):
        store, inside = located(path)
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"No such file or directory: '{path}'")
        kind = {fs.FileType.File: "file", fs.FileType.Directory: "directory"}.get(info.type, "other")
        return Facts(kind, info.size or 0, info.mtime_ns)
    info = os.stat(path)
    kind = "file" if stat.S_ISREG(info.st_mode) else "directory" if stat.S_ISDIR(info.st_mode) else "other"
    return Facts(kind, info.st_size, info.st_ctime_ns)


def reading(path: str):
    """A file opened for reading, its bytes as they are whatever its suffix."""
    if not is_uri(path):
        return open(path, "rb")
    store, inside = located(path)
    return store.open_input_stream(inside, compression=None)


def write_whole(path: str, data: bytes) -> None:
    """A file that appears complete or not at all."""
    store, target = located(path)
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    attempt = f"{target}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    store.move(attempt, target)


def drop_folders(folder: str, keep: Callable[[str], bool]) -> None:
    """Delete the folders directly below `folder` whose name is not to be kept."""
    store, inside = located(folder)
    for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        if info.type == fs.FileType.Directory and not keep(info.base_name):
            store.delete_dir(info.path)
