"""Helpers shared by the operators: row carrying, shared files, text rules."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, the only characters that separate words here.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (_id, _text, _row): no column of the input can clash with one of an operator."""
    rest = [column(c) for c in docs.columns if c != text_col]
    return docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"), F.struct(*rest).alias("_row"))


def carried(docs: DataFrame, text_col: str, outputs: list[str]) -> list[Column]:
    """The input's columns again, from `_row` and `_text`; one named like an output gives way to it."""
    taken = {o.lower() for o in outputs}
    return [(F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c)
            for c in docs.columns if c.lower() not in taken]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(df: DataFrame) -> int:
    """Partitions of an explicit shuffle: the session's number, or the initial one that `size_shuffles` set for the input."""
    conf = df.sparkSession.conf
    wide = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(conf.get("spark.sql.shuffle.partitions")), int(wide or 0))


def width_for(rows: DataFrame, text_col: str, bytes_each: int) -> int:
    """As many partitions as keep each to `bytes_each` of text, `partitions` at least; one pass over lengths, no shuffle of texts."""
    total = rows.agg(F.sum(F.octet_length(column(text_col)))).first()[0] or 0
    return max(partitions(rows), -(-total // bytes_each))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, on whichever machine this runs."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


class AttemptFile:
    """A file that appears under its final name only when complete.

    The name holds a random part, so a repeated or speculative attempt never
    overwrites the file of another; the rows a job returns name the files that
    count, and files of lost attempts are simply not named by any row.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = file_system(self.uri)
        self.fs.create_dir(file_system(folder)[1], recursive=True)
        self.stream = self.fs.open_output_stream(self.path)
        self.position = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.position += len(data)

    def close(self) -> str:
        self.stream.close()
        return self.uri
