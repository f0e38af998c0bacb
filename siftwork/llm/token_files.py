"""Token-id files: one zstandard frame per document, one dictionary for all, an offset index.

A shard file is: magic, the dictionary's SHA-256 (zero bytes without one), the
frames, the index (per document: id, null flag, frame offset, token count), and
a footer with the place of the index.  A document can be read by its index entry
alone; the dictionary lies beside the shards under the name of its hash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from .common import AttemptFile, column, file_system, partitions
from .segments import segmented

MAGIC = b"TOKSHARD"
HEAD, FOOT = "<8s32s", "<QQ8s"
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("tokens", "<u8")])
MANIFEST = "shard int, uri string, documents long, tokens long, bytes long, dictionary string"

#: Bounds of what the dictionary is trained on and of its size.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 1 << 13, 1 << 16
#: Text of a shard, about: the number of shards follows the size of the input.
SHARD_BYTES = 256 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[bytes, int]:
    """(dictionary, bytes of all texts): a dictionary from id arrays of slices of the 512 documents whose hash of id and length is smallest.

    All rows take part in the choice, so no source or size of document is left out;
    a slice has at most 8,192 characters and begins where the hash says.  The dictionary only makes
    frames smaller: what is chosen does not change what is read back.  It is empty for an empty table only.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(text.alias("t"), F.octet_length(text).alias("n"), F.xxhash64(column(id_col), F.octet_length(text)).alias("h"))
    sizes = Observation()
    # Hashes alone decide first, so that tasks send 8 bytes a candidate and slices of the chosen only.
    least = [r.h for r in rows.select("h", "n").observe(sizes, F.sum("n").alias("total")).orderBy("h").limit(SAMPLE_DOCUMENTS).collect()]
    total = sizes.get["total"] or 0
    room = F.greatest(F.char_length("t") - SAMPLE_CHARS, F.lit(0)) + 1
    slices = rows.where(F.col("h") <= max(least, default=0)).select(
        "h", F.substring("t", (F.pmod(F.shiftright("h", 20), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    chosen = slices.orderBy("h", "t").limit(SAMPLE_DOCUMENTS).collect()
    end = np.array([end_id], "<u4").tobytes()
    samples = [ids + end for ids in segmented(tokenizer, False).encode([r.t for r in chosen])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), total
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return b"".join(samples)[:DICTIONARY_BYTES], total


def _dict_data(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", level: int = 3) -> DataFrame:
    """Write the documents' ids in ascending id order; returns the manifest (one row per shard).

    Texts are range-partitioned by id and sorted (null ids first, null texts
    empty, repeated ids next to each other), then encoded and written by the same
    task, so ids never go through a shuffle.  A shard is streamed: one document
    is held at a time.  Other input columns are not read.  The manifest is written as parquet to the folder and read
    back, so the files that count are fixed once.
    """
    spark = docs.sparkSession
    dictionary, total = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    if dictionary:
        store, path = file_system(f"{folder}/dictionary-{digest.hex()}")
        store.create_dir(file_system(folder)[1], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = segmented(tokenizer, False), None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dict_data(dictionary))
        end, entries, tokens = np.array([end_id], "<u4").tobytes(), [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if file is None:
                    file = AttemptFile(folder, f"shard-{TaskContext.get().partitionId():06d}", ".tok")
                    file.write(struct.pack(HEAD, MAGIC, digest))
                entries.append((key or 0, key is None, file.position, len(ids) // 4 + 1))
                tokens += len(ids) // 4 + 1
                file.write(compressor.compress(ids + end))
        if file is None:
            return
        at = file.position
        file.write(np.array(entries, ENTRY).tobytes())
        file.write(struct.pack(FOOT, at, len(entries), MAGIC))
        size, uri = file.position, file.close()
        yield pa.RecordBatch.from_pylist([{
            "shard": TaskContext.get().partitionId(), "uri": uri, "documents": len(entries), "tokens": tokens,
            "bytes": size, "dictionary": digest.hex() if dictionary else None}],
            schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()),
                              ("tokens", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.string())]))

    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    shards = max(partitions(docs), -(-total // SHARD_BYTES))
    manifest = rows.repartitionByRange(shards, "id").sortWithinPartitions("id").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@lru_cache(maxsize=4)
def _dictionary(uri: str, digest: str) -> bytes:
    store, path = file_system(uri)
    with store.open_input_stream(path) as stream:
        data = stream.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{uri} does not hold the dictionary of its name")
    return data


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str, dictionary_uri: str | None):
        store, path = file_system(uri)
        self.file = store.open_input_file(path)
        magic, digest = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        at, count, closing = struct.unpack(FOOT, self.file.read_at(struct.calcsize(FOOT), self.file.size() - struct.calcsize(FOOT)))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.index = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, at), ENTRY)
        self.ends = np.append(self.index["offset"][1:], at)
        data = _dictionary(dictionary_uri, digest.hex()) if any(digest) else b""
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dict_data(data))

    def ids(self, position: int) -> bytes:
        """The ids of one document (little-endian unsigned 32-bit)."""
        start, tokens = int(self.index["offset"][position]), int(self.index["tokens"][position])
        frame = self.file.read_at(int(self.ends[position]) - start, start)
        return self.decompressor.decompress(frame, max_output_size=4 * tokens)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) per document; start counts all ids before it.

    Shards are in ascending id order, so a running sum over the manifest (one
    narrow row per shard) gives each shard's start; the files are read by tasks.
    """
    manifest = read_manifest(spark, folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("uri", F.concat(F.lit(f"{folder}/dictionary-"), "dictionary").alias("dictionary"),
                             F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, rows, size = Shard(row["uri"], row["dictionary"]), [], 0
                start = row["base"]
                for position, entry in enumerate(shard.index):
                    ids = shard.ids(position)
                    rows.append((None if entry["null"] else int(entry["id"]), start, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return (shards.repartition(partitions(manifest), "uri")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))
