"""WARC archives written from and read as tables of payload chunks.

A payload is never held whole by Python: it is a run of rows (record, chunk
number, bytes).  The writer streams the chunks of a record into one compressed
member; the reader inflates an archive piece by piece and gives chunk rows again,
carrying an incremental SHA-1 whose value stands on a record's last chunk.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftwork.session import materialise

from .common import AttemptFile, column, file_system, partitions

CHUNK_BYTES = 1 << 20
VERSION, BREAK = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive int, uri string, records long, bytes long"
CHUNKS = pa.schema([("record", pa.string()), ("type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()),
                    ("stated_digest", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
CHUNKS_DDL = ("record string, type string, target string, refers_to string, stated_digest string, chunk long, "
              "data binary, last boolean, payload_bytes long, payload_digest string")


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """One row per page: _id, _url, _payload, _digest (hex), _owner (id of the response it revisits, or null).

    Of pages with equal payloads of at least `min_bytes` the one with the
    largest id is the response.  Owners are found on (digest, length, id) alone,
    with a partial maximum before the shuffle; a payload held by very many pages
    is a hot key only of the narrow join, which adaptive execution splits.
    """
    rows = pages.select(column(id_col).cast("long").alias("_id"), column(url_col).cast("string").alias("_url"),
                        F.encode(F.coalesce(column(payload_col), F.lit("")), "utf-8").alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload")).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    owners = (rows.where((F.col("_bytes") >= min_bytes) & F.col("_id").isNotNull())
              .groupBy("_digest", "_bytes").agg(F.max("_id").alias("_owner")))
    roles = (rows.where(F.col("_id").isNotNull()).select("_id", "_digest", "_bytes")
             .join(owners, ["_digest", "_bytes"])
             .where("_id <> _owner").select("_id", "_digest", "_owner").distinct())
    # The payloads move once, to the tasks that will write them.
    return (rows.repartition(partitions(rows), "_id", "_digest").join(roles, ["_id", "_digest"], "left")
            .withColumn("_payload", F.when(F.col("_owner").isNull(), F.col("_payload"))))


def chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunk rows in the order (page, digest, copy, chunk) within the partition that will write them."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.coalesce(F.octet_length("_payload"), F.lit(0)) - 1) / chunk_bytes).cast("int")))
    return (rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_bytes")))
            .withColumn("_chunk", F.explode(steps))
            .select("_id", "_url", "_digest", "_owner", "_bytes", "_copy", "_chunk",
                    F.substring("_payload", F.col("_chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("_data"))
            .sortWithinPartitions("_id", "_digest", "_copy", "_chunk"))


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_head(row: dict) -> bytes:
    """The header block of a record; the length is known before the payload is."""
    key = "null" if row["_id"] is None else row["_id"]
    revisit = row["_owner"] is not None
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{key}:{row['_digest']}:{row['_copy']}>"),
             ("WARC-Date", "1970-01-01T00:00:00Z"),
             ("WARC-Target-URI", "".join(c for c in row["_url"] or "" if c >= " ")),
             ("WARC-Payload-Digest", f"sha1:{base32(row['_digest'])}"), ("Content-Type", "text/html; charset=utf-8")]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{row['_owner']}:{row['_digest']}:1>")]
    lines.append(("Content-Length", str(0 if revisit else row["_bytes"])))
    return BREAK.join([VERSION, *(f"{k}: {v}".encode() for k, v in lines)]) + BREAK * 2


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write one record per page and return the manifest, one row per archive.

    A null payload is empty; a null id gives a response of its own; rows that
    repeat an id with another payload are records of their own, and repeated
    equal rows all are written: a record's id names page, payload digest and
    copy.  Other input columns are not read; an empty table gives an empty manifest.
    An archive is a file of gzip members, one per record, under a name that no
    other attempt uses.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, packer, current, records = None, None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    file = AttemptFile(folder, f"archive-{TaskContext.get().partitionId():06d}", ".warc.gz")
                if row["_chunk"] == 0:
                    if packer is not None:
                        file.write(packer.compress(BREAK * 2) + packer.flush())
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    file.write(packer.compress(record_head(row)))
                    records += 1
                if row["_data"]:
                    file.write(packer.compress(row["_data"]))
        if file is None:
            return
        file.write(packer.compress(BREAK * 2) + packer.flush())
        size, uri = file.position, file.close()
        yield pa.RecordBatch.from_pylist(
            [{"archive": TaskContext.get().partitionId(), "uri": uri, "records": records, "bytes": size}],
            schema=pa.schema([("archive", pa.int32()), ("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    spark = pages.sparkSession
    rows = chunked(with_roles(pages, id_col, url_col, payload_col, min_bytes), chunk_bytes)
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Inflated:
    """The bytes of a file of gzip members, asked for piece by piece."""

    def __init__(self, uri: str, step: int = 1 << 18):
        store, path = file_system(uri)
        self.stream, self.step = store.open_input_stream(path), step
        self.raw, self.inflater, self.buffer = b"", zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while True:
            if self.inflater.eof:
                self.raw = self.inflater.unused_data or self.raw
                self.inflater = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    return False
            data = self.inflater.decompress(self.raw, self.step)
            self.raw = self.inflater.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def take(self, size: int) -> bytes:
        """Up to `size` bytes, fewer only at the end of the file."""
        while len(self.buffer) < size and self._more():
            pass
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def head(self) -> dict[str, str] | None:
        """The next header block, or None at the end of the file."""
        while (at := self.buffer.find(BREAK * 2)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record header")
                return None
        lines = self.take(at + 4).split(BREAK)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        pairs = (line.decode("utf-8").split(":", 1) for line in lines[1:] if line)
        return {k.lower(): v.strip() for k, v in pairs}


def archive_chunks(uri: str, chunk_bytes: int) -> Iterator[tuple]:
    """The rows of CHUNKS of one archive."""
    source = Inflated(uri)
    while (head := source.head()) is not None:
        left, chunk, seen, digest = int(head["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = source.take(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"{uri} ends within a record")
            left, seen = left - len(data), seen + len(data)
            digest.update(data)
            yield (head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"),
                   head.get("warc-payload-digest", "").removeprefix("sha1:"), chunk, data, left == 0, seen,
                   base64.b32encode(digest.digest()).decode() if left == 0 else None)
            chunk += 1
            if left == 0:
                break
        if source.take(4) != BREAK * 2:
            raise ValueError(f"{uri}: a record does not end as its length says")


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all archives of a manifest; any table with a `uri` column will do.

    payload_bytes runs up over the chunks of a record; the last chunk (`last`)
    carries the digest of what was read.  Damaged archives fail the job.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in archive_chunks(uri, chunk_bytes):
                    rows.append(row)
                    size += len(row[6]) + 256
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)

    return manifest.select("uri").repartition(partitions(manifest), "uri").mapInArrow(read, CHUNKS_DDL)


def resolved(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes length and digest from the response it refers to; the digest
    of every record must be the one its header states, else the job fails.  The
    record table is written first: archives are read once, and Spark then joins by
    its true size and not by that of the manifest.
    """
    number = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+):", 1).try_cast("long")
    ends = materialise(chunks.where("last").select(
        "record", "type", "refers_to", "stated_digest", "payload_bytes", "payload_digest"), "warc-records")
    responses = (ends.where("type = 'response'")
                 .select(F.col("record").alias("refers_to"), F.col("payload_bytes").alias("_b"), F.col("payload_digest").alias("_d")))
    # Responses refer to nothing and need no join.
    revisits = ends.where("type = 'revisit'").join(responses, "refers_to", "left")
    rows = revisits.unionByName(ends.where("type <> 'revisit' OR type IS NULL").select(
        "*", F.lit(None).cast("long").alias("_b"), F.lit(None).cast("string").alias("_d")))
    digest = F.when(F.col("type") == "revisit", F.col("_d")).otherwise(F.col("payload_digest"))
    return rows.select(
        number("record").alias("page_id"),
        F.when(F.col("type") == "revisit", F.col("_b")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(digest == F.col("stated_digest"), digest).otherwise(
            F.raise_error(F.concat(F.lit("payload digest of "), "record"))).alias("payload_digest"),
        F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
