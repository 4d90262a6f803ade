"""WARC archives as tables of chunks.

A payload is a run of rows (record, chunk number, bytes), so neither writing nor reading ever holds a whole record in
Python: the writer passes chunks on to a compressed record as they come, the reader gives a record's chunks as it
decompresses them, with the SHA-1 of all bytes so far.  Records with equal payloads are written once as response, that of
the largest id; the others are revisit records that refer to it and keep the HTTP header with the payload's length.

Archives lie in the shared folder.  A task names the files it has written, and only the names that Spark has committed are
read, so files of lost or repeated tasks do no harm.

Results in odd cases: a null payload is empty; a null address gives the record's own name as target; a row without an id
is a response if no row with an id has its payload, and reads back with a null id; an empty text is an id like others;
repeated rows of one id and payload are written alike; very long payloads are many chunks; columns other than id, address
and payload are not read; an empty table gives an empty archive table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, in_batches, shared_folder, stored

NAME = "urn:page:"
UNNAMED = "urn:unnamed-page"  # rows without an id
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_bytes: int = 0,
           chunk_bytes: int = 1 << 16) -> DataFrame:
    """(id, url, size, sha1, refers_to, row, chunk, data): all records as runs of chunk rows, which follow each other in a partition.

    What becomes of a record is decided from (id, size, sha1) alone.  A payload is cut where it is read, so only chunks
    move, to meet the one id that keeps them; that join has no hot keys.  ``refers_to`` is null for responses; a revisit has
    one empty chunk.  Payloads of fewer than ``min_bytes`` bytes are all responses.
    """
    payload = F.coalesce(column(payload_col).cast("string"), F.lit("")).cast("binary")
    read = pages.select(column(id_col).alias("id"), column(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.monotonically_increasing_id().alias("row"))
    read = read.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    names = stored(read.select("id", "url", "size", "sha1"))
    long_enough = names.where(F.col("size") >= min_bytes)
    keepers = stored(long_enough.groupBy("sha1").agg(F.max("id").alias("keeper")))
    last = F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1)).cast("int") - 1
    cut = read.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    data = F.substring(F.col("payload"), F.col("chunk") * F.lit(chunk_bytes) + 1, F.lit(chunk_bytes))
    nobody = F.lit(None).cast(names.schema["id"].dataType).alias("refers_to")
    cut = cut.select("id", "url", "size", "sha1", nobody, "row", "chunk", data.alias("data"))
    found = cut.where(F.col("size") >= min_bytes).join(
        keepers.withColumnRenamed("sha1", "__sha1"), F.col("id").eqNullSafe(F.col("keeper")) & (F.col("sha1") == F.col("__sha1"))).select(*cut.columns)
    revisits = (long_enough.join(keepers, "sha1").where(~F.col("id").eqNullSafe(F.col("keeper")))
                .select("id", "url", "size", "sha1", F.col("keeper").alias("refers_to"), F.lit(-1).cast("long").alias("row"), F.lit(0).alias("chunk"),
                        F.lit(b"").alias("data")))
    if min_bytes > 0:
        found = found.unionAll(cut.where(F.col("size") < min_bytes))
    # Chunks of one record come from one task, so no split of a large partition parts them.
    return found.sortWithinPartitions("id", "sha1", "row", "chunk").unionAll(revisits)


# --- writing -------------------------------------------------------------------------------------

def _name(value: object) -> str:
    return UNNAMED if value is None else NAME + quote(str(value), safe="")


def _digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header(row: dict, date: str) -> bytes:
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    target = quote(row["url"], safe="/:?#[]@!$&'()*+,;=%~") if row["url"] else _name(row["id"])
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(row['id'])}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{_digest(row['sha1'])}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(http) + (0 if revisit else row['size'])}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{_name(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(parts: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write chunk rows, a record's rows following each other, and give the committed table of files (path, n_records)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())])

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        out, path, written, count = None, "", 0, 0
        packer = None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([count], pa.int64())], schema.fieldNames())

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if packer:
                        written += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    if out and written >= file_bytes:
                        yield closed()
                        out = None
                    if not out:
                        files.create_dir(base, recursive=True)
                        path, written, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = files.open_output_stream(path, compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # every record is a gzip member of its own
                    count += 1
                    written += out.write(packer.compress(_header(row, date)))
                written += out.write(packer.compress(row["data"]))
        if out:
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            yield closed()

    return stored(in_batches(parts, put, schema))


# --- reading -------------------------------------------------------------------------------------

CHUNK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("chunk", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("digest_so_far", T.StringType()),
    T.StructField("is_last", T.BooleanType())])


def _fields(stream: BinaryIO) -> dict[str, str]:
    """Header lines up to the blank one, by lower-case name; the first line under the empty name."""
    found: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        found["" if not found else name.strip().lower()] = value.strip()
    return found


def _named(reference: str | None) -> str | None:
    """The id of a record's name; an empty id is not a missing one."""
    name = (reference or "").strip("<>")
    return unquote(name.removeprefix(NAME)) if name.startswith(NAME) else None


def _read_record(stream: BinaryIO, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of the record at the stream's place; none at the end."""
    warc = _fields(stream)
    if not warc:
        return
    left = int(warc["content-length"])
    begin = stream.tell()
    http = _fields(stream)
    left -= stream.tell() - begin
    row = {"id": _named(warc["warc-record-id"]), "record_type": warc["warc-type"], "refers_to": _named(warc.get("warc-refers-to")),
           "size": int(http["content-length"]), "digest": warc["warc-payload-digest"].removeprefix("sha1:")}
    state, number, offset = hashlib.sha1(), 0, 0
    while True:
        data = stream.read(min(left, chunk_bytes))
        if len(data) < min(left, chunk_bytes):
            raise EOFError(f"record {row['id']} ends early")
        state.update(data)
        left -= len(data)
        yield row | {"chunk": number, "offset": offset, "data": data, "digest_so_far": base64.b32encode(state.digest()).decode(), "is_last": not left}
        number, offset = number + 1, offset + len(data)
        if not left:
            break
    if stream.read(4) != b"\r\n\r\n":
        raise ValueError(f"record {row['id']} is not closed")


def read(files: DataFrame, folder: str, *, chunk_bytes: int = 1 << 16, batch_bytes: int = 1 << 24) -> DataFrame:
    """The chunk rows of all records in the files of a table (path): see ``CHUNK``.  Each row has the digest of the payload so far."""
    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pa.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("size", pa.int64()), ("digest", pa.string()),
                            ("chunk", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    while rows := _read_record(stream, chunk_bytes):
                        empty = True
                        for row in rows:
                            empty = False
                            held.append(row)
                            size += len(row["data"]) + 200
                            if size >= batch_bytes:
                                yield pa.RecordBatch.from_pylist(held, schema)
                                held, size = [], 0
                        if empty:
                            break
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    paths = files.select("path")
    return in_batches(paths.repartition(max(1, paths.count())), get, CHUNK)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, min_bytes: int = 0,
               chunk_bytes: int = 1 << 16, **writing) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back as chunk rows."""
    folder = shared_folder(pages.sparkSession)
    files = write(chunks(pages, id_col, url_col, payload_col, min_bytes=min_bytes, chunk_bytes=chunk_bytes), folder, **writing)
    return read(files, folder, chunk_bytes=chunk_bytes)


def whole_records(read_chunks: DataFrame, id_type: T.DataType) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of records, from the last chunk of each.

    A response's length and digest are those of the bytes that were read; a revisit has them in its header.
    """
    response = F.col("record_type") == "response"
    return read_chunks.where("is_last").select(
        F.col("id").cast(id_type).alias("id"),
        F.when(response, F.col("offset") + F.octet_length("data")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("digest")).alias("payload_digest"), "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))
