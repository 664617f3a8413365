"""WARC archives compressed record by record with a Zstandard dictionary of their own records.

A task gathers records up to an archive's size, builds a dictionary from all of them, writes it as a leading skippable
frame and then every record as a frame of its own. Archives go to the shared folder under a name of the task attempt; the
manifest names those that count, so what a lost executor leaves is never read. Reading streams an archive record by record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import new_path, ready, staged, table

#: The skippable frame of a dictionary, and the formats' names.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
#: Bytes of records in an archive before compression, about; bytes of a dictionary; compression level.
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 24 << 20, 64 << 10, 3
#: Payloads of fewer bytes are written in full even if another record has them.
LEAST_REVISIT = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, captured: str = CAPTURED) -> bytes:
    """One record: a response with the payload behind its HTTP head, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {captured}", f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on all the records; from too few or too small ones, their own bytes."""
    try:
        return zstandard.train_dictionary(size, records, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(to, records: list[bytes]) -> int:
    """Dictionary frame, then a frame a record. Returns the bytes written."""
    dictionary = build_dictionary(records)
    raw = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    to.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    n = 8 + len(raw)
    for r in records:
        n += to.write(compress(r))
    return n


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields, block) of each record, one in memory at a time."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(n))
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)
    buffer = bytearray()

    def more() -> bool:
        got = reader.read(1 << 20)
        buffer.extend(got)
        return bool(got)

    def upto(mark: bytes) -> int:
        at = buffer.find(mark)
        while at < 0:
            seen = max(len(buffer) - len(mark), 0)
            if not more():
                return -1
            at = buffer.find(mark, seen)
        return at

    while (at := upto(b"\r\n\r\n")) >= 0:
        lines = bytes(buffer[:at]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError("not a record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        del buffer[: at + 4]
        while len(buffer) < size + 4:
            if not more():
                raise ValueError("cut short")
        block = bytes(buffer[:size])
        del buffer[: size + 4]
        yield head, block
    if buffer:
        raise ValueError("cut short")


def write_archives(pages: DataFrame, to: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record a row to archives in the folder `to`; returns the manifest (path, records, bytes), already made.

    pages: page_id, url, html (other columns are not read). A null html is an empty payload, a null url is named by the
    page. Of rows with equal payloads of at least `least_revisit` bytes that with the largest page_id is the response and
    the others revisit it; rows that share that page_id are all responses. A null page_id is smaller than any. An empty
    table writes no archive. Payloads meet by SHA-1 with a grouped maximum, so a payload that a third of all pages have
    costs a row a task; the join back may split it.
    """
    spark = ready(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"))
    refers = F.when((F.octet_length("html") >= least_revisit) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    joined = rows.join(last, "sha1").select("page_id", "url", "html", refers.alias("refers_to"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        records: list[bytes] = []
        size = number = 0

        def out() -> pa.RecordBatch:
            store, folder = fs.FileSystem.from_uri(to)
            store.create_dir(folder, recursive=True)
            name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                n = write_archive(f, records)
            return pa.RecordBatch.from_arrays([pa.array([f"{to}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([n], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                record = build_record(page, url, html.encode(), refers_to)
                records.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield out()
                    records, size, number = [], 0, number + 1
        if records:
            yield out()

    return staged(joined.mapInArrow(kernel, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the manifest's archives; payload is null for a revisit.

    A response whose payload is not of its digest and length raises. A page written without an id comes back with null.
    """
    ready(manifest.sparkSession)

    def number(uri: str) -> int | None:
        name = uri.rsplit(":", 1)[1].rstrip(">")
        return None if name == "None" else int(name)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as f:
                    for head, block in read_archive(f):
                        at = block.index(b"\r\n\r\n") + 4
                        http = dict(x.split(": ", 1) for x in block[: at - 4].decode().split("\r\n")[1:])
                        kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        payload = block[at:] if kind == "response" else None
                        if payload is not None and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} is damaged")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, payload))
                        held += len(block)
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spread = manifest.select("path").repartition(max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(kernel, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc(spark, sf_dir):
    manifest = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
