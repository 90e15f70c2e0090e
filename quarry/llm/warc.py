"""WARC archives with the index first, and coalesced ranged reads.

Each page becomes one record, compressed as a gzip member of its own, in files of a target
size.  Of pages with equal payloads (SHA-1 and length) that with the smallest page_id is a
``response``; the others are ``revisit`` records that refer to it and carry no payload.  The
index (Parquet) has file, offset, length, URL and digest per record.  Reading takes rows of
the index, sorts them by file and offset within stripes of a file, joins neighbours into one
ranged read, and parses the records.

A null payload is empty; a null URL is written as ``urn:none``.  Rows that repeat a page_id and
payload are all responses if the first is.  Pages without an id count as the smallest and refer
to themselves.  Empty tables give an empty index.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, read_tasks, saved, scratch, utf8

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Bytes after which a task begins another archive; bytes of a stripe and of one ranged read.
FILE_BYTES, STRIPE, READ = 256 << 20, 8 << 20, 8 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + ("urn:none" if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)),
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple:
    """A record's row; raises if a response's payload doesn't have its digest."""
    raw = io.BytesIO(zlib.decompress(data, 31))
    if raw.readline().rstrip() != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {}
    while line := raw.readline().rstrip(b"\r\n"):
        key, _, value = line.partition(b": ")
        fields[key.decode()] = value.decode()
    number = lambda x: int(x[10:-1]) if x[10:-1] else None
    block = raw.read(int(fields["Content-Length"]))
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != own):
        raise ValueError("a payload doesn't have its digest")
    url = fields["WARC-Target-URI"]
    return number(fields["WARC-Record-ID"]), None if url == "urn:none" else url, fields["WARC-Type"], own, size, number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload


@bounded_batches
def write_archives(pages: DataFrame, out_dir: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` under ``out_dir``; returns the index, already written."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    # Groups of any size shrink before the exchange; both sides of the join are plain
    # exchanges, so Spark can split a digest that very many pages share.
    firsts = saved(pages.groupBy("sha", "size").agg(F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-firsts")
    marked = pages.join(firsts, ["sha", "size"], "left").select("page_id", "url", "html", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        out, name, place = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), batch.column("first").to_pylist(), strict=True):
                    revisit = first is not None and page is not None and page != first
                    own = digest(payload)
                    data = record(page, url, payload, own, None if first == -(1 << 63) else first, revisit)
                    if out is None or place > file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    rows.append((name, place, len(data), page, url, own, "revisit" if revisit else "response"))
                    place += len(data)
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    marked.mapInArrow(write, INDEX).write.parquet(f"{out_dir}/index")
    return spark.read.schema(INDEX).parquet(f"{out_dir}/index")


@bounded_batches
def read_archives(index: DataFrame, out_dir: str, gap: int = 1 << 16, most: int = READ) -> DataFrame:
    """The records of the given index rows.  ``gap``: bytes between records that are read over."""
    # As many tasks as there are stripes of archive to read, up to a bound beyond which a task takes many: the index itself is too small to tell.
    total = index.agg(F.sum("length")).first()[0] or 0
    wanted = index.select("file", "offset", "length").repartition(read_tasks(total, STRIPE), "file", F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        name, source = None, None
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            file, offset, length = batch.column("file").to_pylist(), batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            i = 0
            while i < len(file):
                j, stop = i + 1, int(offset[i] + length[i])
                while j < len(file) and file[j] == file[i] and offset[j] - stop <= gap and offset[j] + length[j] - offset[i] <= most:
                    stop = max(stop, int(offset[j] + length[j]))
                    j += 1
                if file[i] != name:
                    name, source = file[i], store.open_input_file(f"{root}/{file[i]}")
                data = source.read_at(stop - int(offset[i]), int(offset[i]))
                rows = [parse(data[a : a + n]) for a, n in zip((offset[i:j] - offset[i]).tolist(), length[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])
                i = j

    return wanted.mapInArrow(read, RECORD)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back."""
    out_dir = fresh_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(pages, out_dir), out_dir)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
