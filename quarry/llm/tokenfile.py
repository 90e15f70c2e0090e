"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A record is: payload length (u64), masked CRC-32 of those eight bytes (u32), payload,
masked CRC-32 of the payload (u32), all little-endian.  The payload is one byte with the
id width (2 or 4, the least that holds every id of the vocabulary) and the ids.  The index (Parquet) has one row per record: file, offset,
length, document, number of ids and the ids before it, so records can be read in any order.

Null texts are empty texts and give the end id alone.  Repeated and null doc_ids are
allowed; nulls come first, equal ids in an order fixed by their texts.  Empty tables give
an empty index.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, read_tasks, utf8
from .tokens import encoder

_MASK = 0xA282EAD8
#: Bytes of a file that one task reads together.
STRIPE = 8 << 20
INDEX = "part int, file string, doc_id long, offset long, length long, n_tokens long, local_start long"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted by a constant so that stored checksums of checksums stay sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(ids: bytes, width: int) -> bytes:
    """One record from little-endian unsigned 32-bit ids; raises if the width can't hold one."""
    if width == 4:
        body = ids
    else:
        wide = np.frombuffer(ids, "<u4")
        if len(wide) and wide.max() > 0xFFFF:
            raise ValueError("an id needs more than two bytes")
        body = wide.astype("<u2").tobytes()
    payload = bytes([width]) + body
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The ids of a record, as little-endian unsigned 32-bit bytes; raises if it is damaged."""
    (n,) = struct.unpack_from("<Q", record)
    payload = record[12 : 12 + n]
    if struct.unpack_from("<I", record, 8)[0] != masked(record[:8]) or struct.unpack_from("<I", record, 12 + n)[0] != masked(payload):
        raise ValueError("a record's checksum is wrong")
    return payload[1:] if payload[0] == 4 else np.frombuffer(payload[1:], "<u2").astype("<u4").tobytes()


@bounded_batches
def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int | None = 2, id_width: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into record files under ``out_dir`` in ascending doc_id
    order; returns the index (already written), with ``start``: the ids of all documents before.
    ``id_width`` None: by the size of the vocabulary.

    Each task writes a file of a name of its own; only files that the index names count, so a
    task that runs twice does no harm.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, place, start = TaskContext.get().partitionId(), None, 0, 0
        enc = encoder(tokenizer_path)
        width = id_width or (2 if max(enc.size, (end_id or 0) + 1) <= 1 << 16 else 4)
        store, root = pafs.FileSystem.from_uri(out_dir)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.rec"
        try:
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    ids = enc.encode(text, end)
                    record = frame(ids, width)
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                    out.write(record)
                    rows.append((part, name, doc, place, len(record), len(ids) // 4, start))
                    place += len(record)
                    start += len(ids) // 4
                if rows:
                    types = (pa.int32(), pa.string(), *[pa.int64()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    index_path = f"{out_dir}/index"
    ordered.mapInArrow(write, INDEX).write.parquet(index_path)
    index = spark.read.schema(INDEX).parquet(index_path)
    # One row per file: the only thing that is put in one order.
    base = index.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(base.select("part", before.alias("base")), "part").select(*[c for c in index.columns if c != "local_start"], (F.col("base") + F.col("local_start")).alias("start"))


@bounded_batches
def read_records(index: DataFrame, out_dir: str, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Read the indexed records back: adjacent ones in one ranged read of at most ``most`` bytes
    (a longer record is read alone).  Adds ``ids`` (binary, little-endian unsigned 32-bit)."""
    # As many tasks as there are stripes of records to read: the index itself is too small to tell.
    total = index.agg(F.sum("length")).first()[0] or 0
    index = index.repartition(read_tasks(total, STRIPE), "file", F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("file", "offset")
    names = index.columns
    at = {c: i for i, c in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out_dir)
        open_name, source = None, None
        for batch in batches:
            file, offset, length = (batch.column(at[c]).to_pylist() for c in ("file", "offset", "length"))
            order = sorted(range(len(file)), key=lambda i: (file[i], offset[i]))
            i = 0
            while i < len(order):
                j, first = i + 1, order[i]
                stop = offset[first] + length[first]
                while j < len(order) and file[order[j]] == file[first] and offset[order[j]] - stop <= gap and offset[order[j]] + length[order[j]] - offset[first] <= most:
                    stop = max(stop, offset[order[j]] + length[order[j]])
                    j += 1
                if file[first] != open_name:
                    open_name, source = file[first], store.open_input_file(f"{root}/{file[first]}")
                data = source.read_at(stop - offset[first], offset[first])
                own = order[i:j]
                ids = [unframe(data[offset[k] - offset[first] : offset[k] - offset[first] + length[k]]) for k in own]
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*names, "ids"])
                i = j

    return index.mapInArrow(read, f"{index._jdf.schema().toDDL()}, ids binary")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write, read back, and digest: doc_id, start, n_tokens, ids_crc32."""
    out_dir = fresh_path(docs.sparkSession, "tokens")
    read = read_records(write_tokens(docs, tokenizer_path, out_dir, end_id), out_dir)
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
