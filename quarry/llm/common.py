"""Shared helpers: the shared folder, tables that cut lineage, vectorised text hashing."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _importable() -> None:
    """Let Python workers that start on this host import the library from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for place in (os.environ, *([c.environment] if (c := SparkContext._active_spark_context) else [])):
        held = place.get("PYTHONPATH", "")
        if root not in held.split(os.pathsep):
            place["PYTHONPATH"] = os.pathsep.join(filter(None, (root, held)))


_importable()

#: Used only by local sessions that leave spark.checkpoint.dir unset, as tests do.
DEFAULT_SHARED = "file:///tmp/checkpoints/quarry"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


_written: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage
    and survives the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.quarry_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``saved`` writes in the block are deleted at its end, but for those passed to the
    function it gives, which the block around it, if any, then owns."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.quarry_path)
        return df

    _written.append([])
    try:
        yield keep
    finally:
        made = _written.pop()
        for path in made:
            if path not in kept:
                remove(spark, path)
        if _written:
            _written[-1].extend(p for p in made if p in kept)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done: it does when the driver's garbage goes."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows and bytes of an Arrow batch at most (one row may be longer): a Python worker holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(operator: Callable) -> Callable:
    """Have the session hand this operator's Python workers batches of ``BATCH_ROWS`` and
    ``BATCH_BYTES`` at most.  The settings are only ever lowered, and stay, since plans run after
    the operator has returned."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
            if not 0 < int(conf.get(name).rstrip("b")) <= most:
                conf.set(name, str(most))
        return operator(df, *args, **kwargs)

    return run


#: Tasks that read written files back at most: beyond it each takes more of them, one after the other.
READ_TASKS = 20_000


def read_tasks(total: int, each: int) -> int:
    """How many tasks read ``total`` bytes, about ``each`` at a time."""
    return min(READ_TASKS, 1 + total // each)


_kept: list[Callable[[], None]] = []


def keep_until_other_work(clear: Callable[[], None]) -> None:
    """Register what a worker keeps between tasks of one kind."""
    _kept.append(clear)


def other_work() -> None:
    """Begin a task of another kind: what was kept goes, so workers that are reused stay small."""
    for clear in _kept:
        clear()


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(wide).to_pylist()


#: ASCII white space; exactly what bytes.split() splits on.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Powers that a worker keeps for work of another kind; more go with the work that asked for them.
KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    size = 1 << max(16, (n - 1).bit_length())
    best = max(_powers, default=0)
    if best < size:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)
        best = size
    return _powers[best]


def _drop_powers() -> None:
    if max(_powers, default=0) > KEPT_POWERS:
        _powers.clear()


keep_until_other_work(_drop_powers)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a byte array: entry i covers data[:i]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of data[start:end], from prefix hashes."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered text, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return mix(span_hash(prefix_hash(data), start, end) + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The set (sorted, distinct) of hashed ``size``-word shingles; fewer words make one
    shingle of the whole sequence, no words none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(0x9DDFEA08EB382D69)
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


#: Bits of an id filter at most: 16 MB on the driver and in each worker, whatever the number of ids.
FILTER_BITS = 1 << 27


def _filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Four places of every id."""
    seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    return (mix(ids.astype(np.int64).view(np.uint64)[:, None] ^ seeds) % np.uint64(bits)).astype(np.int64)


class IdFilter:
    """A Bloom filter of ids: it may let others pass, never keeps one of its own back."""

    def __init__(self, bits: int, words: dict[int, bytes], spark: SparkSession):
        data = np.zeros(bits // 8, np.uint8)
        for bucket, part in words.items():
            data[bucket * 4096 : bucket * 4096 + 4096] = np.frombuffer(part, np.uint8)[: len(data) - bucket * 4096]
        self.bits, self.data = bits, spark.sparkContext.broadcast(data)

    def has(self, ids: pa.Array) -> np.ndarray:
        """Whether each id may be held; null ids aren't."""
        known = np.array(ids.is_valid(), bool)
        place = _filter_places(ids.fill_null(0).to_numpy(zero_copy_only=False), self.bits)
        data = self.data.value
        return known & ((data[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(1).astype(bool)


def id_filter(df: DataFrame, column: str) -> IdFilter:
    """The filter of a column's ids: bits are set where the ids are, then joined by Spark's bitmap
    aggregate, one 4 kB row for each 32,768 bits."""
    n = df.count()
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))

    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = _filter_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits)
        return pa.RecordBatch.from_arrays([pa.array(place.ravel())], names=["place"])

    spread = per_batch(df.select(F.col(column).cast("long")), places, "place long")
    rows = spread.groupBy(F.floor(F.col("place") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(32768))).alias("bitmap")).collect()
    return IdFilter(bits, {int(r["bucket"]): bytes(r["bitmap"]) for r in rows}, df.sparkSession)


def held_only(df: DataFrame, held: IdFilter, column: str, inside: bool = True) -> DataFrame:
    """The rows whose id may be in the filter, or those whose id isn't."""
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            yield batch.filter(pa.array(held.has(batch.column(place)) == inside))

    return df.mapInArrow(run, df.schema)
