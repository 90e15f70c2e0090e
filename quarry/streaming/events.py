"""Structured Streaming: the append log as a stream, event-time windows, refresh per micro-batch."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

LOG = "key string, id long, fields map<string,string>"


class AppendLog:
    """An append-only folder of entries (key, id, fields) with ids that only grow within a key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, key: str, entries: list[dict[str, str]]) -> list[int]:
        """Add entries in one atomic batch; returns their ids.  Writers may run at once: ids are taken
        before rows are written, and a writer that fails in between leaves a gap."""
        first = self._taken(key, len(entries))
        ids = list(range(first, first + len(entries)))
        if ids:
            self.spark.createDataFrame([(key, i, e) for i, e in zip(ids, entries, strict=True)], LOG).coalesce(1).write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        return ids

    def _taken(self, key: str, n: int) -> int:
        """Take the next ``n`` ids of a key: a note with the last one is renamed to its batch's number, which
        fails if another writer has that number already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_ids/{hashlib.sha256(key.encode()).hexdigest()}")
        fs = folder.getFileSystem(conf)
        fs.mkdirs(folder)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            notes = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName()[0] == "n")
            if notes:
                held = fs.open(jvm.org.apache.hadoop.fs.Path(folder, notes[-1]))
                last = held.readLong()
                held.close()
            else:  # a log of before there were notes
                last = self.read().filter(F.col("key") == key).agg(F.max("id")).first()[0] or 0
            draft, final = (jvm.org.apache.hadoop.fs.Path(folder, x) for x in (f"draft-{uuid.uuid4().hex}", f"n{int(notes[-1][1:]) + 1 if notes else 1:012d}"))
            out = fs.create(draft, False)
            out.writeLong(last + n)
            out.close()
            try:
                context.rename(draft, final, none)
                return last + 1
            except Exception:
                fs.delete(draft, False)
                if not fs.exists(final):
                    raise
                time.sleep(0.02)

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(self.path)

    def range(self, key: str, start: int | None = None, stop: int | None = None) -> DataFrame:
        rows = self.read().filter(F.col("key") == key)
        rows = rows if start is None else rows.filter(F.col("id") >= start)
        rows = rows if stop is None else rows.filter(F.col("id") <= stop)
        return rows.orderBy("id")

    def length(self, key: str) -> int:
        return self.read().filter(F.col("key") == key).count()

    def stream(self) -> DataFrame:
        """The log as it grows."""
        return self.spark.readStream.schema(LOG).option("recursiveFileLookup", True).parquet(self.path)


def event_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Counts and sums per window; ``late`` is the watermark of a stream."""
    events = events if late is None else events.withWatermark(time, late)
    out = events.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, time: str = "ts", width: str = "1 hour", step: str = "30 minutes", by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    events = events if late is None else events.withWatermark(time, late)
    out = events.groupBy(F.window(time, width, step), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", by: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    events = events if late is None else events.withWatermark(time, late)
    out = events.groupBy(by, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), "n")


def refresh_each_batch(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Run ``refresh(rows, batch)`` for each micro-batch, as a materialized view's upkeep."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
