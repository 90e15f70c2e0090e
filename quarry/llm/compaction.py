"""Sharded tables with size-tiered compaction and versioned manifests; native Spark only.

A table is a folder.  ``append`` writes arrivals as small immutable shards (Parquet files);
``compact`` merges shards of one size tier into files of the target size once a tier holds
``fanout`` of them; ``commit`` makes a list of shards the next version by renaming a manifest
to its final name, which fails if another writer took that version first.  The writer then starts
anew from the version that won: an append adds its shards to that one, a merge whose shards are
still there takes them out of it.  Readers use the files that one manifest names, so they see whole
versions only; files of failed tasks and lost races are named by none.

While arrivals are committed one by one, up to ``MERGES`` merges run beside them.  A merge claims its
shards, so no other of this process takes them.

A writer announces its folder in ``writing`` before it writes and withdraws it after it has committed;
``vacuum`` leaves announced folders alone, unless the announcement is older than ``lease`` seconds.

The driver holds a manifest: one line per file, never per row.  Rows keep all their columns;
columns that clash with the arrival column are refused.  Nulls, repeated rows and empty texts
are stored as they are; an empty arrival adds no shard.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_path

ARRIVAL = "_arrival"
#: Merges that run at a time while arrivals are committed.
MERGES = 4


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class _Overtaken(RuntimeError):
    """Another writer has merged the same shards."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardedTable:
    """``target``: bytes of a full shard; ``least``: bytes of the lowest tier; ``fanout``: shards of a
    tier that are merged, and the ratio of tiers."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target: int = 128 << 20, least: int = 256 << 10, fanout: int = 4, lease: float = 7 * 86400):
        self.lease = lease
        self._known: dict[int, list[Shard]] = {}  # the version last read or written
        self._claimed: set[str] = set()  # shards that a merge of this process is reading
        self._claiming, self._deleting = Lock(), Lock()
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.least, self.fanout = target, least, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("manifests", "writing"):
            self._fs.mkdirs(self._path(f"{self.root}/{part}"))

    def version(self) -> int:
        """The last committed version; 0 is the empty table."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        found = self._known.get(version)  # a version never changes
        if found is None:
            held = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
            found = [Shard(**x) for x in json.loads(bytes(held.readAllBytes()))["shards"]]
            held.close()
            self._known = {version: found}
        return list(found)

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make ``shards`` version base + 1, in one step or not at all."""
        jvm, version = self.spark._jvm, base + 1
        final = self._path(f"{self.root}/manifests/v{version:08d}.json")
        draft = self._path(fresh_path(self.spark, "draft"))
        draft = self._path(f"{self.root}/manifests/.{draft.getName()}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise
        self._known = {version: list(shards)}
        return version

    def _written(self, folder: str) -> list[Shard]:
        files = self._fs.listFiles(self._path(folder), True)
        out = []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().startswith("part-"):
                out.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(out, key=lambda s: s.path)

    @contextmanager
    def _announced(self, kind: str) -> Iterator[str]:
        """A new data folder, safe from ``vacuum`` until the block ends."""
        name = fresh_path(self.spark, kind).rpartition("/")[2]
        note = self._path(f"{self.root}/writing/{name}")
        self._fs.create(note, False).close()
        try:
            yield f"{self.root}/data/{name}"
        finally:
            self._fs.delete(note, False)

    def _commit_on(self, change: Callable[[list[Shard]], list[Shard]]) -> int:
        """Commit a change of the last version, anew from whichever version wins a race."""
        while True:
            base = self.version()
            try:
                return self.commit(base, change(self.shards(base)))
            except Conflict:
                continue

    def append(self, df: DataFrame, arrival: Column | None = None, keep: int | None = None) -> int:
        """Commit the rows as new shards; returns the version.  With ``arrival``, the rows of each value of
        it are an arrival: written in one pass, then committed one by one; the merges that are due after each
        run beside the next commits, and all are done at the end.  ``keep``: delete as ``vacuum`` does after them."""
        if ARRIVAL in df.columns:
            raise ValueError(f"a column is named {ARRIVAL}")
        with self._announced("a") as folder:
            if arrival is None:
                df.write.parquet(folder)
                return self._commit_on(lambda shards: shards + self._written(folder))
            df.withColumn(ARRIVAL, arrival).write.partitionBy(ARRIVAL).parquet(folder)
            arrivals: dict[str, list[Shard]] = {}
            for shard in self._written(folder):
                arrivals.setdefault(shard.path.rpartition("/")[0], []).append(shard)
            waiting = frozenset(s.path for own in arrivals.values() for s in own)

            def settle() -> None:
                if self._settle() and keep is not None:
                    self.vacuum(keep, folder.rpartition("/")[2], lambda: waiting)

            with ThreadPoolExecutor(MERGES) as pool:
                merges = []
                for own in arrivals.values():
                    self._commit_on(lambda shards, own=own: shards + own)
                    waiting -= {s.path for s in own}
                    merges.append(pool.submit(inheritable_thread_target(self.spark)(settle)))
            for merge in merges:
                merge.result()
        return self.version()

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.least, self.fanout))) if size > self.least else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similar size that are due: of every tier below the target with ``fanout`` or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target * 0.75:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [own for _, own in sorted(tiers.items()) if len(own) >= self.fanout]

    def compact(self) -> int:
        """Merge until no tier is due; each merge is a version of its own."""
        self._settle()
        return self.version()

    def _settle(self) -> bool:
        """Merge what is due and not claimed, until nothing is; whether there was any."""
        merged = False
        while own := self._claim():
            try:
                self._merge(own)
            finally:
                with self._claiming:
                    self._claimed -= {s.path for s in own}
            merged = True
        return merged

    def _claim(self) -> list[Shard]:
        """A run that is due, of shards that no other merge of this process has; none: an empty list."""
        with self._claiming:
            due = self.plan([s for s in self.shards() if s.path not in self._claimed])
            own = due[0] if due else []
            self._claimed |= {s.path for s in own}
            return own

    def _merge(self, own: list[Shard]) -> None:
        """Merge shards and commit, unless another writer has merged some of them already."""
        total = sum(s.bytes for s in own)
        # Whole files go to tasks of about equal bytes, without a shuffle.
        files = max(1, round(total / self.target)) if total >= self.target else max(1, min(len(own) // self.fanout, math.ceil(total / (self.least * self.fanout ** (self.tier(own[0].bytes) + 2)))))
        gone = {s.path for s in own}

        def change(shards: list[Shard]) -> list[Shard]:
            if not gone <= {s.path for s in shards}:
                raise _Overtaken
            return [s for s in shards if s.path not in gone] + self._written(folder)

        with self._announced("m") as folder:
            self.read_shards(own).coalesce(files).write.parquet(folder)
            try:
                self._commit_on(change)
            except _Overtaken:
                self._fs.delete(self._path(folder), True)

    def read_shards(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        return self.read_shards(self.shards(version))

    def vacuum(self, keep: int = 1, own: str | None = None, waiting: Callable[[], frozenset[str]] = frozenset) -> int:
        """Delete data files that none of the last ``keep`` versions names and no writer may still commit;
        returns how many.  Readers of older versions must be done.  Of the folder ``own``, which the caller
        has announced, only the files ``waiting`` gives may still be committed."""
        with self._deleting:  # one at a time: a listing fails where a file goes meanwhile
            return self._vacuum(keep, own, waiting)

    def _vacuum(self, keep: int, own: str | None, waiting: Callable[[], frozenset[str]]) -> int:
        # In this order: a folder that is there was announced, so one without a note is committed by now, and
        # named by a version that is read after.  Folders that are being written aren't looked into.
        root, still = self._path(f"{self.root}/data"), waiting()
        folders = [f.getPath() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        notes = self._fs.listStatus(self._path(f"{self.root}/writing"))
        oldest = (time.time() - self.lease) * 1000
        busy = {n.getPath().getName() for n in notes if n.getModificationTime() >= oldest} - {own}
        written = [s for f in folders if f.getName() not in busy for s in self._written(f.toString())]
        last = self.version()
        named = {s.path for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)} | still
        gone = [s for s in written if s.path not in named]
        for s in gone:
            self._fs.delete(self._path(s.path), False)
        return len(gone)


def compacted(docs: DataFrame, arrivals: int = 16, target: int = 128 << 20) -> DataFrame:
    """Append the rows in ``arrivals`` arrivals (by a hash of doc_id and text), one version after the
    other, beside the merges that are due, and read the last version: all columns, as stored, with
    ``shard`` (the place of the row's file in the manifest, null if it names no such file), ``tier``,
    ``tier_shards`` (shards of that tier that a merge may still take) and ``version``."""
    spark = docs.sparkSession
    table = ShardedTable(spark, fresh_path(spark, "shards"), docs.schema, target)
    table.append(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)), keep=1)
    table.vacuum()
    version = table.version()
    shards = table.shards(version)
    tiers = [table.tier(s.bytes) if s.bytes < target * 0.75 else -1 for s in shards]
    # A row per file of the manifest, which the driver holds anyhow.
    place = f"{table.root.rpartition('/')[2]}/data/"
    listed = json.dumps([{"_file": s.path.partition(place)[2], "shard": k, "tier": t, "tier_shards": tiers.count(t) if t >= 0 else 0, "version": version} for k, (s, t) in enumerate(zip(shards, tiers, strict=True))])
    manifest = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<_file: string, shard: long, tier: int, tier_shards: int, version: long>>")))
    rows = table.read(version)
    name = F.substring_index("_metadata.file_path", place, -1) if shards else F.lit(None).cast("string")
    return rows.select("*", name.alias("_name")).join(F.broadcast(manifest), F.col("_name") == F.col("_file"), "left").drop("_name", "_file")
