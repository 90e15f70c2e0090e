"""Key-value structures over DataFrames: strings, hashes, lists, sets, sorted sets, streams.

Each structure is one long table of the catalog's state, so its commands take part in
transactions and it can be queried as ``information_schema.kv_...``.  A change adds its own rows to a
log, numbered, or marks of rows that are gone; of equal keys the last number counts.  Logs are
merged by levels, so a row is written again only a few times, whatever a structure's size.
"""

from __future__ import annotations

import re
import threading
import time
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Store
from ..sources.storage import SETTLED, due, read_parts

SCHEMAS = {
    "kv_strings": "key string, value string, expiry long",
    "kv_hash": "key string, field string, value string",
    "kv_list": "key string, index long, value string",
    "kv_set": "key string, member string",
    "kv_zset": "key string, score double, member string",
    "kv_stream": "key string, id long, field string, value string",
}
#: What names a row of each structure.
ON = {"kv_strings": ["key"], "kv_hash": ["key", "field"], "kv_list": ["key", "index"], "kv_set": ["key", "member"], "kv_zset": ["key", "member"], "kv_stream": ["key", "id", "field"]}
_LOGGED = "{}, _change long, _gone boolean"


def _alone(command: Callable) -> Callable:
    """A command that reads before it writes: one at a time."""

    @wraps(command)
    def run(self, *args, **kwargs):
        with self.lock:
            return command(self, *args, **kwargs)

    return run


def bounds(start: int, stop: int, n: int) -> tuple[int, int]:
    """Inclusive positions with negatives from the end, as (first, last); empty if first > last."""
    first = max(0, start + n if start < 0 else start)
    last = min(n - 1, stop + n if stop < 0 else stop)
    return first, last


def list_range(rows: DataFrame, key: str, start: int, stop: int, order: list, value: str) -> DataFrame:
    """Positions start..stop of every key's list: ``order`` within ``key``."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    edge = lambda x: F.lit(x) if x >= 0 else F.col("_n") + x
    return ranked.filter(F.col("_at").between(F.greatest(edge(start), F.lit(0)), edge(stop))).select(key, F.col("_at").cast("long").alias("index"), value)


class KeyValue:
    """The commands.  ``clock`` gives milliseconds."""

    def __init__(self, catalog: Catalog, clock=lambda: int(time.time() * 1000)):
        self.catalog, self.clock, self.lock = catalog, clock, threading.RLock()

    # Tables

    def _schema(self, name: str):
        return self.catalog.spark.createDataFrame([], _LOGGED.format(SCHEMAS[name])).schema

    def table(self, name: str) -> DataFrame:
        """A structure's rows, without expired strings."""
        store = self.catalog.state.stores.get(name, Store())
        rows = read_parts(self.catalog.spark, store.parts, self._schema(name))
        if store.changes:
            rows = self._last(name, rows)
        rows = rows.filter("not _gone").drop("_change", "_gone") if store.parts else rows.drop("_change", "_gone")
        return rows.filter(F.col("expiry").isNull() | (F.col("expiry") > self.clock())) if name == "kv_strings" else rows

    def _last(self, name: str, log: DataFrame) -> DataFrame:
        """Of rows with one name the last; filters by key reach the files."""
        rest = [c for c in log.columns if c not in ON[name]]
        last = log.groupBy(*ON[name]).agg(F.max_by(F.struct(*rest), "_change").alias("_v"))
        return last.select(*[F.col(c) if c in ON[name] else F.col(f"_v.{c}").alias(c) for c in log.columns])

    def load(self, name: str, rows: DataFrame) -> None:
        """Take a whole structure from a DataFrame of its columns."""
        given = self.catalog.spark.createDataFrame([], SCHEMAS[name]).schema
        whole = rows.select(*[F.col(f.name).cast(f.dataType) for f in given], F.lit(0).cast("long").alias("_change"), F.lit(False).alias("_gone"))
        _, path = self.catalog.store(whole, name)
        self.catalog.state.stores[name] = Store(((path, SETTLED),))

    def _rows(self, name: str, values: list[tuple]) -> DataFrame:
        return self.catalog.spark.createDataFrame(values, SCHEMAS[name]).coalesce(1)

    def _log(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        """Add a change's rows, and merge parts of the log of which there are many."""
        with self.lock:
            store = self.catalog.state.stores.get(name, Store())
            change = store.changes + 1
            _, path = self.catalog.store(rows.withColumns({"_change": F.lit(change).cast("long"), "_gone": F.lit(gone)}), name)
            parts = (*store.parts, (path, 0))
            while own := due(parts):
                level = dict(parts)[own[0]]
                merged = self._last(name, read_parts(self.catalog.spark, tuple((p, 0) for p in own), self._schema(name)))
                if len(own) == len(parts):
                    merged = merged.filter("not _gone")
                _, path = self.catalog.store(merged.coalesce(max(1, sum(map(self.catalog.files.size, own)) >> 27)), name)
                parts = (*[x for x in parts if x[0] not in own], (path, level + 1))
            self.catalog.state.stores[name] = Store(parts, change)

    def _upsert(self, name: str, values: list[tuple], on: list[str] | None = None) -> None:
        self._log(name, self._rows(name, values))

    def _drop(self, name: str, where: Column) -> int:
        rows = self.table(name).filter(where)
        gone = rows.count()
        if gone:
            self._log(name, rows, True)
        return gone

    def _own(self, name: str, key: str) -> DataFrame:
        return self.table(name).filter(F.col("key") == key)

    # Strings

    def set(self, key: str, value: str, ex: float | None = None, px: int | None = None, exat: float | None = None, pxat: int | None = None) -> None:
        expiry = self.clock() + int(ex * 1000) if ex is not None else self.clock() + px if px is not None else int(exat * 1000) if exat is not None else pxat
        self._upsert("kv_strings", [(key, str(value), expiry)], ["key"])

    def get(self, key: str) -> str | None:
        row = self._own("kv_strings", key).first()
        return row["value"] if row else None

    def delete(self, *keys: str) -> int:
        """Remove keys of any structure; returns how many there were."""
        found: set[str] = set()
        for name in SCHEMAS:
            own = {r["key"] for r in self.table(name).filter(F.col("key").isin(*keys)).select("key").distinct().collect()}  # the keys named
            if own:
                found |= own
                self._drop(name, F.col("key").isin(*keys))
        return len(found)

    def exists(self, *keys: str) -> int:
        return sum(any(not self._own(name, k).limit(1).isEmpty() for name in SCHEMAS) for k in keys)

    @_alone
    def expire(self, key: str, seconds: float) -> bool:
        row = self._own("kv_strings", key).first()
        if row:
            self._upsert("kv_strings", [(key, row["value"], self.clock() + int(seconds * 1000))], ["key"])
        return bool(row)

    def ttl(self, key: str) -> int:
        """Seconds left; -1 without expiry, -2 without the key."""
        row = self._own("kv_strings", key).first()
        return -2 if not row else -1 if row["expiry"] is None else max(0, -(-(row["expiry"] - self.clock()) // 1000))

    def keys(self, pattern: str = "*") -> list[str]:
        """Keys of all structures that match a glob pattern."""
        regex = "^" + re.sub(r"\\\[(.*?)\\\]", r"[\1]", re.escape(pattern)).replace(r"\*", ".*").replace(r"\?", ".") + "$"
        out: set[str] = set()
        for name in SCHEMAS:
            out |= {r["key"] for r in self.table(name).select("key").filter(F.rlike("key", F.lit(regex))).distinct().collect()}  # what was asked for
        return sorted(out)

    # Hashes

    @_alone
    def hset(self, key: str, fields: dict[str, str]) -> int:
        """Returns how many fields are new."""
        held = self.hmget(key, fields)
        self._upsert("kv_hash", [(key, f, str(v)) for f, v in fields.items()], ["key", "field"])
        return sum(v is None for v in held.values())

    def hmget(self, key: str, fields: Iterable[str]) -> dict[str, str | None]:
        fields = list(fields)
        got = {r["field"]: r["value"] for r in self._own("kv_hash", key).filter(F.col("field").isin(*fields)).collect()}
        return {f: got.get(f) for f in fields}

    @_alone
    def hsetnx(self, key: str, field: str, value: str) -> bool:
        new = self.hget(key, field) is None
        if new:
            self.hset(key, {field: value})
        return new

    def hget(self, key: str, field: str) -> str | None:
        return self.hmget(key, [field])[field]

    def hgetall(self, key: str) -> dict[str, str]:
        return {r["field"]: r["value"] for r in self._own("kv_hash", key).orderBy("field").collect()}

    def hdel(self, key: str, *fields: str) -> int:
        return self._drop("kv_hash", (F.col("key") == key) & F.col("field").isin(*fields))

    # Lists: the index only orders; pushes at the head take numbers below.

    def _ends(self, key: str) -> tuple[int, int]:
        row = self._own("kv_list", key).agg(F.min("index"), F.max("index")).first()
        return (0, -1) if row[0] is None else (row[0], row[1])

    @_alone
    def rpush(self, key: str, *values: str) -> int:
        _, last = self._ends(key)
        self._upsert("kv_list", [(key, last + 1 + i, str(v)) for i, v in enumerate(values)])
        return self.llen(key)

    @_alone
    def lpush(self, key: str, *values: str) -> int:
        """Each value in turn becomes the head."""
        first, _ = self._ends(key)
        self._upsert("kv_list", [(key, first - 1 - i, str(v)) for i, v in enumerate(values)])
        return self.llen(key)

    def llen(self, key: str) -> int:
        return self._own("kv_list", key).count()

    def lrange(self, key: str, start: int, stop: int) -> list[str]:
        rows = list_range(self._own("kv_list", key), "key", start, stop, ["index"], "value")
        return [r["value"] for r in rows.orderBy("index").collect()]

    @_alone
    def _pop(self, key: str, n: int, head: bool) -> list[str]:
        rows = self._own("kv_list", key).orderBy("index" if head else F.desc("index")).limit(n).collect()
        if rows:
            self._drop("kv_list", (F.col("key") == key) & F.col("index").isin(*[r["index"] for r in rows]))
        return [r["value"] for r in rows]

    def lpop(self, key: str, n: int = 1) -> list[str]:
        return self._pop(key, n, True)

    def rpop(self, key: str, n: int = 1) -> list[str]:
        return self._pop(key, n, False)

    # Sets

    @_alone
    def sadd(self, key: str, *members: str) -> int:
        before = self._own("kv_set", key).filter(F.col("member").isin(*members)).count()
        self._upsert("kv_set", [(key, m) for m in set(members)])
        return len(set(members)) - before

    def smembers(self, key: str) -> set[str]:
        return {r["member"] for r in self._own("kv_set", key).collect()}

    def sismember(self, key: str, member: str) -> bool:
        return not self._own("kv_set", key).filter(F.col("member") == member).limit(1).isEmpty()

    def srem(self, key: str, *members: str) -> int:
        return self._drop("kv_set", (F.col("key") == key) & F.col("member").isin(*members))

    # Sorted sets

    @_alone
    def zadd(self, key: str, scores: dict[str, float]) -> int:
        before = self._own("kv_zset", key).filter(F.col("member").isin(*scores)).count()
        self._upsert("kv_zset", [(key, float(s), m) for m, s in scores.items()], ["key", "member"])
        return len(scores) - before

    def zrange(self, key: str, start: int, stop: int, withscores: bool = False) -> list:
        w = Window.partitionBy("key")
        ranked = self._own("kv_zset", key).withColumns({"_at": F.row_number().over(w.orderBy("score", "member")) - 1, "_n": F.count(F.lit(1)).over(w)})
        edge = lambda x: F.lit(x) if x >= 0 else F.col("_n") + x
        rows = ranked.filter(F.col("_at").between(F.greatest(edge(start), F.lit(0)), edge(stop))).orderBy("_at").collect()
        return [(r["member"], r["score"]) if withscores else r["member"] for r in rows]

    def zrangebyscore(self, key: str, low: float, high: float) -> list[str]:
        return [r["member"] for r in self._own("kv_zset", key).filter(F.col("score").between(low, high)).orderBy("score", "member").collect()]

    def zrem(self, key: str, *members: str) -> int:
        return self._drop("kv_zset", (F.col("key") == key) & F.col("member").isin(*members))

    # Streams

    @_alone
    def xadd(self, key: str, fields: dict[str, str], id: int | None = None) -> int:
        last = self._own("kv_stream", key).agg(F.max("id")).first()[0] or 0
        new = last + 1 if id is None else id
        if new <= last:
            raise ValueError(f"the id must be above {last}")
        self._upsert("kv_stream", [(key, new, f, str(v)) for f, v in fields.items()])
        return new

    def xrange(self, key: str, start: int | str = "-", stop: int | str = "+", count: int | None = None) -> list[tuple[int, dict[str, str]]]:
        rows = self._own("kv_stream", key)
        rows = rows if start == "-" else rows.filter(F.col("id") >= int(start))
        rows = rows if stop == "+" else rows.filter(F.col("id") <= int(stop))
        grouped = rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields")).orderBy("id")
        return [(r["id"], r["fields"]) for r in (grouped if count is None else grouped.limit(count)).collect()]

    def xlen(self, key: str) -> int:
        return self._own("kv_stream", key).select("id").distinct().count()


#: Commands that change a structure, that remove from it, and that only read.
_WRITES = {"set", "expire", "hset", "hsetnx", "rpush", "lpush", "sadd", "zadd", "xadd", "load"}
_REMOVES = {"delete", "hdel", "lpop", "rpop", "srem", "zrem"}
_READS = {"get", "exists", "ttl", "keys", "hmget", "hget", "hgetall", "llen", "lrange", "smembers", "sismember", "zrange", "zrangebyscore", "xrange", "xlen", "table"}


class Guarded:
    """The commands of a user: each needs its privilege on every table."""

    def __init__(self, kv: KeyValue, check: Callable[[str], None]):
        self._kv, self._check = kv, check

    def __getattr__(self, name: str):
        privilege = "INSERT" if name in _WRITES else "DELETE" if name in _REMOVES else "SELECT" if name in _READS else None
        if privilege is None:
            raise AttributeError(name)
        self._check(privilege)
        return getattr(self._kv, name)


class Channels:
    """Publish and subscribe within the process: messages go to the subscribers' queues."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._exact: dict[str, dict[str, list]] = defaultdict(dict)
        self._patterns: dict[str, dict[str, list]] = defaultdict(dict)

    def subscribe(self, who: str, *channels: str, pattern: bool = False) -> None:
        with self._lock:
            for c in channels:
                (self._patterns if pattern else self._exact)[c].setdefault(who, [])

    def unsubscribe(self, who: str, *channels: str, pattern: bool = False) -> None:
        own = self._patterns if pattern else self._exact
        with self._lock:
            for c in channels or list(own):
                own[c].pop(who, None)
                if not own[c]:
                    del own[c]

    def publish(self, channel: str, message: str) -> int:
        """Returns how many got it."""
        from fnmatch import fnmatchcase

        with self._lock:
            queues = [q for q in self._exact.get(channel, {}).values()] + [q for p, own in self._patterns.items() if fnmatchcase(channel, p) for q in own.values()]
            for q in queues:
                q.append((channel, message))
        return len(queues)

    def messages(self, who: str) -> list[tuple[str, str]]:
        """Take a subscriber's messages."""
        out = []
        with self._lock:
            for own in (*self._exact.values(), *self._patterns.values()):
                if who in own:
                    out += own[who]
                    own[who] = []
        return out

    def channels(self) -> list[str]:
        return sorted(self._exact)

    def numsub(self, *channels: str) -> dict[str, int]:
        return {c: len(self._exact.get(c, {})) for c in channels}
