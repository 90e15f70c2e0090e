"""The engine's catalog: immutable tables by name, in versions that are swapped whole.

A table's rows are a DataFrame over written files, of which it keeps a list: rows that are added are
files of their own, a change rewrites the files that hold a row it is for.  Either makes a new ``Table``
and a new ``State`` with it.  Transactions and savepoints are copies of the state's dictionaries.
"""

from __future__ import annotations

import json
from copy import copy
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.codes import spark_type
from .storage import SETTLED, Files, Parts, due, read_parts, stored


class CatalogError(ValueError):
    """Something isn't in the catalog, is there already, or changed meanwhile."""


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # declared type, upper case
    arguments: tuple[str, ...] = ()
    unsigned: bool = False
    not_null: bool = False
    default: str | None = None  # SQL text
    auto: bool = False

    @property
    def type(self) -> DataType:
        return spark_type(self.kind, list(self.arguments) if self.kind in ("DECIMAL", "NUMERIC") else [], self.unsigned)

    @property
    def declared(self) -> str:
        given = f"({', '.join(repr(a) if self.kind in ('ENUM', 'SET') else a for a in self.arguments)})" if self.arguments else ""
        return f"{self.kind}{given}{' UNSIGNED' * self.unsigned}"


@dataclass(frozen=True)
class Index:
    name: str
    expressions: tuple[str, ...]  # SQL text
    unique: bool = False
    kind: str = "BTREE"
    where: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    rows: DataFrame | None = None
    parts: Parts = ()
    counter: int = 0
    version: int = 0

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c.name, c.type, True) for c in self.columns])

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise CatalogError(f"{self.name} has no column {name}")

    @property
    def json_columns(self) -> set[str]:
        """Columns whose names may be followed by keys: JSON is kept as text."""
        return {c.name for c in self.columns if isinstance(c.type, StringType)}


@dataclass(frozen=True)
class Materialized:
    query: str
    reads: tuple[str, ...]
    seen: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Store:
    """A key-value structure's files, and how many changes it has had."""

    parts: Parts = ()
    changes: int = 0


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    materialized: dict[str, Materialized] = field(default_factory=dict)
    triggers: dict[str, dict] = field(default_factory=dict)
    routines: dict[str, dict] = field(default_factory=dict)
    users: dict[str, dict] = field(default_factory=dict)
    databases: list[str] = field(default_factory=lambda: ["default"])
    stores: dict[str, Store] = field(default_factory=dict)
    #: Search segments by the file they are of.
    segments: dict[str, str] = field(default_factory=dict)

    def copied(self) -> State:
        out = copy(self)
        for name in ("tables", "views", "materialized", "triggers", "routines", "stores", "segments"):
            setattr(out, name, dict(getattr(self, name)))
        out.users = {k: {"password": v["password"], "grants": {t: set(p) for t, p in v["grants"].items()}} for k, v in self.users.items()}
        out.databases = list(self.databases)
        return out


class Catalog:
    """The committed state, and what an open transaction sees."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.committed = State()
        self.open: State | None = None
        self._base: dict[str, int] = {}
        self._marks: dict[str, State] = {}
        self.written: set[str] = set()

    def store(self, rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Write rows to a new place that ``vacuum`` knows of."""
        kept, path = stored(rows, name, self.root)
        self.written.add(path)
        return kept, path

    @property
    def files(self) -> Files:
        return Files(self.spark)

    def vacuum(self) -> int:
        """Delete what this catalog wrote and no state in reach reads; DataFrames made before of older
        versions can't be run after it.  Returns how many places went."""
        files = self.files
        states = [self.committed, *([self.open] if self.open is not None else []), *self._marks.values()]
        live = {files.spelled(p) for s in states for owner in (*s.tables.values(), *s.stores.values()) for p, _ in owner.parts}
        for s in states:
            s.segments = {of: at for of, at in s.segments.items() if of in live}
            live |= {files.spelled(at) for at in s.segments.values()}
        live |= {p.rpartition("/")[0] for p in live}  # a folder stays as long as one of its files does
        gone = {p for p in self.written if files.spelled(p) not in live}
        for path in gone:
            files.delete(path)
        self.written -= gone
        return len(gone)

    @property
    def state(self) -> State:
        return self.open if self.open is not None else self.committed

    def table(self, name: str) -> Table:
        if name not in self.state.tables:
            raise CatalogError(f"there is no table {name}")
        return self.state.tables[name]

    def put(self, table: Table) -> None:
        """A changed table, as the next version."""
        self.state.tables[table.name] = replace(table, version=table.version + 1)

    def put_rows(self, table: Table, rows: DataFrame, more: Parts = (), **changes: object) -> None:
        """A table with other rows, written to a new place, and ``more`` files as they are."""
        _, path = self.store(rows.select(*[rows[c.name].cast(c.type).alias(c.name) for c in table.columns]), table.name)
        self._put_parts(table, ((path, SETTLED), *more), **changes)

    def _put_parts(self, table: Table, parts: Parts, **changes: object) -> None:
        while own := due(parts):
            level = dict(parts)[own[0]]
            merged, path = self.store(read_parts(self.spark, tuple((p, 0) for p in own), table.schema).coalesce(max(1, sum(map(self.files.size, own)) >> 27)), table.name)
            parts = (*[x for x in parts if x[0] not in own], (path, level + 1))
        self.put(replace(table, rows=read_parts(self.spark, parts, table.schema), parts=parts, **changes))

    def add_rows(self, table: Table, path: str, **changes: object) -> None:
        """A table with the rows of a written folder too: what it has is not written again."""
        self._put_parts(table, (*table.parts, (path, 0)), **changes)

    def with_files(self, table: Table) -> DataFrame:
        """A table's rows with the file that each is in."""
        if "_file" in table.rows.columns:
            return table.rows
        return table.rows.withColumn("_file", F.col("_metadata.file_path") if table.parts else F.lit(None).cast("string"))

    def put_files(self, table: Table, touched: list[str], rows: DataFrame, more: Parts = (), **changes: object) -> None:
        """A table of which the ``touched`` files (as ``with_files`` calls them) are replaced by ``rows``."""
        files = self.files
        gone = {files.of_uri(f) for f in touched}
        folders = {f.rpartition("/")[0] for f in gone} | gone
        kept: list[tuple[str, int]] = []
        for path, level in table.parts:
            if files.spelled(path) in folders:
                kept += [(f, level) for f in files.inside(path) if f not in gone]
            else:
                kept.append((path, level))
        # Single files are as settled as what a change wrote: their folder's level is no longer theirs alone.
        kept = [(p, SETTLED if p.endswith(".parquet") else level) for p, level in kept]
        self.put_rows(table, rows, (*kept, *more), **changes)

    # Transactions: what is open is a copy; a commit fails if one of its changed tables changed meanwhile.

    def begin(self) -> None:
        if self.open is not None:
            raise CatalogError("a transaction is open")
        self.open = self.committed.copied()
        self._base = {n: t.version for n, t in self.committed.tables.items()}
        self._marks = {}

    def commit(self) -> None:
        if self.open is None:
            return
        for name in {*self.open.tables, *self._base}:
            now, base = self.committed.tables.get(name), self._base.get(name)
            ours = self.open.tables.get(name)
            changed = (ours.version if ours else None) != base
            if changed and (now.version if now else None) != base:
                self.rollback()
                raise CatalogError(f"{name} was changed by another transaction")
        for name, table in self.committed.tables.items():
            if self._base.get(name) != table.version and name in self.open.tables and self.open.tables[name].version == self._base.get(name):
                self.open.tables[name] = table
        self.committed, self.open = self.open, None

    def rollback(self, mark: str | None = None) -> None:
        if mark is None:
            self.open, self._marks = None, {}
        else:
            if self.open is None or mark not in self._marks:
                raise CatalogError(f"there is no savepoint {mark}")
            self.open = self._marks[mark].copied()

    def savepoint(self, mark: str) -> None:
        if self.open is None:
            raise CatalogError("no transaction is open")
        self._marks[mark] = self.open.copied()

    def release(self, mark: str) -> None:
        if self._marks.pop(mark, None) is None:
            raise CatalogError(f"there is no savepoint {mark}")

    # Persistence: a JSON document names the files; files are never changed.

    def snapshot(self) -> str:
        """The committed state as JSON."""
        s = self.committed
        tables = [{**{k: v for k, v in asdict(replace(t, rows=None)).items() if k != "rows"}} for t in s.tables.values()]
        stores = {k: asdict(x) for k, x in s.stores.items()}
        users = {k: {"password": v["password"], "grants": {t: sorted(p) for t, p in v["grants"].items()}} for k, v in s.users.items()}
        body = {"tables": tables, "views": s.views, "materialized": {k: asdict(v) for k, v in s.materialized.items()}, "triggers": s.triggers, "routines": s.routines, "users": users, "databases": s.databases, "stores": stores}
        return json.dumps(body)

    def load(self, text: str) -> None:
        """Take a snapshot's state."""
        body = json.loads(text)
        state = State(views=body["views"], triggers=body["triggers"], routines=body["routines"], databases=body["databases"])
        for t in body["tables"]:
            table = Table(
                t["name"],
                tuple(Column(**{**c, "arguments": tuple(c["arguments"])}) for c in t["columns"]),
                tuple(t["primary_key"]),
                tuple(ForeignKey(f["name"], tuple(f["columns"]), f["parent"], tuple(f["parent_columns"])) for f in t["foreign_keys"]),
                tuple(Index(**{**i, "expressions": tuple(i["expressions"])}) for i in t["indexes"]),
                None,
                tuple((p, level) for p, level in t["parts"]),
                t["counter"],
                t["version"],
            )
            state.tables[table.name] = replace(table, rows=read_parts(self.spark, table.parts, table.schema))
        for k, m in body["materialized"].items():
            state.materialized[k] = Materialized(m["query"], tuple(m["reads"]), tuple(tuple(x) for x in m["seen"]))
        state.users = {k: {"password": v["password"], "grants": {t: set(p) for t, p in v["grants"].items()}} for k, v in body["users"].items()}
        state.stores = {k: Store(tuple((p, level) for p, level in x["parts"]), x["changes"]) for k, x in body["stores"].items()}
        self.committed, self.open = state, None
