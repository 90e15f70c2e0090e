"""The engine: statements of the dialect or of the JSON form, against a catalog, on one Spark session."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.util import PythonEvalType

from .operators import ddl, dml, rbac
from .operators.kv import SCHEMAS as KV_SCHEMAS
from .operators.kv import Channels, Guarded, KeyValue
from .operators.search import SearchIndex, search, table_index
from .plans import expr as ir_expr
from .plans.bands import binned
from .plans.dialect import AGGREGATES, Scope, rewrite
from .plans.ir import Planner
from .plans.lexer import SqlError, Token, closing, literal, render, split_at, statements, string_value, tokens
from .sources import infoschema
from .sources.catalog import Catalog, CatalogError, Column, ForeignKey, Index, Materialized, Table
from .sources.storage import read_parts, shared_dir

# System variables that clients ask for.
SYSTEM_VARIABLES = {
    "version": "8.0.30", "version_comment": "analytics engine", "autocommit": 1, "sql_mode": "", "time_zone": "UTC", "system_time_zone": "UTC", "character_set_client": "utf8mb4", "character_set_connection": "utf8mb4",
    "character_set_results": "utf8mb4", "character_set_server": "utf8mb4", "collation_connection": "utf8mb4_general_ci", "collation_server": "utf8mb4_general_ci", "auto_increment_increment": 1, "net_write_timeout": 60, "net_read_timeout": 30, "max_allowed_packet": 67108864, "tx_isolation": "REPEATABLE-READ", "transaction_isolation": "REPEATABLE-READ", "wait_timeout": 28800, "interactive_timeout": 28800, "lower_case_table_names": 0,
}


@dataclass
class CommandResult:
    """What a statement that isn't a query did."""

    affected: int = 0
    message: str = ""


@dataclass
class Prepared:
    text: str
    count: int


@dataclass
class Metrics:
    started: float = field(default_factory=time.time)
    counts: dict[str, int] = field(default_factory=dict)

    def add(self, name: str) -> None:
        self.counts[name] = self.counts.get(name, 0) + 1

    def rows(self) -> dict[str, object]:
        return {"Uptime": int(time.time() - self.started), "Questions": sum(v for k, v in self.counts.items() if k.startswith("Com_")), **dict(sorted(self.counts.items()))}


class Engine:
    """``compat`` turns on the dialect's own arithmetic: SUM of nothing is 0, CONCAT writes NULL as
    text, integers divide to integers.  ``root``: where tables are written; by default the folder
    in spark.checkpoint.dir.  ``user``: whose privileges are checked (none: the owner)."""

    def __init__(self, spark: SparkSession, compat: bool = False, root: str | None = None, user: str | None = None):
        self.spark, self.compat, self.user = spark, compat, user
        self.catalog = Catalog(spark, root)
        self._kv = KeyValue(self.catalog)
        self.channels = Channels()
        self.variables: dict[str, object] = {}
        self.prepared: dict[str, Prepared] = {}
        self.metrics = Metrics()
        self.sources: dict[str, DataFrame] = {}
        self.database = "default"
        # Names under which tables are planned are this engine's own, whatever else the session has.
        self._prefix = f"q{uuid.uuid4().hex[:12]}_"

    @property
    def kv(self) -> KeyValue | Guarded:
        """The key-value commands; a user's are checked."""
        return self._kv if self.user is None else Guarded(self._kv, lambda privilege: rbac.check(self.catalog.state, self.user, privilege, []))

    # Sources ------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        """A table that the engine reads but doesn't own."""
        self.sources[name] = df

    def register_function(self, name: str, function: object) -> None:
        """A scalar, aggregate or table function of PySpark's own kinds, for queries by its name."""
        (self.spark.udtf if isinstance(function, UserDefinedTableFunction) else self.spark.udf).register(name, function)
        if getattr(function, "evalType", None) in (PythonEvalType.SQL_GROUPED_AGG_PANDAS_UDF, PythonEvalType.SQL_GROUPED_AGG_ARROW_UDF):
            AGGREGATES.add(name.upper())

    def register_folder(self, path: str, names: list[str]) -> Engine:
        """Parquet files ``path/name.parquet`` as tables."""
        for n in names:
            self.register(n, self.spark.read.parquet(f"{path}/{n}.parquet"))
        return self

    def table(self, name: str) -> DataFrame:
        """A table, view or materialized view by name."""
        return self._named(name)[0]

    def _named(self, name: str) -> tuple[DataFrame, set[str]]:
        state = self.catalog.state
        plain = name.split(".", 1)[1] if name.startswith("information_schema.") else None
        if plain in infoschema.SCHEMAS:
            return infoschema.view(plain, self.catalog, self.metrics.rows()), set()
        if plain in KV_SCHEMAS:
            return self._kv.table(plain), set()
        if name in state.materialized:
            self._refresh(name)
        if name in state.tables:
            return state.tables[name].rows, state.tables[name].json_columns
        if name in state.views:
            df = self._view(state.views[name])
            return df, _texts(df)
        if name in self.sources:
            return self.sources[name], _texts(self.sources[name])
        raise CatalogError(f"there is no table {name}")

    def _view(self, body: str) -> DataFrame:
        """A view's rows: its text is a query, or a query of the JSON form with its columns."""
        if not body.startswith("{"):
            return self._query(body)
        held = json.loads(body)
        df = self.planner().select(held["query"])
        return df.toDF(*held["columns"]) if held.get("columns") else df

    def _reads_of(self, body: str) -> list[str]:
        """The tables that a view's body names."""
        if not body.startswith("{"):
            return self._reads(tokens(body))
        known = {*self.catalog.state.tables, *self.catalog.state.views, *self.catalog.state.materialized, *self.sources}
        return [n for n in _tables_in(json.loads(body)) if n in known]

    def _reads(self, parts: list[Token]) -> list[str]:
        """Names after FROM and JOIN, and after commas there, that aren't the query's own."""
        own = {parts[i].name for i in range(len(parts) - 2) if parts[i + 1].up == "AS" and parts[i + 2].text == "("} | {parts[i].name for i in range(len(parts) - 1) if parts[i].kind in ("word", "quoted") and i and parts[i - 1].up in ("WITH", "RECURSIVE", ",") and parts[i + 1].text == "("}
        out = []
        state = self.catalog.state
        known = {*state.tables, *state.views, *state.materialized, *self.sources}
        clause = [""]  # of every open bracket: whether names there are tables
        for i, t in enumerate(parts):
            before = parts[i - 1] if i else None
            if t.text == "(":
                clause.append("from" if clause[-1] == "from" and before.up in ("FROM", "JOIN", ",", "(") else "")
            elif t.text == ")":
                clause = clause[:-1] or [""]
            elif t.up in ("FROM", "JOIN") or t.text == "," and clause[-1] == "on":
                clause[-1] = "from"
            elif t.up in ("ON", "USING"):
                clause[-1] = "on"
            elif t.up in ("SELECT", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "WINDOW", "UNION", "INTERSECT", "EXCEPT"):
                clause[-1] = ""
            elif t.up == "INFORMATION_SCHEMA" and i + 2 < len(parts):
                out.append(f"information_schema.{parts[i + 2].name.lower()}")
            elif t.kind in ("word", "quoted") and clause[-1] == "from" and before.up in ("FROM", "JOIN", ",", "(") and t.name in known and t.name not in own and t.name not in out:
                out.append(t.name)
        return list(dict.fromkeys(out))

    def _query(self, text: str, params: list | dict | None = None) -> DataFrame:
        """A SELECT, WITH or set operation.  Its tables are common table expressions of their own names
        around it, so neither they nor other engines' tables meet in the session."""
        parts = tokens(text)
        json_columns: set[str] = set()
        named, views, kinds = [], [], {}
        for name in self._reads(parts):
            df, own = self._named(name)
            kinds[name] = dict(df.dtypes)
            json_columns |= own
            plain = name.replace("information_schema.", "information_schema__")
            views.append(f"{self._prefix}{len(self._prefix)}_{len(views)}_{uuid.uuid4().hex[:8]}")
            df.createOrReplaceTempView(views[-1])
            named.append(f"`{plain}` AS (SELECT * FROM `{views[-1]}`)")
        if any(t.up == "DUAL" and i and parts[i - 1].up in ("FROM", ",", "JOIN") for i, t in enumerate(parts)):
            named.append("`dual` AS (SELECT 'X' AS dummy)")
        json_columns -= _aliases(parts)
        band = binned(parts, lambda name, column: kinds.get(name, {}).get(column))
        sql = rewrite(band[0] if band else text, Scope(json_columns, self._variable, self.compat))
        if band:  # small tables give many pairs: shuffled, not broadcast to the few tasks that read the other side
            sql = re.sub(r"^SELECT\b", f"SELECT /*+ MERGE(`{band[1]}`) */", sql)
        try:
            return self._planned(_within(sql, named), parts, params)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)

    def _planned(self, sql: str, parts: list[Token], params: list | dict | None) -> DataFrame:
        if isinstance(params, list | tuple) and params:
            if any(t.kind == "param" and t.text[0] == "$" for t in parts):
                return self.spark.sql(sql, args={f"p{i}": v for i, v in enumerate(params, 1)})
            need = sum(t.kind == "param" for t in parts)
            if need > len(params):
                raise SqlError(f"{need} parameters are needed, {len(params)} given")
            return self.spark.sql(sql, args=list(params))
        return self.spark.sql(sql)

    def _variable(self, name: str) -> object:
        if name.startswith("@@"):
            return SYSTEM_VARIABLES.get(re.sub(r"^(global|session)\.", "", name[2:].lower()))
        return self.variables.get(name[1:].lower())

    # Entry points -------------------------------------------------------------------------

    def sql(self, text: str, params: list | None = None) -> DataFrame | CommandResult:
        """One statement.  Queries give a DataFrame that runs when it is asked for rows."""
        parts = tokens(text)
        while parts and parts[-1].text == ";":
            parts.pop()
        if not parts:
            raise SqlError("an empty statement")
        head = next((t.up for t in parts if t.text != "("), "")
        self.metrics.add(f"Com_{head.lower()}")
        handler = _STATEMENTS.get(head)
        if handler is None:
            raise SqlError(f"statements can't begin with {head}")
        try:
            return handler(self, parts, text.strip().rstrip(";"), params or [])
        except Exception:
            self.metrics.add("Errors")
            raise

    def respond(self, text: str, params: list | None = None) -> dict:
        """A statement's outcome as the query interface sends it: columns and rows, or the error."""
        out = {"success": True, "columns": [], "data": [], "rows_affected": 0, "error": None}
        try:
            result = self.sql(text, params)
            if isinstance(result, DataFrame):
                out |= {"columns": result.columns, "data": [list(r) for r in result.collect()]}
            else:
                out["rows_affected"] = result.affected
        except Exception as e:
            out |= {"success": False, "error": str(e)}
        return out

    def execute_batch(self, script: str) -> list[DataFrame | CommandResult]:
        """All statements of a script, in order."""
        return [self.sql(s) for s in statements(script)]

    def ir(self, node: dict | str, params: list | None = None) -> DataFrame | CommandResult | object:
        """One statement of the JSON form."""
        kind, body = ir_expr.node(node)
        self.metrics.add(f"Com_{kind.lower()}")
        handler = _IR.get(kind)
        if handler is None:
            raise SqlError(f"the statement {kind} isn't known")
        return handler(self, body, params or [])

    def planner(self, params: list | None = None) -> Planner:
        return Planner(self.spark, self._named, self._variable, params, self.compat)

    def search(self, table: str, query: str) -> DataFrame:
        """The best rows of a full-text query, with ``_score``: of a table of the catalog by its kept index."""
        rbac.check(self.catalog.state, self.user, "SELECT", [table])
        rows, state = self.table(table), self.catalog.state
        if table not in state.tables or not state.tables[table].parts:
            return search(rows, query)
        return self._index(state.tables[table]).search(query)

    def _index(self, table: Table) -> SearchIndex:
        """A table's search index, brought up to date with its files."""

        def place(path: str) -> str:
            out = f"{self.catalog.root or shared_dir(self.spark)}/segments/{uuid.uuid4().hex}"
            self.catalog.written.add(out)
            return out

        files = [(self.catalog.files.spelled(p), read_parts(self.spark, ((p, 0),), table.schema)) for p, _ in table.parts]
        return table_index(self.spark, files, self.catalog.state.segments, place)

    def as_user(self, name: str, password: str) -> Engine:
        """The same engine with another user's privileges."""
        user = self.catalog.state.users.get(name)
        if user is None or not rbac.verified(user["password"], password):
            raise rbac.Denied(f"{name} can't log in")
        out = object.__new__(Engine)
        out.__dict__ = {**self.__dict__, "user": name, "variables": {}}
        return out

    def vacuum(self) -> int:
        """Delete files of versions that can no longer be read."""
        return self.catalog.vacuum()

    # Dump, restore, snapshots ----------------------------------------------------------------

    def dump(self) -> str:
        """A script that makes the tables again.  Rows pass through the driver as the script does."""
        out = []
        for t in _parents_first(self.catalog.state.tables):
            out.append(f"{create_statement(t)};")
            for row in t.rows.toLocalIterator():
                out.append(f"INSERT INTO `{t.name}` VALUES ({', '.join(_dumped(v) for v in row)});")
        return "\n".join(out) + "\n"

    def dump_to(self, path: str) -> None:
        """The same as text files, rows written where they are: for tables of any size."""
        quoted = lambda c: F.concat(F.lit("'"), _replaced(F.col(f"`{c}`").cast("string"), _ESCAPES), F.lit("'"))
        for i, t in enumerate(_parents_first(self.catalog.state.tables)):
            place = f"{path}/{i:04d}-{t.name}"
            self.spark.createDataFrame([(f"{create_statement(t)};",)], "value string").coalesce(1).write.mode("append").text(f"{place}/0-table")
            values = F.concat_ws(", ", *[F.coalesce(quoted(c.name), F.lit("NULL")) for c in t.columns])
            t.rows.select(F.concat(F.lit(f"INSERT INTO `{t.name}` VALUES ("), values, F.lit(");")).alias("value")).write.mode("append").text(f"{place}/1-rows")

    def restore(self, script: str) -> None:
        """Run a dump; statements that add rows to one table, one after the other, are one statement."""
        head, rows = "", []

        def flush() -> None:
            if rows:
                self.sql(f"{head} {', '.join(rows)}")
                rows.clear()

        for statement in statements(script):
            m = _ROW.fullmatch(statement)
            if not m or m[1] != head or len(rows) >= 1000:
                flush()
            if m:
                head = m[1]
                rows.append(m[2])
            else:
                self.sql(statement)
        flush()

    def restore_from(self, path: str) -> None:
        """Take what ``dump_to`` wrote: rows are read and taken apart where they are, a table at a time."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for place in sorted(f.getPath().toString() for f in fs.listStatus(fs_path) if f.isDirectory()):
            self.execute_batch("\n".join(r["value"] for r in self.spark.read.text(f"{place}/0-table", wholetext=True).collect()))
            table = self.catalog.table(place.rpartition("/")[2].partition("-")[2])
            values = F.regexp_extract_all(F.regexp_extract("value", r"VALUES \((.*)\);$", 1), F.lit(r"('(?:[^'\\]|\\.)*'|NULL)"), F.lit(1))
            plain = lambda x: F.when(x != "NULL", _replaced(F.substring(x, F.lit(2), F.length(x) - 2), _UNESCAPES))
            cells = self.spark.read.text(f"{place}/1-rows").select(F.transform(values, plain).alias("v"))
            rows = cells.select(*[F.get("v", F.lit(k)).alias(c.name) for k, c in enumerate(table.columns)])
            dml.insert(self.catalog, table, rows)

    def save(self, path: str) -> None:
        """The committed catalog as one JSON file; the tables' files stay where they are."""
        self.spark.createDataFrame([(self.catalog.snapshot(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def load(self, path: str) -> Engine:
        self.catalog.load(self.spark.read.text(path).first()["value"])
        return self

    # Materialized views: computed again on the next read after one of their tables changed.

    def _marks(self, reads: tuple[str, ...]) -> tuple[tuple[str, int], ...]:
        out = []
        for n in reads:
            if n in self.catalog.state.views:
                out += self._marks(tuple(self._reads_of(self.catalog.state.views[n])))
            elif n in self.catalog.state.tables:
                if n in self.catalog.state.materialized:
                    self._refresh(n)
                out.append((n, self.catalog.state.tables[n].version))
        return tuple(out)

    def _refresh(self, name: str) -> None:
        m = self.catalog.state.materialized[name]
        marks = self._marks(m.reads)
        if marks != m.seen:
            t = self.catalog.table(name)
            self.catalog.put_rows(t, self._view(m.query).toDF(*[c.name for c in t.columns]))
            self.catalog.state.materialized[name] = Materialized(m.query, m.reads, marks)
            self.metrics.add("Refreshes")

    # Statements ------------------------------------------------------------------------------

    def _select(self, parts: list[Token], text: str, params: list) -> DataFrame:
        rbac.check(self.catalog.state, self.user, "SELECT", self._reads(parts))
        return self._query(text, params)

    def _value(self, parts: list[Token], params: list | None = None) -> object:
        """An expression's value."""
        return self._query(f"SELECT {render(parts)}", params).first()[0]

    def _target(self, name: str) -> Table:
        """The table that a name is for: a simple view stands for its table."""
        view = self.catalog.state.views.get(name)
        if view is None:
            return self.catalog.table(name)
        if view.startswith("{"):
            raise SqlError(f"{name} is a view that can't be written to")
        parts = tokens(view)
        if any(t.up in ("JOIN", "GROUP", "DISTINCT", "UNION", "INTERSECT", "EXCEPT", "LIMIT", "HAVING", "WITH") for t in parts) or len(self._reads(parts)) != 1:
            raise SqlError(f"{name} is a view that can't be written to")
        return self._target(self._reads(parts)[0])

    def _expr(self, parts: list[Token], table: Table):
        """SQL tokens as a Column over a table's rows, parameters already in place."""
        text = rewrite(render(parts), Scope(table.json_columns, self._variable, self.compat))
        return F.expr(re.sub(rf"`{re.escape(table.name)}`\.", "", text))

    def _needs_subquery(self, parts: list[Token]) -> bool:
        return any(t.up == "SELECT" for t in parts)

    def _bound(self, parts: list[Token], params: list) -> list[Token]:
        """Placeholders replaced by literals, for statements that aren't queries."""
        left, out = list(params), []
        for t in parts:
            if t.kind == "param":
                if t.text == "?":
                    if not left:
                        raise SqlError("a parameter is missing")
                    out.append(Token("sql", literal(left.pop(0))))
                else:
                    out.append(Token("sql", literal(params[int(t.text[1:]) - 1])))
            else:
                out.append(t)
        return tokens(render(out)) if out != parts else parts

    def _insert(self, parts: list[Token], text: str, params: list) -> CommandResult:
        parts = self._bound(parts, params)
        mode, i = ("replace", 1) if parts[0].up == "REPLACE" else ("plain", 1)
        if parts[i].up == "IGNORE":
            mode, i = "ignore", i + 1
        i += parts[i].up == "INTO"
        if parts[i].up == "IGNORE":
            mode, i = "ignore", i + 1
        table = self._target(parts[i].name)
        rbac.check(self.catalog.state, self.user, "INSERT", [table.name])
        i += 1
        given = [c.name for c in table.columns]
        if i < len(parts) and parts[i].text == "(" and parts[i + 1].up not in ("SELECT", "WITH"):
            given, i = ddl.names_in(parts, i)
        for c in given:
            table.column(c)
        update: dict[str, str] | None = None
        depth = 0
        for k in range(i, len(parts)):
            depth += (parts[k].text == "(") - (parts[k].text == ")")
            if not depth and [t.up for t in parts[k : k + 4]] == ["ON", "DUPLICATE", "KEY", "UPDATE"]:
                update = self._assignments(parts[k + 4 :])
                parts = parts[:k]
                break
        if parts[i].up in ("VALUES", "VALUE"):
            defaults = {c.name: c.default for c in table.columns}
            rows, k = [], i + 1
            while k < len(parts):
                end = closing(parts, k)
                values = split_at(parts[k + 1 : end])
                if len(values) != len(given):
                    raise SqlError(f"{len(given)} values are needed, {len(values)} given")
                row = []
                for name, value in zip(given, values, strict=True):
                    value = tokens(defaults[name] or "NULL") if len(value) == 1 and value[0].up == "DEFAULT" else value
                    row.append(f"cast({rewrite(render(value), Scope(set(), self._variable, self.compat))} as {table.column(name).type.simpleString()})")
                rows.append(f"SELECT {', '.join(f'{v} AS `{n}`' for v, n in zip(row, given, strict=True))}")
                k = end + 1
                if k < len(parts) and parts[k].text == ",":
                    k += 1
            df = self.spark.sql(" UNION ALL ".join(rows)).coalesce(1)  # a statement's values, in its order
        else:
            query = parts[i + 1 : closing(parts, i)] if parts[i].text == "(" else parts[i:]
            df = self._query(render(query))
            if len(df.columns) != len(given):
                raise SqlError(f"{len(given)} columns are needed, {len(df.columns)} given")
            df = df.toDF(*[f"_{n}" for n in given])
        return CommandResult(dml.insert(self.catalog, table, df, given, mode, update))

    def _assignments(self, parts: list[Token]) -> dict[str, str]:
        """``c = VALUES(c), d = d + 1`` as SQL over the old row and ``new``."""
        out = {}
        for a in split_at(parts):
            name = a[0].name if len(a) < 3 or a[1].text != "." else a[2].name
            at = next(k for k, t in enumerate(a) if t.text == "=")
            body, k = [], at + 1
            while k < len(a):
                if a[k].up == "VALUES" and k + 3 < len(a) + 1 and a[k + 1].text == "(":
                    body.append(Token("sql", f"new.`{a[k + 2].name}`"))
                    k += 4
                else:
                    body.append(a[k])
                    k += 1
            out[name] = rewrite(render(body), Scope(set(), self._variable, self.compat))
        return out

    def _update(self, parts: list[Token], text: str, params: list) -> CommandResult:
        parts = self._bound(parts, params)
        table = self._target(parts[1].name)
        rbac.check(self.catalog.state, self.user, "UPDATE", [table.name])
        at = next(k for k, t in enumerate(parts) if t.up == "SET")
        table, where, stop = self._where(parts, at, table)
        changes = {}
        for a in split_at(parts[at + 1 : stop]):
            name = a[0].name if a[1].text != "." else a[2].name
            eq = next(k for k, t in enumerate(a) if t.text == "=")
            table.column(name)
            changes[name] = self._expr(self._inlined(a[eq + 1 :]), table)
        return CommandResult(dml.update(self.catalog, table, changes, where))

    def _where(self, parts: list[Token], start: int, table: Table):
        depth, stop = 0, len(parts)
        for k in range(start, len(parts)):
            depth += (parts[k].text == "(") - (parts[k].text == ")")
            if not depth and parts[k].up == "WHERE":
                stop = k
                break
        if stop == len(parts):
            return table, None, stop
        own = parts[stop + 1 :]
        if self._needs_subquery(own):
            # The condition's subqueries need a plan: rows that it holds for are found by a number.
            rows, _ = self.catalog.store(self.catalog.with_files(table).withColumn("_row", F.monotonically_increasing_id()), table.name)
            hit = self._with_rows(table.name, rows)._query(f"SELECT _row AS _hit_row FROM `{table.name}` WHERE {render(own)}")
            flagged = rows.join(hit, rows["_row"] == hit["_hit_row"], "left").withColumn("_where", F.col("_hit_row").isNotNull()).drop("_row", "_hit_row")
            kept, _ = self.catalog.store(flagged, table.name)
            return replace(table, rows=kept), F.col("_where"), stop
        return table, self._expr(own, table), stop

    def _with_rows(self, name: str, rows: DataFrame) -> Engine:
        """This engine with other rows under a table's name, for one plan."""
        out = object.__new__(Engine)
        out.__dict__ = dict(self.__dict__)
        out._named = lambda n: (rows, _texts(rows)) if n == name else self._named(n)
        return out

    def _inlined(self, parts: list[Token]) -> list[Token]:
        """Scalar subqueries without outside names, replaced by their value."""
        out, i = [], 0
        while i < len(parts):
            if parts[i].text == "(" and i + 1 < len(parts) and parts[i + 1].up == "SELECT":
                end = closing(parts, i)
                out += tokens(literal(self._query(render(parts[i + 1 : end])).first()[0]))
                i = end + 1
            else:
                out.append(parts[i])
                i += 1
        return out

    def _delete(self, parts: list[Token], text: str, params: list) -> CommandResult:
        parts = self._bound(parts, params)
        table = self._target(parts[2].name)
        rbac.check(self.catalog.state, self.user, "DELETE", [table.name])
        table, where, _ = self._where(parts, 2, table)
        return CommandResult(dml.delete(self.catalog, table, where))

    def _create(self, parts: list[Token], text: str, params: list) -> CommandResult:
        words = [t.up for t in parts]
        i = 1
        unique = words[1] == "UNIQUE"
        replace_ = words[1:3] == ["OR", "REPLACE"]
        i += unique + 2 * replace_
        kind = words[i]
        if kind == "MATERIALIZED":
            kind, i = "MATERIALIZED VIEW", i + 1
        i += 1
        missing_ok = words[i : i + 3] == ["IF", "NOT", "EXISTS"]
        i += 3 * missing_ok
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        state = self.catalog.state
        name = parts[i].name if i < len(parts) else ""
        if kind == "TABLE":
            if parts[i + 1].up == "AS":
                self._create_as(name, render(parts[i + 2 :]))
            else:
                ddl.create_table(self.catalog, ddl.parse_table(name, parts[i + 2 : closing(parts, i + 1)]), missing_ok)
        elif kind == "INDEX":
            on = words.index("ON", i)
            table, j, method = parts[on + 1].name, on + 2, "BTREE"
            if words[j] == "USING":
                method, j = words[j + 1], j + 2
            end = closing(parts, j)
            expressions = tuple(rewrite(render(e), Scope(self.catalog.table(table).json_columns)) if len(e) > 1 else f"`{e[0].name}`" for e in split_at(parts[j + 1 : end]))
            j = end + 1
            if words[j : j + 1] == ["USING"]:
                method, j = words[j + 1], j + 2
            where = rewrite(render(parts[j + 1 :])) if words[j : j + 1] == ["WHERE"] else None
            ddl.create_index(self.catalog, table, Index(name, expressions, unique, method, where))
        elif kind == "VIEW":
            self._create_view(name, parts, i + 1, replace_ or missing_ok)
        elif kind == "MATERIALIZED VIEW":
            query = render(parts[words.index("AS", i) + 1 :])
            self._create_as(name, query)
            reads = tuple(self._reads(tokens(query)))
            state.materialized[name] = Materialized(query, reads, self._marks(reads))
        elif kind in ("DATABASE", "SCHEMA"):
            if name in state.databases and not missing_ok:
                raise CatalogError(f"the database {name} exists")
            state.databases = sorted({*state.databases, name})
        elif kind == "USER":
            name = string_value(parts[i]) if parts[i].kind == "string" else name
            password = next((string_value(t) for t in parts[i + 1 :] if t.kind == "string" and parts[parts.index(t) - 1].up in ("BY", "PASSWORD")), "")
            rbac.create_user(state, name, password, missing_ok)
        elif kind == "TRIGGER":
            if name in state.triggers:
                raise CatalogError(f"the trigger {name} exists")
            on = words.index("ON", i)
            state.triggers[name] = {"timing": words[i + 1], "event": words[i + 2], "table": parts[on + 1].name, "body": render(parts[on + 2 :])}
        elif kind in ("PROCEDURE", "FUNCTION"):
            self._create_routine(kind, name, parts, i, text, replace_)
        else:
            raise SqlError(f"CREATE {kind} isn't known")
        return CommandResult(message=f"created {name}")

    def _create_as(self, name: str, query: str) -> None:
        self._create_from(name, self._query(query))

    def _create_from(self, name: str, df: DataFrame) -> None:
        kinds = {"int": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "binary": "BLOB"}
        columns = []
        for n, t in df.dtypes:
            decimal = re.fullmatch(r"decimal\((\d+),(\d+)\)", t)
            columns.append(Column(n, "DECIMAL" if decimal else kinds.get(t, "TEXT"), decimal.groups() if decimal else ()))
        if name in self.catalog.state.tables:
            raise CatalogError(f"{name} exists")
        self.catalog.put_rows(Table(name, tuple(columns)), df)


    def _create_view(self, name: str, parts: list[Token], i: int, replaces: bool) -> None:
        state = self.catalog.state
        if (name in state.views or name in state.tables) and not replaces:
            raise CatalogError(f"{name} exists")
        columns: list[str] = []
        if parts[i].text == "(":
            columns, i = ddl.names_in(parts, i)
        body = parts[i + 1 :]
        if [t.up for t in body[-3:]] == ["WITH", "CHECK", "OPTION"]:
            body = body[:-3]
        query = render(body)
        found = self._query(query).columns  # an impossible view is an error now
        if columns:
            if len(columns) != len(found):
                raise SqlError("a view's names must be as many as its columns")
            query = f"SELECT * FROM ({query}) AS _v({', '.join(f'`{c}`' for c in columns)})"
        state.views[name] = query

    def _create_routine(self, kind: str, name: str, parts: list[Token], i: int, text: str, replaces: bool) -> None:
        state = self.catalog.state
        if name in state.routines and not replaces:
            raise CatalogError(f"{name} exists")
        end = closing(parts, i + 1)
        params = []
        for p in split_at(parts[i + 2 : end]):
            mode = p[0].up if p[0].up in ("IN", "OUT", "INOUT") else "IN"
            own = p[1:] if p[0].up in ("IN", "OUT", "INOUT") else p
            params.append({"mode": mode, "name": own[0].name, "type": ddl.parse_column(own)[0].type.simpleString()})
        rest = parts[end + 1 :]
        if kind == "FUNCTION":
            stop = next(k for k, t in enumerate(rest) if k > 0 and t.up in ("RETURN", "AS", "BEGIN"))
            returns = ddl.parse_column([Token("word", "r"), *[t for t in rest[1:stop] if t.up != "DETERMINISTIC"]])[0].type.simpleString()
            body = [t for t in rest[stop:] if t.up not in ("AS", "BEGIN")]
            body = body[1:] if body and body[0].up == "RETURN" else body
            body = body[:-1] if body and body[-1].up == "END" else body
            body = body[:-1] if body and body[-1].text == ";" else body
            value = rewrite(render(body))
            value = f"({value})" if body and body[0].up == "SELECT" else value
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({', '.join(f'`{p['name']}` {p['type']}' for p in params)}) RETURNS {returns} RETURN {value}")
            state.routines[name] = {"kind": kind, "params": params, "returns": returns, "body": render(body)}
        else:
            body = rest[1:] if rest and rest[0].up == "AS" else rest
            state.routines[name] = {"kind": kind, "params": params, "returns": None, "body": render(body)}

    def _call(self, parts: list[Token], text: str, params: list) -> DataFrame | CommandResult:
        """A procedure's body, with its parameters as values: through the engine if it is statements of
        the engine, through Spark's SQL scripting if it has control flow."""
        parts = self._bound(parts, params)
        routine = self.catalog.state.routines.get(parts[1].name)
        if routine is None:
            raise CatalogError(f"there is no procedure {parts[1].name}")
        args = split_at(parts[3 : closing(parts, 2)]) if len(parts) > 2 else []
        if len(args) != len(routine["params"]):
            raise SqlError(f"{len(routine['params'])} arguments are needed, {len(args)} given")
        values = {p["name"]: self._value(a) for p, a in zip(routine["params"], args, strict=True) if p["mode"] != "OUT"}
        if routine["body"].startswith("{"):
            return self._run_routine(routine, list(values.values()))
        if routine["kind"] == "FUNCTION":
            return self._query(f"SELECT {parts[1].name}({', '.join(literal(v) for v in values.values())}) AS `{parts[1].name}`")
        body = tokens(routine["body"])
        flow = any(t.up in ("WHILE", "REPEAT", "LOOP", "DECLARE", "IF") and not (t.up == "IF" and k + 1 < len(body) and body[k + 1].text == "(") for k, t in enumerate(body))
        if flow:
            return self._script(routine, body, values, args)
        filled = [Token("sql", literal(values[t.name])) if t.kind == "word" and t.name in values and (not k or body[k - 1].text != ".") and not (k and body[k - 1].up == "SET") else t for k, t in enumerate(body)]
        if filled and filled[0].up == "BEGIN":
            filled = filled[1:-1]
        out: DataFrame | CommandResult = CommandResult()
        outs = {p["name"]: a[0].text[1:].lower() for p, a in zip(routine["params"], args, strict=True) if p["mode"] != "IN" and a and a[0].kind == "variable"}
        for s in split_at(filled, ";"):
            if not s:
                continue
            if s[0].up == "SET" and s[1].name in outs:
                self.variables[outs[s[1].name]] = self._value(s[3:])
            else:
                out = self.sql(render(s))
        return out

    def _script(self, routine: dict, body: list[Token], values: dict, args: list) -> DataFrame:
        for name in self._reads(body):  # a script plans its statements itself, by the session's names
            self._named(name)[0].createOrReplaceTempView(name)
        declared = " ".join(f"DECLARE `{p['name']}` {p['type']} DEFAULT {literal(values.get(p['name']))};" for p in routine["params"])
        inner = render(body[1:-1] if body and body[0].up == "BEGIN" else body)
        return self.spark.sql(f"BEGIN {declared} {rewrite(inner)} END")

    def _drop(self, parts: list[Token], text: str, params: list) -> CommandResult:
        words = [t.up for t in parts]
        i = 1
        kind = words[i]
        if kind == "MATERIALIZED":
            kind, i = "TABLE", i + 1
        i += 1
        if_exists = words[i : i + 2] == ["IF", "EXISTS"]
        i += 2 * if_exists
        name = string_value(parts[i]) if parts[i].kind == "string" else parts[i].name
        state = self.catalog.state
        rbac.check(state, self.user, "DROP", [name])
        if kind == "TABLE":
            ddl.drop_table(self.catalog, name, if_exists)
        elif kind == "INDEX":
            ddl.drop_index(self.catalog, name, parts[i + 2].name if words[i + 1 : i + 2] == ["ON"] else None)
        elif kind == "USER":
            rbac.drop_user(state, name, if_exists)
        elif kind in ("DATABASE", "SCHEMA"):
            if name not in state.databases and not if_exists:
                raise CatalogError(f"there is no database {name}")
            state.databases = [d for d in state.databases if d != name]
        else:
            where = {"VIEW": state.views, "TRIGGER": state.triggers, "PROCEDURE": state.routines, "FUNCTION": state.routines}.get(kind)
            if where is None:
                raise SqlError(f"DROP {kind} isn't known")
            if where.pop(name, None) is None and not if_exists:
                raise CatalogError(f"there is no {kind.lower()} {name}")
            if kind == "FUNCTION":
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
        return CommandResult(message=f"dropped {name}")

    def _alter(self, parts: list[Token], text: str, params: list) -> CommandResult:
        rbac.check(self.catalog.state, self.user, "ALTER", [parts[2].name])
        if parts[1].up == "VIEW":
            if parts[2].name not in self.catalog.state.views:
                raise CatalogError(f"there is no view {parts[2].name}")
            self._create_view(parts[2].name, parts, 3, True)
        else:
            name = parts[2].name
            for action in split_at(parts[3:]):
                ddl.alter_table(self.catalog, name, action)
                if [t.up for t in action[:2]] == ["RENAME", "TO"]:
                    name = action[2].name
        return CommandResult()

    def _transaction(self, parts: list[Token], text: str, params: list) -> CommandResult:
        words = [t.up for t in parts]
        if words[0] in ("BEGIN", "START"):
            self.catalog.begin()
        elif words[0] == "COMMIT":
            self.catalog.commit()
        elif words[0] == "SAVEPOINT":
            self.catalog.savepoint(parts[1].name)
        elif words[0] == "RELEASE":
            self.catalog.release(parts[-1].name)
        elif "TO" in words:
            self.catalog.rollback(parts[-1].name)
        else:
            self.catalog.rollback()
        return CommandResult()

    def _prepare(self, parts: list[Token], text: str, params: list) -> CommandResult:
        source = parts[3]
        body = string_value(source) if source.kind == "string" else str(self._variable(source.text))
        self.prepared[parts[1].name] = Prepared(body, sum(t.kind == "param" for t in tokens(body)))
        return CommandResult()

    def _execute(self, parts: list[Token], text: str, params: list) -> DataFrame | CommandResult:
        if parts[1].name not in self.prepared:
            raise SqlError(f"{parts[1].name} isn't prepared")
        using = [self._value(a) for a in split_at(parts[3:])] if len(parts) > 2 else params
        return self.sql(self.prepared[parts[1].name].text, using)

    def _deallocate(self, parts: list[Token], text: str, params: list) -> CommandResult:
        if self.prepared.pop(parts[-1].name, None) is None:
            raise SqlError(f"{parts[-1].name} isn't prepared")
        return CommandResult()

    def _set(self, parts: list[Token], text: str, params: list) -> CommandResult:
        """User variables; settings of the system are taken without effect."""
        for a in split_at(self._bound(parts[1:], params)):
            if a[0].kind == "variable" and not a[0].text.startswith("@@"):
                at = next(k for k, t in enumerate(a) if t.text == "=" or t.text == ":")
                at += a[at].text == ":"
                self.variables[a[0].text[1:].lower()] = self._value(a[at + 1 :])
        return CommandResult()

    def _grant(self, parts: list[Token], text: str, params: list) -> CommandResult:
        words = [t.up for t in parts]
        on = words.index("ON") if "ON" in words else None
        to = len(words) - 1 - words[::-1].index("TO" if words[0] == "GRANT" else "FROM")
        privileges = [p[0].up for p in split_at(parts[1 : on or to])]
        target = parts[on + 1 : to] if on else []
        table = rbac.EVERY if not target or target[-1].text == "*" else target[-1].name
        user = string_value(parts[to + 1]) if parts[to + 1].kind == "string" else parts[to + 1].name
        (rbac.grant if words[0] == "GRANT" else rbac.revoke)(self.catalog.state, user, privileges, table)
        return CommandResult()

    def _search_sql(self, parts: list[Token], text: str, params: list) -> DataFrame:
        return self.search(parts[1].name, string_value(parts[2]))

    def _use(self, parts: list[Token], text: str, params: list) -> CommandResult:
        if parts[1].name not in self.catalog.state.databases:
            raise CatalogError(f"there is no database {parts[1].name}")
        self.database = parts[1].name
        return CommandResult()

    def _nothing(self, parts: list[Token], text: str, params: list) -> CommandResult:
        return CommandResult()

    def _describe(self, parts: list[Token], text: str, params: list) -> DataFrame:
        return self._show_columns(parts[-1].name)

    def _show_columns(self, name: str) -> DataFrame:
        if name in self.catalog.state.tables:
            t = self.catalog.table(name)
            rows = [(c.name, c.declared, "NO" if c.not_null or c.name in t.primary_key else "YES", "PRI" if c.name in t.primary_key else "", c.default, "auto_increment" if c.auto else "") for c in t.columns]
        else:
            rows = [(n, k.upper(), "YES", "", None, "") for n, k in self.table(name).dtypes]
        return self.spark.createDataFrame(rows, "Field string, Type string, Null string, Key string, Default string, Extra string")

    def _show(self, parts: list[Token], text: str, params: list) -> DataFrame:
        words = [t.up for t in parts if t.up not in ("FULL", "GLOBAL", "SESSION")]
        kept = [t for t in parts if t.up not in ("FULL", "GLOBAL", "SESSION")]
        like = string_value(kept[words.index("LIKE") + 1]) if "LIKE" in words else None
        what = words[1]
        after = kept[-1].name if len(kept) > 2 else None
        state = self.catalog.state
        rows_of = lambda values, schema: self.spark.createDataFrame(values, schema)
        if what == "TABLES":
            out = rows_of([(n,) for n in sorted({*state.tables, *state.views, *self.sources})], "table_name string")
            return out if like is None else out.filter(F.col("table_name").like(like))
        if what in ("DATABASES", "SCHEMAS"):
            return rows_of([(d,) for d in sorted(state.databases)], "schema_name string")
        if what in ("COLUMNS", "FIELDS"):
            return self._show_columns(kept[3].name)
        if what == "CREATE" and words[2] == "TABLE":
            return rows_of([(after, create_statement(self.catalog.table(after)))], "Table string, `Create Table` string")
        if what == "CREATE":
            return rows_of([(after, f"CREATE DATABASE `{after}`")], "Database string, `Create Database` string")
        if what in ("INDEX", "INDEXES", "KEYS"):
            return infoschema.view("statistics", self.catalog, {}).filter(F.col("table_name") == kept[3].name)
        if what == "VARIABLES":
            out = rows_of([(k, str(v)) for k, v in sorted(SYSTEM_VARIABLES.items())], "Variable_name string, Value string")
            return out if like is None else out.filter(F.col("Variable_name").like(like))
        if what == "STATUS":
            out = rows_of([(k, str(v)) for k, v in self.metrics.rows().items()], "Variable_name string, Value string")
            return out if like is None else out.filter(F.col("Variable_name").like(like))
        if what == "PROCESSLIST":
            return rows_of([(1, self.user or "owner", "localhost", self.database, "Query", 0, "", text)], "Id long, User string, Host string, db string, Command string, Time long, State string, Info string")
        raise SqlError(f"SHOW {what} isn't known")

    def _explain(self, parts: list[Token], text: str, params: list) -> DataFrame:
        """The steps of a query as (stage, operation, details), taken from Catalyst's optimised plan."""
        body = parts[2:] if parts[1].up in ("FORMATTED", "EXTENDED", "ANALYZE") else parts[1:]
        return self.explained(self._query(render(body), params))

    def explained(self, df: DataFrame) -> DataFrame:
        rows = []
        for line in reversed(df._jdf.queryExecution().optimizedPlan().toString().splitlines()):
            plan = re.sub(r"#\d+L?", "", line.lstrip(" :+-"))
            op = plan.split(" ", 1)[0].split("(")[0]
            rest = plan[len(op) :].strip()
            stage = {"Relation": "SCAN", "LogicalRDD": "SCAN", "LocalRelation": "SCAN", "OneRowRelation": "SCAN", "Range": "SCAN", "Join": "JOIN", "Filter": "FILTER", "Aggregate": "AGGREGATE", "Sort": "ORDER", "GlobalLimit": "LIMIT", "Window": "WINDOW", "Project": "PROJECT", "Union": "UNION"}.get(op)
            if stage == "FILTER" and rows and rows[-1][0] == "AGGREGATE":
                rows.append((stage, "HAVING", rest))
            elif stage:
                rows.append((stage, {"FILTER": "WHERE", "JOIN": rest.split(",")[0].split(" ")[0] or "Inner"}.get(stage, op), rest))
        return self.spark.createDataFrame(rows, "stage string, operation string, details string")

    # The JSON form ---------------------------------------------------------------------------

    def _ir_select(self, body: dict, params: list) -> DataFrame:
        rbac.check(self.catalog.state, self.user, "SELECT", [body["table"], *[j["table"] for j in body.get("joins") or []]] if body.get("table") else [])
        return self.planner(params).select(body)

    def _ir_value(self, e: object, params: list) -> object:
        return self.planner(params).select({"columns": [{"expr": e, "alias": "v"}]}).first()[0]

    def _ir_cx(self, table: Table, params: list) -> ir_expr.Context:
        names = ir_expr.Names([(table.name, [c.name for c in table.columns], table.json_columns)])
        return ir_expr.Context(names, params, self._variable, lambda q, around: self.planner(params).select(q), self.compat)

    def _ir_insert(self, body: dict, params: list) -> CommandResult:
        table = self._target(body["table"])
        rbac.check(self.catalog.state, self.user, "INSERT", [table.name])
        given = body.get("columns") or [c.name for c in table.columns]
        rows = self.planner(params).select({"columns": [{"expr": e, "alias": f"v{i}"} for i, e in enumerate(body["values"])]})
        mode = {"Normal": "plain", "Replace": "replace", "Ignore": "ignore"}[body.get("mode", "Normal")]
        update = {n: literal(self._ir_value(e, params)) for n, e in body.get("on_duplicate_update") or []} or None
        return CommandResult(dml.insert(self.catalog, table, rows, given, mode, update))

    def _ir_change(self, body: dict, params: list, delete: bool) -> CommandResult:
        table = self._target(body["table"])
        rbac.check(self.catalog.state, self.user, "DELETE" if delete else "UPDATE", [table.name])
        object.__setattr__(table, "rows", table.rows.alias(table.name))
        cx = self._ir_cx(table, params)
        where = ir_expr.condition(body["where_clause"], cx) if body.get("where_clause") else None
        if delete:
            return CommandResult(dml.delete(self.catalog, table, where))
        return CommandResult(dml.update(self.catalog, table, {n: ir_expr.expression(e, cx) for n, e in body["assignments"]}, where))

    def _ir_view(self, body: dict, params: list) -> CommandResult:
        """A view of the JSON form is in the catalog as its query."""
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        held = json.dumps({"query": body["query"], "columns": body.get("columns")})
        found = self._view(held).columns  # an impossible view is an error now
        if len(set(found)) != len(found):
            raise SqlError("a view's columns need different names")
        self.catalog.state.views[body["name"]] = held
        return CommandResult(message=f"created {body['name']}")

    def _ir_materialized(self, body: dict, params: list) -> CommandResult:
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        held = json.dumps({"query": body["query"]})
        self._create_from(body["name"], self._view(held))
        reads = tuple(self._reads_of(held))
        self.catalog.state.materialized[body["name"]] = Materialized(held, reads, self._marks(reads))
        return CommandResult(message=f"created {body['name']}")

    def _ir_table(self, body: dict, params: list) -> CommandResult:
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        name, key = body["name"], tuple(body.get("primary_key") or [])
        foreign = tuple(_ir_foreign(f) for f in body.get("foreign_keys") or [])
        indexes = (Index(f"pk_{name}", tuple(f"`{c}`" for c in key), True),) if key else ()
        ddl.create_table(self.catalog, Table(name, tuple(_ir_column(c) for c in body["columns"]), key, foreign, indexes))
        return CommandResult(message=f"created {name}")

    def _ir_index(self, body: dict, params: list) -> CommandResult:
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        expressions = tuple(_ir_sql(e) for e in body["expressions"])
        where = _ir_sql(body["where_clause"]) if body.get("where_clause") else None
        ddl.create_index(self.catalog, body["table"], Index(body["name"], expressions, body.get("unique", False), str(body.get("index_type") or "BTree").upper(), where))
        return CommandResult(message=f"created {body['name']}")

    def _ir_alter(self, body: dict, params: list) -> CommandResult:
        kind, a = ir_expr.node(body["action"])
        q = lambda n: f"`{n}`"
        names = lambda ns: ", ".join(map(q, ns))
        text = {
            "AddColumn": lambda: f"ADD COLUMN {_ir_definition(a)}",
            "DropColumn": lambda: f"DROP COLUMN {q(a)}",
            "RenameColumn": lambda: f"RENAME COLUMN {q(a['old_name'])} TO {q(a['new_name'])}",
            "RenameTable": lambda: f"RENAME TO {q(a)}",
            "ModifyColumn": lambda: f"MODIFY COLUMN {q(a['name'])} {_ir_type(a['data_type'])}",
            "SetDefault": lambda: f"ALTER COLUMN {q(a['column'])} SET DEFAULT {literal(ir_expr.value(a['value']))}",
            "DropDefault": lambda: f"ALTER COLUMN {q(a['column'])} DROP DEFAULT",
            "SetNotNull": lambda: f"ALTER COLUMN {q(a['column'])} SET NOT NULL",
            "DropNotNull": lambda: f"ALTER COLUMN {q(a['column'])} DROP NOT NULL",
            "AddPrimaryKey": lambda: f"ADD PRIMARY KEY ({names(a['columns'])})",
            "DropPrimaryKey": lambda: "DROP PRIMARY KEY",
            "AddForeignKey": lambda: f"ADD CONSTRAINT {q(a.get('name') or '_'.join(['fk', body['table'], *a['columns']]))} FOREIGN KEY ({names(a['columns'])}) REFERENCES {q(a['ref_table'])} ({names(a['ref_columns'])})",
            "DropForeignKey": lambda: f"DROP FOREIGN KEY {q(a['name'] if isinstance(a, dict) else a)}",
            "AlterEngine": lambda: "ENGINE = default",
            "AlterCharset": lambda: "CHARACTER SET utf8mb4",
        }.get(kind)
        if text is None:
            raise SqlError(f"the change {kind} isn't known")
        return self.sql(f"ALTER TABLE {q(body['table'])} {text()}")

    def _ir_trigger(self, body: dict, params: list) -> CommandResult:
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        if body["name"] in self.catalog.state.triggers:
            raise CatalogError(f"the trigger {body['name']} exists")
        self.catalog.state.triggers[body["name"]] = {"timing": str(body["timing"]).upper(), "event": str(body["event"]).upper(), "table": body["table"], "body": json.dumps(body.get("body"))}
        return CommandResult(message=f"created {body['name']}")

    def _ir_routine(self, kind: str, body: dict) -> CommandResult:
        """A routine whose body is a statement of the JSON form; its parameters are columns by their names there."""
        rbac.check(self.catalog.state, self.user, "CREATE", [])
        if body["name"] in self.catalog.state.routines:
            raise CatalogError(f"{body['name']} exists")
        params = [{"mode": str(p.get("mode", "In")).upper(), "name": p["name"], "type": _ir_type(p["data_type"])} for p in body.get("params") or []]
        returns = _ir_type(body["return_type"]) if kind == "FUNCTION" else None
        self.catalog.state.routines[body["name"]] = {"kind": kind, "params": params, "returns": returns, "body": json.dumps(body["body"])}
        return CommandResult(message=f"created {body['name']}")

    def _ir_call(self, body: dict, params: list) -> object:
        routine = self.catalog.state.routines.get(body["name"])
        if routine is None or not routine["body"].startswith("{"):
            return self.sql(f"CALL {body['name']}({', '.join(literal(self._ir_value(e, params)) for e in body.get('args', []))})")
        return self._run_routine(routine, [self._ir_value(e, params) for e in body.get("args") or []])

    def _run_routine(self, routine: dict, values: list) -> object:
        """A routine of the JSON form with values for its parameters."""
        if len(values) != len(routine["params"]):
            raise SqlError(f"{len(routine['params'])} arguments are needed, {len(values)} given")
        given = {p["name"]: _ir_literal(v) for p, v in zip(routine["params"], values, strict=True)}
        return self.ir(_filled(json.loads(routine["body"]), given))

    def _ir_show(self, body: dict, params: list) -> DataFrame:
        kind, arg = ir_expr.node(body["variant"])
        text = {"Tables": "TABLES", "Databases": "DATABASES", "Columns": f"COLUMNS FROM `{arg}`", "CreateTable": f"CREATE TABLE `{arg}`", "CreateDatabase": f"CREATE DATABASE `{arg}`", "Index": f"INDEX FROM `{arg}`", "Variables": "VARIABLES", "Status": "STATUS", "Processlist": "PROCESSLIST"}[kind]
        return self.sql(f"SHOW {text}" + (f" LIKE {literal(arg)}" if kind in ("Variables", "Status", "Tables") and arg else ""))

    def _ir_set(self, body: dict, params: list) -> CommandResult:
        for target, e in body["assignments"]:
            _, variable = ir_expr.node(target)
            if not variable.get("is_system"):
                self.variables[variable["name"].lower()] = self._ir_value(e, params)
        return CommandResult()


#: One row of a dump.
_ROW = re.compile(r"(INSERT INTO (?:`[^`]*`|\w+) VALUES)\s*(\(.*\))\s*;?\s*", re.S)


#: What a dump writes for characters of a text, in this order, and what a restore reads, in this one.
_ESCAPES = [("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")]
_UNESCAPES = [("\\\\", "\0"), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")]


def _replaced(text, pairs: list[tuple[str, str]]):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _texts(df: DataFrame) -> set[str]:
    """Columns that may hold JSON: names after theirs are keys."""
    return {f.name for f in df.schema if isinstance(f.dataType, StringType)}


#: Words that may follow a table and aren't its alias.
_AFTER_TABLE = {"ON", "USING", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "SET", "AS", "OFFSET", "WINDOW"}


def _aliases(parts: list[Token]) -> set[str]:
    """Names that tables and subqueries of a query go by: before a dot they are no columns."""
    out = set()
    for i, t in enumerate(parts):
        if t.up in ("FROM", "JOIN", ",") and i + 1 < len(parts) and parts[i + 1].kind in ("word", "quoted"):
            out.add(parts[i + 1].name if t.up != "," else "")
            k = i + 2
            if k < len(parts) and parts[k].up == "AS":
                k += 1
            if k < len(parts) and parts[k].kind in ("word", "quoted") and parts[k].up not in _AFTER_TABLE and t.up != ",":
                out.add(parts[k].name)
        if t.text == ")" and i + 1 < len(parts):
            k = i + 1 + (parts[i + 1].up == "AS")
            if k < len(parts) and parts[k].kind in ("word", "quoted") and parts[k].up not in _AFTER_TABLE:
                out.add(parts[k].name)
    return out


def _within(sql: str, named: list[str]) -> str:
    """A query with further common table expressions before its own."""
    if not named:
        return sql
    m = re.match(r"\s*WITH(\s+RECURSIVE)?\s", sql, re.I)
    if m:
        return f"WITH{m[1] or ''} {', '.join(named)}, {sql[m.end():]}"
    return f"WITH {', '.join(named)} {sql}"


def _tables_in(x: object) -> list[str]:
    """Names of tables in a query of the JSON form."""
    if isinstance(x, dict):
        own = [x["table"]] if isinstance(x.get("table"), str) else []
        return list(dict.fromkeys(own + [n for v in x.values() for n in _tables_in(v)]))
    return list(dict.fromkeys(n for v in x for n in _tables_in(v))) if isinstance(x, list) else []


# Parts of definitions in the JSON form as the dialect's text or the catalog's objects.
_IR_TYPES = {"TinyUInt": "TINYINT UNSIGNED", "SmallUInt": "SMALLINT UNSIGNED", "UInt": "INT UNSIGNED", "BigUInt": "BIGINT UNSIGNED", "Bool": "BOOLEAN"}


def _ir_type(x: object) -> str:
    kind, arguments = ir_expr.node(x)
    given = arguments if isinstance(arguments, list) else [] if arguments is None else [arguments]
    return _IR_TYPES.get(kind, kind.upper()) + (f"({', '.join(literal(a) for a in given)})" if given else "")


def _ir_definition(c: dict) -> str:
    default = f" DEFAULT {literal(ir_expr.value(c['default_value']))}" if c.get("default_value") not in (None, "Null") else ""
    return f"`{c['name']}` {_ir_type(c['data_type'])}{' NOT NULL' * bool(c.get('is_not_null'))}{default}{' AUTO_INCREMENT' * bool(c.get('is_auto_increment'))}"


def _ir_column(c: dict) -> Column:
    return ddl.parse_column(tokens(_ir_definition(c)))[0]


def _ir_foreign(f: dict) -> ForeignKey:
    return ForeignKey(f["name"], tuple(f["columns"]), f["ref_table"], tuple(f["ref_columns"]))


def _ir_sql(x: object) -> str:
    """An index's expression or condition as SQL."""
    kind, body = ir_expr.node(x)
    if kind == "Column":
        return f"`{body}`"
    if kind == "Literal":
        return literal(ir_expr.value(body))
    if kind in ("ScalarFunc", "FunctionCall"):
        return f"{body['name'].lower()}({', '.join(map(_ir_sql, body['args']))})"
    signs = {"Add": "+", "Sub": "-", "Mul": "*", "Div": "/", "Eq": "=", "Neq": "<>", "Lt": "<", "Lte": "<=", "Gt": ">", "Gte": ">="}
    if kind in ("BinaryOp", "Comparison"):
        return f"({_ir_sql(body[0])} {signs[body[1]]} {_ir_sql(body[2])})"
    if kind in ("And", "Or"):
        return f"({_ir_sql(body[0])} {kind.upper()} {_ir_sql(body[1])})"
    if kind == "Is":
        return f"({_ir_sql(body[0])} IS {'NOT NULL' if body[1] == 'NotNull' else str(body[1]).upper()})"
    raise SqlError(f"an index can't be on {kind}")


def _ir_literal(v: object) -> dict:
    if v is None:
        return {"Literal": "Null"}
    kind = "Bool" if isinstance(v, bool) else "Int" if isinstance(v, int) else "Float" if isinstance(v, float) else "Text"
    return {"Literal": {kind: v if kind != "Text" else str(v)}}


def _filled(x: object, given: dict[str, dict]) -> object:
    """A statement with parameters' names replaced by their values."""
    if isinstance(x, dict):
        if len(x) == 1 and x.get("Column") in given:
            return given[x["Column"]]
        return {k: _filled(v, given) for k, v in x.items()}
    return [_filled(v, given) for v in x] if isinstance(x, list) else x


def _parents_first(tables: dict[str, Table]) -> list[Table]:
    out: list[Table] = []
    waiting = [t for _, t in sorted(tables.items())]
    while waiting:
        done = {t.name for t in out}
        ready = [t for t in waiting if all(f.parent in done or f.parent == t.name for f in t.foreign_keys)] or waiting[:1]
        out += ready
        waiting = [t for t in waiting if t not in ready]
    return out


def _dumped(v: object) -> str:
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex()}'"
    if v is None or isinstance(v, bool | int | float):
        return literal(v)
    return literal(str(v))


def create_statement(t: Table) -> str:
    """CREATE TABLE, and its further indexes."""
    parts = []
    for c in t.columns:
        kind = c.declared
        parts.append(f"`{c.name}` {kind}{' NOT NULL' * c.not_null}{f' DEFAULT {c.default}' if c.default is not None else ''}{' AUTO_INCREMENT' * (c.auto and c.kind != 'SERIAL')}")
    if t.primary_key:
        parts.append(f"PRIMARY KEY ({', '.join(f'`{c}`' for c in t.primary_key)})")
    for f in t.foreign_keys:
        parts.append(f"CONSTRAINT `{f.name}` FOREIGN KEY ({', '.join(f'`{c}`' for c in f.columns)}) REFERENCES `{f.parent}` ({', '.join(f'`{c}`' for c in f.parent_columns)})")
    out = f"CREATE TABLE `{t.name}` ({', '.join(parts)})"
    for i in t.indexes:
        if i.name != f"pk_{t.name}":
            out += f";\nCREATE {'UNIQUE ' * i.unique}INDEX `{i.name}` ON `{t.name}` ({', '.join(i.expressions)}) USING {i.kind}{f' WHERE {i.where}' if i.where else ''}"
    return out


_Statement = Callable[[Engine, list[Token], str, list], "DataFrame | CommandResult"]
_STATEMENTS: dict[str, _Statement] = {
    "SELECT": Engine._select, "WITH": Engine._select, "VALUES": Engine._select, "INSERT": Engine._insert, "REPLACE": Engine._insert, "UPDATE": Engine._update, "DELETE": Engine._delete,
    "CREATE": Engine._create, "DROP": Engine._drop, "ALTER": Engine._alter, "BEGIN": Engine._transaction, "START": Engine._transaction, "COMMIT": Engine._transaction, "ROLLBACK": Engine._transaction,
    "SAVEPOINT": Engine._transaction, "RELEASE": Engine._transaction, "PREPARE": Engine._prepare, "EXECUTE": Engine._execute, "DEALLOCATE": Engine._deallocate, "SET": Engine._set, "SHOW": Engine._show,
    "DESCRIBE": Engine._describe, "DESC": Engine._describe, "EXPLAIN": Engine._explain, "USE": Engine._use, "KILL": Engine._nothing, "GRANT": Engine._grant, "REVOKE": Engine._grant, "CALL": Engine._call, "SEARCH": Engine._search_sql,
}


def _through_sql(make: Callable[[dict], str]):
    return lambda self, body, params: self.sql(make(body), params)


def _plain_value(x: object) -> str:
    return str(ir_expr.value(x))


_IR: dict[str, Callable[[Engine, object, list], object]] = {
    "Select": Engine._ir_select,
    "Explain": lambda self, body, params: self.explained(self._ir_select(body, params)),
    "Insert": Engine._ir_insert,
    "Update": lambda self, body, params: self._ir_change(body, params, False),
    "Delete": lambda self, body, params: self._ir_change(body, params, True),
    "Search": lambda self, body, params: self.search(body["table"], body["query"]),
    "Show": Engine._ir_show,
    "Set": Engine._ir_set,
    "CreateView": Engine._ir_view,
    "AlterView": Engine._ir_view,
    "DropView": _through_sql(lambda b: f"DROP VIEW `{b['name']}`"),
    "CreateTable": Engine._ir_table,
    "CreateIndex": Engine._ir_index,
    "AlterTable": Engine._ir_alter,
    "CreateMaterializedView": Engine._ir_materialized,
    "CreateTrigger": Engine._ir_trigger,
    "DropTrigger": _through_sql(lambda b: f"DROP TRIGGER `{b['name']}`"),
    "CreateProcedure": lambda self, b, params: self._ir_routine("PROCEDURE", b),
    "DropProcedure": _through_sql(lambda b: f"DROP PROCEDURE `{b['name']}`"),
    "CreateFunction": lambda self, b, params: self._ir_routine("FUNCTION", b),
    "DropFunction": _through_sql(lambda b: f"DROP FUNCTION `{b['name']}`"),
    "DropTable": _through_sql(lambda b: f"DROP TABLE {'IF EXISTS ' * b.get('if_exists', False)}`{b['name']}`"),
    "CreateDatabase": _through_sql(lambda b: f"CREATE DATABASE {'IF NOT EXISTS ' * b.get('if_not_exists', False)}`{b['name']}`"),
    "DropDatabase": _through_sql(lambda b: f"DROP DATABASE {'IF EXISTS ' * b.get('if_exists', False)}`{b['name']}`"),
    "CreateUser": _through_sql(lambda b: f"CREATE USER {literal(b['username'])} IDENTIFIED BY {literal(b['password'])}"),
    "DropUser": _through_sql(lambda b: f"DROP USER {literal(b['username'])}"),
    "Grant": lambda self, b, params: CommandResult(int(rbac.grant(self.catalog.state, b["username"], [p.upper() for p in b["privileges"]], b.get("table") or rbac.EVERY) is None)),
    "Revoke": lambda self, b, params: CommandResult(int(rbac.revoke(self.catalog.state, b["username"], [p.upper() for p in b["privileges"]], b.get("table") or rbac.EVERY) is None)),
    "Prepare": lambda self, b, params: self.prepared.__setitem__(b["name"], Prepared(b["sql"], b["sql"].count("?"))),
    "Execute": lambda self, b, params: self.sql(self.prepared[b["name"]].text, [self._ir_value(e, params) for e in b.get("params", [])]),
    "Deallocate": _through_sql(lambda b: f"DEALLOCATE PREPARE {b}"),
    "Call": Engine._ir_call,
    "Begin": _through_sql(lambda b: "BEGIN"),
    "Commit": _through_sql(lambda b: "COMMIT"),
    "Rollback": _through_sql(lambda b: "ROLLBACK"),
    "Savepoint": _through_sql(lambda b: f"SAVEPOINT `{b['name']}`"),
    "Kill": lambda self, b, params: CommandResult(),
    "KvSet": lambda self, b, params: self.kv.set(b["key"], _plain_value(b["value"]), px=b.get("expiry")),
    "KvGet": lambda self, b, params: self.kv.get(b["key"]),
    "KvDel": lambda self, b, params: self.kv.delete(*b["keys"]),
    "KvHashSet": lambda self, b, params: self.kv.hset(b["key"], {b["field"]: _plain_value(b["value"])}),
    "KvHashGet": lambda self, b, params: self.kv.hget(b["key"], b["field"]),
    "KvHashGetAll": lambda self, b, params: self.kv.hgetall(b["key"]),
    "KvListPush": lambda self, b, params: (self.kv.lpush if b.get("left") else self.kv.rpush)(b["key"], *[_plain_value(v) for v in b["values"]]),
    "KvListRange": lambda self, b, params: self.kv.lrange(b["key"], b["start"], b["stop"]),
    "KvSetAdd": lambda self, b, params: self.kv.sadd(b["key"], *b["members"]),
    "KvSetMembers": lambda self, b, params: self.kv.smembers(b["key"]),
    "KvZSetAdd": lambda self, b, params: self.kv.zadd(b["key"], {m: s for s, m in b["members"]}),
    "KvZSetRange": lambda self, b, params: self.kv.zrange(b["key"], b["start"], b["stop"], b.get("with_scores", False)),
    "KvStreamAdd": lambda self, b, params: self.kv.xadd(b["key"], {k: _plain_value(v) for k, v in b["fields"].items()}, b.get("id")),
    "KvStreamRange": lambda self, b, params: self.kv.xrange(b["key"], b["start"], b["stop"], b.get("count")),
    "KvStreamLen": lambda self, b, params: self.kv.xlen(b["key"]),
    "PubSubPublish": lambda self, b, params: self.channels.publish(b["channel"], b["message"]),
    "Sequence": lambda self, b, params: [self.ir(x, params) for x in b][-1],
}
