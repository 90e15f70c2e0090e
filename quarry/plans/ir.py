"""Queries of the JSON form as DataFrames: joins, filter, groups, windows, set operations, order, limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from .expr import Context, Names, binary, condition, expression, node, ordering
from .lexer import SqlError

_JOINS = {"Inner": "inner", "Left": "left", "Right": "right", "Full": "full", "Cross": "cross", "Semi": "left_semi", "Anti": "left_anti"}


class Planner:
    """``table``: (rows, JSON columns) of a name; ``variable``: a session variable's value."""

    def __init__(self, spark: SparkSession, table: Callable[[str], tuple[DataFrame, set[str]]], variable: Callable[[str], object], params: list[object] | None = None, compat: bool = False):
        self.spark, self.table, self.variable, self.params, self.compat = spark, table, variable, params or [], compat

    def select(self, q: dict, ctes: dict[str, DataFrame] | None = None, outer: Names | None = None) -> DataFrame:
        ctes = dict(ctes or {})
        clause = q.get("with_clause") or {}
        for cte in clause.get("ctes", []):
            recursive = clause.get("recursive") and self._mentions(cte["query"], cte["name"])
            ctes[cte["name"]] = self._recursive(cte, ctes) if recursive else self.select(cte["query"], ctes)
        operations = q.get("set_operations") or []
        out, finish = self._block(q, ctes, outer, tail=not operations)
        for op in operations:
            other = self.select(op["select"], ctes, outer)
            kind = op["operator"]
            out = {"Union": lambda a, b: a.union(b).distinct(), "UnionAll": DataFrame.union, "Intersect": DataFrame.intersect, "Except": DataFrame.subtract}[kind](out, other)
        if operations:
            # The whole result is ordered and cut.
            cx = self._context(Names([("_all", out.columns, set())]), ctes)
            out = out.alias("_all")
            if q.get("order_by"):
                out = out.orderBy(*ordering(q["order_by"], cx))
            return self._cut(out, q)
        return finish(out)

    def _mentions(self, q: object, name: str) -> bool:
        if isinstance(q, dict):
            return q.get("table") == name or any(self._mentions(v, name) for v in q.values())
        return isinstance(q, list) and any(self._mentions(v, name) for v in q)

    def _recursive(self, cte: dict, ctes: dict[str, DataFrame], most: int = 1000) -> DataFrame:
        """Rounds of the recursive branches on the rows that were new, until none is."""
        q, name = cte["query"], cte["name"]
        base = self.select({**q, "set_operations": []}, ctes)
        branches = q.get("set_operations") or []
        distinct = any(b["operator"] == "Union" for b in branches)
        fresh = stored(base.distinct() if distinct else base, "recursive")[0]
        out = fresh
        for _ in range(most):
            new = None
            for b in branches:
                part = self.select(b["select"], {**ctes, name: fresh})
                part = part.toDF(*base.columns)
                new = part if new is None else new.union(part)
            new = new.distinct().exceptAll(out.distinct()) if distinct else new
            fresh = stored(new, "recursive")[0]
            if fresh.isEmpty():
                return out
            out = out.union(fresh)
        raise SqlError("a recursive query doesn't end")

    def _context(self, names: Names, ctes: dict[str, DataFrame]) -> Context:
        return Context(names, self.params, self.variable, lambda q, around: self.select(q, ctes, around), self.compat)

    def _source(self, name: str, alias: str | None, ctes: dict[str, DataFrame]) -> tuple[DataFrame, tuple[str, list[str], set[str]]]:
        rows, json_columns = (ctes[name], set()) if name in ctes else self.table(name)
        alias = alias or name
        return rows.alias(alias), (alias, rows.columns, json_columns)

    def _block(self, q: dict, ctes: dict[str, DataFrame], outer: Names | None, tail: bool):
        if q.get("table") in (None, "", "dual"):
            df, names = self.spark.range(1).select().alias("dual"), Names([], outer)
        else:
            df, first = self._source(q["table"], q.get("table_alias"), ctes)
            names = Names([first], outer)
        cx = self._context(names, ctes)
        for j in q.get("joins") or []:
            right, entry = self._source(j["table"], j.get("table_alias"), ctes)
            how = _JOINS[j.get("join_type", "Inner")]
            names.tables.append(entry)
            df = df.crossJoin(right) if how == "cross" else df.join(right, condition(j["on"], cx), how)
            if how in ("left_semi", "left_anti"):
                names.tables.pop()
        if q.get("where_clause"):
            df = df.filter(condition(q["where_clause"], cx))
        columns = q.get("columns") or [{"expr": "Star"}]
        grouped = bool(q.get("group_by")) or any(self._aggregates(c["expr"]) for c in columns) or self._aggregates(q.get("having"))
        out = self._grouped(df, q, columns, cx) if grouped else None
        if out is None:
            selected, aliases = [], set()
            for k, c in enumerate(columns):
                if c["expr"] == "Star":
                    selected += [F.col(f"`{a}`.`{n}`") for a, ns, _ in names.tables for n in ns]
                else:
                    e, alias = expression(c["expr"], cx), c.get("alias")
                    aliases |= {alias} - {None}
                    selected.append(e.alias(alias or self._auto(c["expr"], k)))
            if q.get("order_by") and not q.get("distinct") and tail:
                # Keys may be input columns or aliases.
                shown = {c["alias"]: expression(c["expr"], cx) for c in columns if c.get("alias")}
                keys = []
                for item in q["order_by"]:
                    kind, body = node(item["expr"])
                    e = shown[body] if kind == "Column" and body in shown and not names.find([body]) else expression(item["expr"], cx)
                    keys.append(e.desc_nulls_last() if item.get("order", "Asc") == "Desc" else e.asc_nulls_first())
                df = df.orderBy(*keys)
            out = df.select(*selected)
        if q.get("distinct"):
            out = out.distinct()

        def finish(rows: DataFrame) -> DataFrame:
            if q.get("order_by") and (grouped or q.get("distinct")):
                plain = self._context(Names([("_out", rows.columns, set())]), ctes)
                items = [{**i, "expr": {"Column": node(i["expr"])[1].rpartition(".")[2]}} if node(i["expr"])[0] == "Column" else {**i, "expr": self._named(i["expr"], columns)} for i in q["order_by"]]
                rows = rows.alias("_out").orderBy(*ordering(items, plain))
            return self._cut(rows, q)

        return out, finish

    @staticmethod
    def _cut(rows: DataFrame, q: dict) -> DataFrame:
        limit = q.get("limit")
        if not limit:
            return rows
        rows = rows.offset(limit["offset"]) if limit.get("offset") else rows
        return rows.limit(limit["count"])

    def _named(self, e: object, columns: list[dict]) -> dict:
        """An ordering expression of a grouped query, by the output column that holds it."""
        for k, c in enumerate(columns):
            if c["expr"] == e:
                return {"Column": c.get("alias") or self._auto(e, k)}
        raise SqlError("order a grouped query by what it selects")

    def _aggregates(self, e: object) -> bool:
        if isinstance(e, dict):
            return "FunctionCall" in e or any(self._aggregates(v) for k, v in e.items() if k not in ("Subquery", "InSubquery", "Exists", "WindowFunc"))
        return isinstance(e, list) and any(self._aggregates(v) for v in e)

    def _grouped(self, df: DataFrame, q: dict, columns: list[dict], cx: Context) -> DataFrame:
        groups = q.get("group_by") or []
        keys = [expression(g, cx).alias(f"_g{i}") for i, g in enumerate(groups)]
        outputs = []
        for k, c in enumerate(columns):
            name = c.get("alias") or self._auto(c["expr"], k)
            if c["expr"] in groups:
                outputs.append((F.any_value(expression(c["expr"], cx)), name))
            elif self._aggregates(c["expr"]):
                outputs.append((expression(c["expr"], cx), name))
            else:  # a plain column beside aggregates has the value of any row of the group
                outputs.append((F.any_value(expression(c["expr"], cx)), name))
        aggregates = [e.alias(f"_a{i}") for i, (e, _) in enumerate(outputs)]
        if q.get("having"):
            aggregates.append(self._having(q["having"], cx).alias("_having"))
        # Without keys as a selection: a correlated query may not be analysed before it has its surroundings.
        out = df.groupBy(*keys).agg(*aggregates) if keys else df.select(*aggregates)
        if q.get("having"):
            out = out.filter("_having")
        return out.select(*[F.col(f"_a{i}").alias(n) for i, (_, n) in enumerate(outputs)])

    def _having(self, x: object, cx: Context) -> Column:
        """The condition as an aggregate: plain columns are the group's."""
        return _AnyValue(cx).condition(x)

    def _auto(self, e: object, k: int) -> str:
        kind, body = node(e)
        if kind == "Column":
            return body.rpartition(".")[2]
        return f"{body['name'].upper()}(...)" if kind in ("FunctionCall", "ScalarFunc") else f"col_{k}"


class _AnyValue:
    """Conditions over a group."""

    def __init__(self, cx: Context):
        self.cx = cx

    def condition(self, x: object):
        kind, body = node(x)
        if kind in ("And", "Or"):
            a, b = (self.condition(c) for c in body)
            return a & b if kind == "And" else a | b
        if kind == "Not":
            return ~self.condition(body)
        if kind == "Comparison":
            left, op, right = body
            a, b = self.value(left), self.value(right)
            return {"Eq": a == b, "Neq": a != b, "Lt": a < b, "Lte": a <= b, "Gt": a > b, "Gte": a >= b}[op]
        if kind == "Between":
            return self.value(body[0]).between(self.value(body[1]), self.value(body[2]))
        if kind == "In":
            return self.value(body[0]).isin(*[self.value(e) for e in body[1]])
        if kind == "Is":
            e = self.value(body[0])
            return {"Null": e.isNull(), "NotNull": e.isNotNull(), "True": e.eqNullSafe(F.lit(True)), "False": e.eqNullSafe(F.lit(False))}[body[1]]
        if kind == "Like":
            return self.value(body[0]).like(body[1])
        if kind in ("InSubquery", "Exists"):
            if kind == "Exists":
                return self.cx.subquery(body, self.cx.names).exists()
            return self.value(body[0]).isin(self.cx.subquery(body[1], self.cx.names))
        raise SqlError(f"the condition {kind} can't be used in HAVING")

    def value(self, x: object):
        kind, body = node(x)
        if kind == "Column":
            return F.any_value(expression(x, self.cx))
        if kind == "BinaryOp":
            return binary(self.value(body[0]), body[1], self.value(body[2]), self.cx.compat)
        return expression(x, self.cx)
