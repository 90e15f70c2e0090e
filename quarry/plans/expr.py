"""Expressions and conditions of the JSON form as Columns.

A node is a string (``"Star"``) or an object with one key, the kind: ``{"Column": "a.b"}``,
``{"Literal": {"Int": 1}}``, ``{"BinaryOp": [left, "Add", right]}`` and so on.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import date_pattern
from .lexer import SqlError


@dataclass
class Names:
    """What names mean in a query: its tables by alias with their columns, and the query around it."""

    tables: list[tuple[str, list[str], set[str]]]  # alias, columns, JSON columns
    outer: Names | None = None
    aliases: set[str] = field(default_factory=set)

    def find(self, path: list[str]) -> tuple[str, list[str]] | None:
        """(quoted column, JSON keys) of a dotted name, if it is one of this query's."""
        for alias, columns, json_columns in self.tables:
            for skip in (1, 0):
                if skip and path[0] != alias or len(path) <= skip or path[skip] not in columns:
                    continue
                keys = path[skip + 1 :]
                if not keys or path[skip] in json_columns:
                    return f"`{alias}`.`{path[skip]}`", keys
        return None


@dataclass
class Context:
    """Names in reach, parameters, variables, and how to run a subquery."""

    names: Names
    params: list[object]
    variable: Callable[[str], object]
    subquery: Callable[[dict, Names], DataFrame]
    compat: bool = False


def node(x: object) -> tuple[str, object]:
    if isinstance(x, str):
        return x, None
    if isinstance(x, dict) and len(x) == 1:
        return next(iter(x.items()))
    raise SqlError(f"not a node: {x!r}")


def value(x: object) -> object:
    """A literal's value."""
    if not isinstance(x, dict | str):
        return x
    kind, body = node(x)
    if kind == "Null":
        return None
    if kind == "DateTime":
        return dt.datetime.fromisoformat(str(body).replace("Z", "+00:00"))
    if kind == "Json":
        return json.dumps(body)
    if kind in ("Int", "Float", "Text", "Bool"):
        return body
    raise SqlError(f"not a value: {x!r}")


def column(name: str, cx: Context) -> Column:
    path = name.split(".")
    names, outer = cx.names, False
    while names is not None:
        if hit := names.find(path):
            quoted, keys = hit
            out = F.col(quoted).outer() if outer else F.col(quoted)
            return F.get_json_object(out, "$." + ".".join(keys)) if keys else out
        names, outer = names.outer, True
    if name in cx.names.aliases:
        return F.col(f"`{name}`")
    raise SqlError(f"there is no column {name}")


def expression(x: object, cx: Context) -> Column:
    kind, body = node(x)
    if kind == "Literal":
        return F.lit(value(body))
    if kind == "Column":
        return column(body, cx)
    if kind == "Placeholder":
        if not 0 <= body < len(cx.params):
            raise SqlError(f"parameter {body} is missing")
        return F.lit(cx.params[body])
    if kind == "Variable":
        return F.lit(cx.variable(("@@" if body.get("is_system") else "@") + body["name"]))
    if kind == "BinaryOp":
        left, op, right = body
        return binary(expression(left, cx), op, expression(right, cx), cx.compat)
    if kind == "UnaryNot":
        return ~expression(body, cx)
    if kind == "ScalarFunc":
        return scalar(body["name"], [expression(a, cx) for a in body["args"]], body["args"], cx.compat)
    if kind == "FunctionCall":
        return aggregate(body["name"], body["args"], cx)
    if kind == "WindowFunc":
        return window(body, cx)
    if kind == "CaseWhen":
        out = None
        for when, then in body["conditions"]:
            test = _truth(when, cx)
            out = F.when(test, expression(then, cx)) if out is None else out.when(test, expression(then, cx))
        return out if body.get("else_expr") is None else out.otherwise(expression(body["else_expr"], cx))
    if kind == "Subquery":
        return cx.subquery(body, cx.names).scalar()
    raise SqlError(f"the expression {kind} isn't known")


_CONDITIONS = {"And", "Or", "Not", "Comparison", "In", "InSubquery", "Exists", "Between", "Is", "Like"}


def _truth(x: object, cx: Context) -> Column:
    """A CASE condition: a condition, or an expression whose value is true or not 0."""
    return condition(x, cx) if isinstance(x, dict) and next(iter(x)) in _CONDITIONS else expression(x, cx).cast("boolean")


def binary(a: Column, op: str, b: Column, compat: bool) -> Column:
    if op == "Add":
        return a + b
    if op == "Sub":
        return a - b
    if op == "Mul":
        return a * b
    if op == "Div":
        if not compat:
            return a / b
        whole = ("tinyint", "smallint", "int", "bigint")
        return F.when(F.typeof(a).isin(*whole) & F.typeof(b).isin(*whole), (a / b).cast("bigint").cast("double")).otherwise(a / b)
    raise SqlError(f"the operator {op} isn't known")


def scalar(name: str, args: list[Column], raw: list, compat: bool = False) -> Column:
    if name == "Length":
        return F.octet_length(args[0])
    if name == "Concat":
        return F.concat(*[F.coalesce(a.cast("string"), F.lit("NULL")) if compat else a.cast("string") for a in args])
    if name == "DateFormat":
        kind, body = node(raw[1])
        if kind != "Literal":
            raise SqlError("DateFormat needs a literal format")
        return F.date_format(args[0], date_pattern(value(body)))
    if name == "Now":
        return F.current_timestamp()
    if name == "Sha2":
        return F.sha2(args[0], 256)
    if name == "If":
        return F.when(args[0], args[1]).otherwise(args[2])
    if name == "DateDiff":
        return F.datediff(F.to_date(args[0]), F.to_date(args[1]))
    plain = {"Lower": F.lower, "Upper": F.upper, "Abs": F.abs, "Coalesce": F.coalesce, "Replace": F.replace, "IfNull": F.ifnull, "Md5": F.md5}
    if name not in plain:
        raise SqlError(f"the function {name} isn't known")
    return plain[name](*args)


def aggregate(name: str, raw: list, cx: Context) -> Column:
    args = [F.lit(1) if a == "Star" else expression(a, cx) for a in raw]
    if name == "Count":
        return F.count(args[0])
    if name == "Sum":
        return F.coalesce(F.sum(args[0]), F.lit(0)) if cx.compat else F.sum(args[0])
    if name in ("Avg", "Min", "Max"):
        return {"Avg": F.avg, "Min": F.min, "Max": F.max}[name](args[0])
    if name == "GroupConcat":
        separator = value(node(raw[1])[1]) if len(raw) > 1 else ","
        values = F.array_sort(F.collect_list(F.struct(args[0].alias("v"))))
        return F.array_join(F.transform(values, lambda s: s["v"].cast("string")), separator)
    if name == "JsonArrayAgg":
        return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(args[0].alias("v")))), lambda s: s["v"]))
    if name == "JsonObjectAgg":
        entries = F.array_sort(F.collect_list(F.when(args[0].isNotNull(), F.struct(args[0].cast("string").alias("key"), args[1].alias("value")))))
        last = F.filter(entries, lambda e, i: (i + 1 == F.size(entries)) | (F.get(entries, i + 1)["key"] != e["key"]))
        return F.to_json(F.map_from_entries(last), {"ignoreNullFields": "false"})
    raise SqlError(f"the aggregate {name} isn't known")


def ordering(items: list[dict], cx: Context) -> list[Column]:
    out = []
    for item in items:
        e = expression(item["expr"], cx)
        out.append(e.desc_nulls_last() if item.get("order", "Asc") == "Desc" else e.asc_nulls_first())
    return out


def _bound(x: object) -> int:
    kind, body = node(x)
    if kind == "UnboundedPreceding":
        return Window.unboundedPreceding
    if kind == "UnboundedFollowing":
        return Window.unboundedFollowing
    if kind == "CurrentRow":
        return 0
    n = int(value(node(body)[1]))
    return -n if kind == "Preceding" else n


def window(body: dict, cx: Context) -> Column:
    w = Window.partitionBy(*[expression(e, cx) for e in body.get("partition_by", [])])
    if body.get("order_by"):
        w = w.orderBy(*ordering(body["order_by"], cx))
    frame = body.get("frame")
    if frame:
        low, high = _bound(frame["start"]), _bound(frame["end"])
        w = w.rowsBetween(low, high) if frame["units"] == "Rows" else w.rangeBetween(low, high)
    raw = body.get("args", [])
    number = lambda k, default: int(value(node(raw[k])[1])) if len(raw) > k else default
    kind = body["func_type"]
    if kind in ("FirstValue", "LastValue", "Lag", "Lead", "NthValue"):
        e = expression(raw[0], cx)
        if kind == "FirstValue":
            return F.first_value(e).over(w)
        if kind == "LastValue":
            return F.last_value(e).over(w)
        if kind == "NthValue":
            return F.nth_value(e, number(1, 1)).over(w if frame else w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return (F.lag if kind == "Lag" else F.lead)(e, number(1, 1)).over(w)
    if kind == "Ntile":
        return F.ntile(number(0, 1)).over(w).cast("bigint")
    whole = {"RowNumber": F.row_number, "Rank": F.rank, "DenseRank": F.dense_rank}
    if kind in whole:
        return whole[kind]().over(w).cast("bigint")
    share = {"PercentRank": F.percent_rank, "CumeDist": F.cume_dist}
    if kind in share:
        return share[kind]().over(w)
    # Beyond the form's own list: aggregates over a frame.
    return {"Sum": F.sum, "Avg": F.avg, "Min": F.min, "Max": F.max, "Count": F.count}[kind](expression(raw[0], cx)).over(w)


def condition(x: object, cx: Context) -> Column:
    kind, body = node(x)
    if kind in ("And", "Or"):
        a, b = (condition(c, cx) for c in body)
        return a & b if kind == "And" else a | b
    if kind == "Not":
        return ~condition(body, cx)
    if kind == "Comparison":
        left, op, right = body
        a, b = expression(left, cx), expression(right, cx)
        return {"Eq": a == b, "Neq": a != b, "Lt": a < b, "Lte": a <= b, "Gt": a > b, "Gte": a >= b}[op]
    if kind == "In":
        return expression(body[0], cx).isin(*[expression(e, cx) for e in body[1]])
    if kind == "InSubquery":
        return expression(body[0], cx).isin(cx.subquery(body[1], cx.names))
    if kind == "Exists":
        return cx.subquery(body, cx.names).exists()
    if kind == "Between":
        return expression(body[0], cx).between(expression(body[1], cx), expression(body[2], cx))
    if kind == "Is":
        e = expression(body[0], cx)
        return {"Null": e.isNull(), "NotNull": e.isNotNull(), "True": e.eqNullSafe(F.lit(True)), "False": e.eqNullSafe(F.lit(False))}[body[1]]
    if kind == "Like":
        return expression(body[0], cx).like(body[1])
    raise SqlError(f"the condition {kind} isn't known" if kind != "FullTextSearch" else "use Search for full text")
