"""From the MySQL-flavoured dialect to Spark SQL, token by token.

Only what Spark says differently is rewritten; the rest of a query goes to Catalyst as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.codes import date_pattern
from .lexer import SqlError, Token, closing, literal, render, split_at, string_value, tokens

AGGREGATES = {
    "COUNT", "SUM", "AVG", "MIN", "MAX", "GROUP_CONCAT", "JSON_ARRAYAGG", "JSON_OBJECTAGG", "ANY_VALUE", "FIRST", "LAST", "STDDEV", "VARIANCE", "COLLECT_LIST", "COLLECT_SET",
    "APPROX_COUNT_DISTINCT", "PERCENTILE", "PERCENTILE_APPROX", "LISTAGG", "ARRAY_AGG", "GROUPING", "GROUPING_ID", "BOOL_AND", "BOOL_OR", "MEDIAN", "CORR", "MAX_BY", "MIN_BY",
}
_CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW"}


@dataclass
class Scope:
    """What a rewrite needs to know: JSON columns, variables, and the dialect's own switches."""

    json_columns: set[str] = field(default_factory=set)
    variable: Callable[[str], object] = lambda name: None
    compat: bool = False


def rewrite(text: str | list[Token], scope: Scope | None = None) -> str:
    """A query of the dialect as Spark SQL.  ``$n`` become named parameters ``:pn``."""
    return render(_rewrite(tokens(text) if isinstance(text, str) else text, scope or Scope()))


def _sql(text: str) -> list[Token]:
    return [Token("sql", text)]


def _rewrite(parts: list[Token], scope: Scope) -> list[Token]:
    parts = _grouped(parts)
    out: list[Token] = []
    i = 0
    while i < len(parts):
        t = parts[i]
        following = parts[i + 1].text if i + 1 < len(parts) else ""
        if t.kind == "variable":
            out += _sql(literal(scope.variable(t.text)))
        elif t.kind == "param" and t.text[0] == "$":
            out += _sql(f":p{t.text[1:]}")
        elif t.kind == "quoted":
            out.append(Token("quoted", "`" + t.name.replace("`", "``") + "`"))
        elif t.kind == "word" and following == "(" and t.up in _FUNCTIONS and (not i or parts[i - 1].text != "."):
            end = closing(parts, i + 1)
            own = parts[i + 2 : end]
            done = _FUNCTIONS[t.up](own, scope, parts[end + 1 : end + 2])
            out += done
            i = end
        elif t.up == "INFORMATION_SCHEMA" and following == ".":
            out += _sql(f"information_schema__{parts[i + 2].name.lower()}")
            i += 2
        elif t.kind in ("word", "quoted") and following == "." and (not i or parts[i - 1].text != "."):
            chain = [t]
            while i + 2 < len(parts) and parts[i + 1].text == "." and parts[i + 2].kind in ("word", "quoted"):
                chain.append(parts[i + 2])
                i += 2
            out += _path(chain, scope)
        elif t.text == "/" and scope.compat:
            i = _whole_division(parts, i, out, scope)
        else:
            out.append(t)
        i += 1
    return out


def _path(chain: list[Token], scope: Scope) -> list[Token]:
    """``column.key...`` and ``table.column.key...`` of JSON columns."""
    names = [t.name for t in chain]
    quote = lambda xs: ".".join(f"`{x}`" for x in xs)
    for k in (1, 2):
        if len(names) > k and names[k - 1] in scope.json_columns and (k == 2 or names[0] in scope.json_columns):
            return _sql(f"get_json_object({quote(names[:k])}, {literal('$.' + '.'.join(names[k:]))})")
    return _sql(".".join("*" if t.text == "*" else f"`{t.name}`" for t in chain))


def _whole_division(parts: list[Token], i: int, out: list[Token], scope: Scope) -> int:
    """Integers divide to integers: ``a / b`` of simple operands."""
    left = [out.pop()]
    if left[0].text == ")":
        depth = 1
        while depth:
            left.insert(0, out.pop())
            depth += (left[0].text == ")") - (left[0].text == "(")
        if out and out[-1].kind == "word" and out[-1].up not in ("IN", "AND", "OR", "SELECT"):
            left.insert(0, out.pop())
    j = i + 1
    right = [parts[j]]
    if j + 1 < len(parts) and parts[j + 1].text == "(" and parts[j].kind == "word":
        end = closing(parts, j + 1)
        right, j = parts[j : end + 1], end
    elif parts[j].text == "(":
        end = closing(parts, j)
        right, j = parts[j : end + 1], end
    else:
        while j + 2 < len(parts) and parts[j + 1].text == ".":
            right += parts[j + 1 : j + 3]
            j += 2
    a, b = render(left), render(_rewrite(right, scope))
    kinds = "('tinyint', 'smallint', 'int', 'bigint')"
    out += _sql(f"if(typeof({a}) in {kinds} and typeof({b}) in {kinds}, cast(({a}) / ({b}) as bigint), ({a}) / ({b}))")
    return j


# Functions ------------------------------------------------------------------------------

_Own = Callable[[list[Token], Scope, list[Token]], list[Token]]


def _args(own: list[Token], scope: Scope) -> list[str]:
    return [render(_rewrite(a, scope)) for a in split_at(own)]


def _group_concat(own: list[Token], scope: Scope, _after: list[Token]) -> list[Token]:
    distinct = bool(own) and own[0].up == "DISTINCT"
    own = own[distinct:]
    separator = "','"
    depth = 0
    order: list[Token] = []
    for i, t in enumerate(own):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.up == "SEPARATOR":
            separator, own = own[i + 1].text, own[:i]
            break
    for i, t in enumerate(own):
        if t.up == "ORDER" and i + 1 < len(own) and own[i + 1].up == "BY":
            own, order = own[:i], own[i + 2 :]
            break
    args = split_at(own)
    value = render(_rewrite(args[0], scope))
    if len(args) > 1:
        separator = render(_rewrite(args[1], scope))
    by = render(_rewrite(order, scope)) if order else f"cast({value} as string)" if distinct else value
    out = f"listagg({'distinct ' * distinct}cast({value} as string), {separator}) within group (order by {by})"
    return _sql(f"coalesce({out}, '')" if scope.compat else out)


def _json_arrayagg(own: list[Token], scope: Scope, _after: list[Token]) -> list[Token]:
    (value,) = _args(own, scope)
    return _sql(f"to_json(transform(array_sort(collect_list(named_struct('v', {value}))), s -> s.v))")


def _json_objectagg(own: list[Token], scope: Scope, _after: list[Token]) -> list[Token]:
    key, value = _args(own, scope)
    entries = f"array_sort(collect_list(named_struct('key', cast({key} as string), 'value', {value})) filter (where {key} is not null))"
    last = f"filter({entries}, (e, i) -> i + 1 = size({entries}) or get({entries}, i + 1).key <> e.key)"
    return _sql(f"to_json(map_from_entries({last}), map('ignoreNullFields', 'false'))")


def _date_format(own: list[Token], scope: Scope, _after: list[Token]) -> list[Token]:
    args = split_at(own)
    if len(args) != 2 or len(args[1]) != 1 or args[1][0].kind != "string":
        raise SqlError("DATE_FORMAT needs a literal format")
    return _sql(f"date_format({render(_rewrite(args[0], scope))}, {literal(date_pattern(string_value(args[1][0])))})")


def _concat(own: list[Token], scope: Scope, _after: list[Token]) -> list[Token]:
    args = _args(own, scope)
    return _sql("concat(" + ", ".join(f"coalesce(cast({a} as string), 'NULL')" if scope.compat else a for a in args) + ")")


def _sum(own: list[Token], scope: Scope, after: list[Token]) -> list[Token]:
    inner = f"sum({render(_rewrite(own, scope))})"
    return _sql(f"coalesce({inner}, 0)" if scope.compat and not (after and after[0].up in ("OVER", "FILTER")) else inner)


_FUNCTIONS: dict[str, _Own] = {
    "GROUP_CONCAT": _group_concat,
    "JSON_ARRAYAGG": _json_arrayagg,
    "JSON_OBJECTAGG": _json_objectagg,
    "DATE_FORMAT": _date_format,
    "CONCAT": _concat,
    "SUM": _sum,
    "LENGTH": lambda own, scope, _: _sql(f"octet_length({', '.join(_args(own, scope))})"),
    "SHA2": lambda own, scope, _: _sql(f"sha2({_args(own, scope)[0]}, 256)"),
    "DATEDIFF": lambda own, scope, _: _sql("datediff({}, {})".format(*[f"to_date({a})" for a in _args(own, scope)])),
}


# Plain columns beside aggregates ----------------------------------------------------------


def _has_aggregate(parts: list[Token]) -> bool:
    """Whether an aggregate is called outside brackets of a subquery, and not over a window."""
    i = 0
    while i < len(parts):
        if parts[i].text == "(" and i + 1 < len(parts) and parts[i + 1].up in ("SELECT", "WITH"):
            i = closing(parts, i)
        elif parts[i].up in AGGREGATES and i + 1 < len(parts) and parts[i + 1].text == "(":
            end = closing(parts, i + 1)
            if not (end + 1 < len(parts) and parts[end + 1].up == "OVER"):
                return True
            i = end
        i += 1
    return False


def _has_window(parts: list[Token]) -> bool:
    return any(t.up == "OVER" for t in parts)


def _grouped(parts: list[Token]) -> list[Token]:
    """In a SELECT with GROUP BY, wrap columns that are neither grouped nor aggregated in any_value."""
    out, i = [], 0
    while i < len(parts):
        if parts[i].up != "SELECT":
            out.append(parts[i])
            i += 1
            continue
        head, places, depth, j = i + 1, {}, 0, i + 1
        while j < len(parts):
            depth += (parts[j].text == "(") - (parts[j].text == ")")
            if depth < 0:
                break
            if not depth and parts[j].up in _CLAUSES:
                if parts[j].up in ("UNION", "INTERSECT", "EXCEPT"):
                    break
                places.setdefault(parts[j].up, j)
            j += 1
        if "GROUP" not in places or "FROM" not in places:
            out.append(parts[i])
            i += 1
            continue
        stop = min([p for c, p in places.items() if p > places["GROUP"] and c != "GROUP"], default=j)
        keys = parts[places["GROUP"] + 2 : stop]
        extended = any(t.up in ("ROLLUP", "CUBE", "SETS", "ALL") for t in keys)
        grouped = [render(k).lower() for k in split_at(keys)]
        select = parts[head : places["FROM"]]
        distinct = bool(select) and select[0].up in ("DISTINCT", "ALL")
        items = []
        for n, item in enumerate(split_at(select[distinct:]), 1):
            items.append(item if extended or str(n) in grouped else _any_value(item, grouped))
        out += [parts[i], *select[:distinct]]
        for n, item in enumerate(items):
            out += [Token("sign", ",")] * (n > 0) + item
        i = places["FROM"]
    return out


def _any_value(item: list[Token], grouped: list[str]) -> list[Token]:
    alias: list[Token] = []
    body = item
    if len(item) > 2 and item[-2].up == "AS":
        body, alias = item[:-2], item[-2:]
    elif len(item) > 1 and item[-1].kind in ("word", "quoted") and item[-2].kind in ("word", "quoted", "number", "string") and item[-2].up not in ("NOT", "AND", "OR", "END") or len(item) > 1 and item[-2].text == ")" and item[-1].kind in ("word", "quoted"):
        body, alias = item[:-1], item[-1:]
    text = render(body).lower()
    named = alias[-1].name.lower() if alias else ""
    bare = [g.rpartition(".")[2] for g in grouped]
    simple = all(t.kind in ("word", "quoted") or t.text == "." for t in body)
    if text in grouped or named in grouped or simple and text.rpartition(".")[2] in bare:
        return item
    if _has_aggregate(body) or _has_window(body) or not any(t.kind in ("word", "quoted") for t in body) or any(t.up in ("SELECT", "TRUE", "FALSE", "NULL") for t in body):
        return item
    # An expression of grouped parts only needs nothing.
    words = {t.name.lower() for i, t in enumerate(body) if t.kind in ("word", "quoted") and not (i + 1 < len(body) and body[i + 1].text in ("(", "."))}
    if not simple and words <= {w for g in bare for w in [g]}:
        return item
    if not simple and any(g in text for g in grouped):
        return item
    wrapped = [Token("word", "any_value"), Token("sign", "("), *body, Token("sign", ")")]
    return wrapped + (alias or ([Token("word", "AS"), body[-1]] if simple else []))
