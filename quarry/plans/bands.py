"""Joins on a range: ``a.x < b.y AND b.y - a.x < c`` as an equality of bins, which Spark can deal out.

Without it rows meet by the other equalities alone: every pair of a group is compared, where few go on.
"""

from __future__ import annotations

from collections.abc import Callable

from .lexer import Token, split_at

_AFTER = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "WINDOW"}
_NOT_HERE = {"OR", "BETWEEN", "CASE", "UNION", "INTERSECT", "EXCEPT", "WITH", "USING", "JOIN"}
#: Bins to a range.  A row of the lower side is put into one more; pairs that meet in vain are a fifth.
BINS = 5
#: Numbers whose differences are never less by rounding than a range that they reach.
_NUMBERS = {"double", "int", "smallint", "tinyint"}


def binned(parts: list[Token], kind_of: Callable[[str, str], str | None]) -> tuple[list[Token], str] | None:
    """An inner join of two tables by a range, with bins: its tokens and the binned side's name, which a
    hint has to make a shuffled join.  ``kind_of``: the type of a table's column.  None: it isn't one.

    A pair has a.x < b.y <= a.x + c even as doubles are rounded, and division and floor keep order: the
    bin of b.y is exactly one of those from a.x's to that of a.x + c.  The condition itself is kept."""
    words = [t.up for t in parts]
    if not words or words[0] != "SELECT" or words.count("SELECT") != 1 or words.count("FROM") != 1 or words.count("JOIN") != 1 or words.count("ON") != 1:
        return None
    if any(t.text == "*" and (parts[i - 1].text in (",", ".") or parts[i - 1].up in ("SELECT", "DISTINCT", "ALL")) for i, t in enumerate(parts)):
        return None  # the bin would be among the columns
    start, join, on = words.index("FROM"), words.index("JOIN"), words.index("ON")
    first, second = parts[start + 1 : join], parts[join + 1 : on]
    if first and first[-1].up == "INNER":
        first = first[:-1]
    names = [[t for t in side if t.up != "AS"] for side in (first, second)]
    if any(len(n) not in (1, 2) or any(t.kind not in ("word", "quoted") for t in n) for n in names):
        return None
    tables = {n[-1].name: n[0] for n in names}
    end = next((i for i in range(on, len(parts)) if words[i] in _AFTER), len(parts))
    if len(tables) != 2 or _NOT_HERE & set(words[on + 1 : end]):
        return None
    terms = split_at(parts[on + 1 : end], "AND")
    column = lambda x: (x[0].name, x[2].name) if len(x) == 3 and x[1].text == "." and x[0].name in tables else None
    less = {(column(t[:3]), column(t[4:])) for t in terms if len(t) == 7 and t[3].text == "<"}
    for t in terms:
        if len(t) != 9 or t[3].text != "-" or t[7].text != "<" or t[8].kind != "number":
            continue
        high, low, most = column(t[:3]), column(t[4:7]), float(t[8].text)
        if not high or not low or high[0] == low[0] or (low, high) not in less or not 0 < most < float("inf"):
            continue
        if any(kind_of(tables[a].name, c) not in _NUMBERS for a, c in (low, high)):
            continue
        width = most / BINS
        if not width:
            continue
        own = "`" + low[1].replace("`", "``") + "`"
        bin_of = lambda x: f"floor(({x}) / CAST('{width!r}' AS DOUBLE))"
        side = Token("sql", f"(SELECT *, explode(sequence({bin_of(f'CAST({own} AS DOUBLE)')}, {bin_of(f"CAST({own} AS DOUBLE) + CAST('{most!r}' AS DOUBLE)")})) AS `_band` FROM `{tables[low[0]].name}`) `{low[0]}`")
        held = Token("sql", f"AND `{low[0]}`.`_band` = {bin_of(f'CAST(`{high[0]}`.`{high[1]}` AS DOUBLE)')}")
        left, right = ([side] if names[k][-1].name == low[0] else x for k, x in enumerate((first, second)))
        return [*parts[: start + 1], *left, Token("word", "JOIN"), *right, *parts[on:end], held, *parts[end:]], low[0]
    return None
