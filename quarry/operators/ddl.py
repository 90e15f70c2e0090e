"""Definitions: parsing of CREATE TABLE and ALTER TABLE parts, and their effects."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans.lexer import SqlError, Token, closing, render, split_at, string_value
from ..sources.catalog import Catalog, CatalogError, Column, ForeignKey, Index, Table
from .dml import ConstraintError, check_foreign, check_unique, check_values


def parse_column(parts: list[Token]) -> tuple[Column, bool, ForeignKey | None]:
    """A column's definition, whether it is the primary key, and its own foreign key."""
    if len(parts) < 2:
        raise SqlError("a column needs a name and a type")
    name, kind, i = parts[0].name, parts[1].up, 2
    arguments: list[str] = []
    if i < len(parts) and parts[i].text == "(":
        end = closing(parts, i)
        arguments = [string_value(a[0]) if a[0].kind == "string" else a[0].text for a in split_at(parts[i + 1 : end])]
        i = end + 1
    col = Column(name, kind, tuple(arguments), auto=kind == "SERIAL", not_null=False)
    primary, foreign = False, None
    while i < len(parts):
        word, after = parts[i].up, parts[i + 1].up if i + 1 < len(parts) else ""
        if word == "UNSIGNED":
            col = replace(col, unsigned=True)
        elif word == "NOT" and after == "NULL":
            col, i = replace(col, not_null=True), i + 1
        elif word == "DEFAULT":
            default, i = _default(parts, i + 1)
            col = replace(col, default=default)
            continue
        elif word in ("AUTO_INCREMENT", "AUTOINCREMENT"):
            col = replace(col, auto=True)
        elif word == "PRIMARY":
            primary, i = True, i + 1
        elif word == "REFERENCES":
            end = closing(parts, i + 2)
            foreign = ForeignKey(f"fk_{name}", (name,), parts[i + 1].name, tuple(p[0].name for p in split_at(parts[i + 3 : end])))
            i = end
        elif word == "ON" and after in ("DELETE", "UPDATE"):
            i += 2
        elif word in ("COMMENT", "COLLATE"):
            i += 1
        elif word == "CHARACTER":
            i += 2
        i += 1
    col.type  # noqa: B018  an unknown type is an error here
    return col, primary, foreign


def _default(parts: list[Token], i: int) -> tuple[str, int]:
    start = i
    if parts[i].text == "-":
        i += 1
    if i + 1 < len(parts) and parts[i + 1].text == "(" and parts[i].kind == "word":
        i = closing(parts, i + 1)
    return render(parts[start : i + 1]), i + 1


def names_in(parts: list[Token], start: int) -> tuple[list[str], int]:
    """The names between brackets, and the place after them."""
    end = closing(parts, start)
    return [p[0].name for p in split_at(parts[start + 1 : end])], end + 1


def parse_foreign(parts: list[Token], i: int, name: str | None, table: str) -> ForeignKey:
    """FOREIGN KEY (a) REFERENCES t (b), from the word FOREIGN."""
    columns, i = names_in(parts, i + 2)
    if parts[i].up != "REFERENCES":
        raise SqlError("a foreign key needs REFERENCES")
    parent = parts[i + 1].name
    parents, _ = names_in(parts, i + 2)
    return ForeignKey(name or f"fk_{table}_{'_'.join(columns)}", tuple(columns), parent, tuple(parents))


def parse_table(name: str, body: list[Token]) -> Table:
    columns: list[Column] = []
    primary: list[str] = []
    foreign: list[ForeignKey] = []
    indexes: list[Index] = []
    for part in split_at(body):
        word, i, label = part[0].up, 0, None
        if word == "CONSTRAINT":
            label, i = part[1].name, 2
            word = part[2].up
        if word == "PRIMARY":
            primary, _ = names_in(part, i + 2)
        elif word == "FOREIGN":
            foreign.append(parse_foreign(part, i, label, name))
        elif word in ("UNIQUE", "KEY", "INDEX") and i + 1 < len(part) and part[i + 1].kind != "string" and not (len(part) > 1 and part[i + 1].up in ("INT", "TEXT")):
            i += 1
            if word == "UNIQUE" and part[i].up in ("KEY", "INDEX"):
                i += 1
            if part[i].text != "(":
                label, i = part[i].name, i + 1
            own, _ = names_in(part, i)
            indexes.append(Index(label or f"{'uq' if word == 'UNIQUE' else 'ix'}_{name}_{'_'.join(own)}", tuple(f"`{c}`" for c in own), word == "UNIQUE"))
        else:
            col, is_primary, own_key = parse_column(part)
            if any(c.name == col.name for c in columns):
                raise SqlError(f"the column {col.name} is given twice")
            columns.append(col)
            if is_primary:
                primary = [col.name]
            if own_key:
                foreign.append(replace(own_key, name=f"fk_{name}_{col.name}"))
            if any(t.up == "UNIQUE" for t in part[2:]):
                indexes.append(Index(f"uq_{name}_{col.name}", (f"`{col.name}`",), True))
    if primary:
        indexes.insert(0, Index(f"pk_{name}", tuple(f"`{c}`" for c in primary), True))
    table = Table(name, tuple(columns), tuple(primary), tuple(foreign), tuple(indexes))
    for c in [*primary, *[c for f in foreign for c in f.columns]]:
        table.column(c)
    return table


def create_table(catalog: Catalog, table: Table, if_not_exists: bool = False) -> None:
    if table.name in catalog.state.tables or table.name in catalog.state.views:
        if if_not_exists:
            return
        raise CatalogError(f"{table.name} exists")
    for f in table.foreign_keys:
        parent = table if f.parent == table.name else catalog.table(f.parent)
        for c in f.parent_columns:
            parent.column(c)
    catalog.put_rows(table, catalog.spark.createDataFrame([], table.schema))


def drop_table(catalog: Catalog, name: str, if_exists: bool = False) -> None:
    if catalog.state.tables.pop(name, None) is None:
        if not if_exists:
            raise CatalogError(f"there is no table {name}")
        return
    catalog.state.materialized.pop(name, None)


def create_index(catalog: Catalog, table: str, index: Index) -> None:
    """A unique index is a constraint, checked at once and at every write; others describe."""
    t = catalog.table(table)
    if any(i.name == index.name for i in t.indexes):
        raise CatalogError(f"the index {index.name} exists")
    t.rows.select(*[F.expr(e) for e in index.expressions], *([F.expr(index.where)] if index.where else [])).limit(0).collect()
    changed = replace(t, indexes=(*t.indexes, index))
    if index.unique:
        check_unique(replace(changed, primary_key=(), indexes=(index,)), t.rows, None)
    catalog.put(changed)


def drop_index(catalog: Catalog, name: str, table: str | None = None) -> None:
    for t in list(catalog.state.tables.values()):
        if (table is None or t.name == table) and any(i.name == name for i in t.indexes):
            catalog.put(replace(t, indexes=tuple(i for i in t.indexes if i.name != name)))
            return
    raise CatalogError(f"there is no index {name}")


def alter_table(catalog: Catalog, name: str, parts: list[Token]) -> None:
    """One action, from its first word."""
    t = catalog.table(name)
    words = [p.up for p in parts]
    skip = lambda i: i + (words[i : i + 1] == ["COLUMN"])
    if words[0] == "ADD" and words[1] == "PRIMARY":
        columns, _ = names_in(parts, 3)
        changed = replace(t, primary_key=tuple(columns), indexes=(Index(f"pk_{name}", tuple(f"`{c}`" for c in columns), True), *t.indexes))
        if t.primary_key:
            raise CatalogError(f"{name} has a primary key")
        check_values(changed, t.rows)
        check_unique(changed, t.rows, None)
        catalog.put(changed)
    elif words[0] == "DROP" and words[1] == "PRIMARY":
        catalog.put(replace(t, primary_key=(), indexes=tuple(i for i in t.indexes if i.name != f"pk_{name}")))
    elif words[0] == "ADD" and words[1] in ("FOREIGN", "CONSTRAINT"):
        label, i = (parts[2].name, 3) if words[1] == "CONSTRAINT" else (None, 1)
        changed = replace(t, foreign_keys=(*t.foreign_keys, parse_foreign(parts, i, label, name)))
        check_foreign(catalog, changed, t.rows)
        catalog.put(changed)
    elif words[0] == "DROP" and words[1] in ("FOREIGN", "CONSTRAINT"):
        label = parts[3 if words[1] == "FOREIGN" else 2].name
        if not any(f.name == label for f in t.foreign_keys):
            raise CatalogError(f"there is no foreign key {label}")
        catalog.put(replace(t, foreign_keys=tuple(f for f in t.foreign_keys if f.name != label)))
    elif words[0] == "ADD":
        col, _, own_key = parse_column(parts[skip(1) :])
        if any(c.name == col.name for c in t.columns):
            raise CatalogError(f"{name}.{col.name} exists")
        value = F.expr(col.default) if col.default is not None else F.lit(None)
        changed = replace(t, columns=(*t.columns, col), foreign_keys=t.foreign_keys + ((own_key,) if own_key else ()))
        rows = t.rows.withColumn(col.name, value.cast(col.type))
        check_values(changed, rows)
        catalog.put_rows(changed, rows)
    elif words[0] == "DROP":
        gone = parts[skip(1)].name
        t.column(gone)
        if gone in t.primary_key or any(gone in f.columns for f in t.foreign_keys):
            raise CatalogError(f"{name}.{gone} is part of a key")
        quoted = f"`{gone}`"
        catalog.put_rows(replace(t, columns=tuple(c for c in t.columns if c.name != gone), indexes=tuple(i for i in t.indexes if quoted not in i.expressions)), t.rows.drop(gone))
    elif words[0] == "RENAME" and words[1] == "TO":
        _rename_table(catalog, t, parts[2].name)
    elif words[0] == "RENAME":
        i = skip(1)
        _rename_column(catalog, t, parts[i].name, parts[i + 2].name)
    elif words[0] in ("MODIFY", "CHANGE"):
        i = skip(1)
        if words[0] == "CHANGE":
            old = parts[i].name
            if parts[i + 1].name != old:
                _rename_column(catalog, t, old, parts[i + 1].name)
                t = catalog.table(name)
            i += 1
        col, _, _ = parse_column(parts[i:])
        before = t.column(col.name)
        changed = replace(t, columns=tuple(replace(col, auto=col.auto or before.auto) if c.name == col.name else c for c in t.columns))
        rows = t.rows.withColumn(col.name, F.col(f"`{col.name}`").cast(col.type))
        check_values(changed, rows)
        catalog.put_rows(changed, rows)
    elif words[0] == "ALTER":
        i = skip(1)
        column, action = parts[i].name, words[i + 1 : i + 4]
        old = t.column(column)
        if action[:2] == ["SET", "DEFAULT"]:
            new = replace(old, default=render(parts[i + 3 :]))
        elif action[:2] == ["DROP", "DEFAULT"]:
            new = replace(old, default=None)
        elif action == ["SET", "NOT", "NULL"]:
            new = replace(old, not_null=True)
        elif action == ["DROP", "NOT", "NULL"]:
            new = replace(old, not_null=False)
        else:
            raise SqlError("not an ALTER COLUMN action")
        changed = replace(t, columns=tuple(new if c.name == column else c for c in t.columns))
        check_values(changed, t.rows)
        catalog.put(changed)
    elif words[0] not in ("ENGINE", "DEFAULT", "CHARACTER", "CHARSET", "COLLATE", "CONVERT"):
        raise SqlError(f"not an ALTER TABLE action: {render(parts)}")


def _rename_table(catalog: Catalog, t: Table, to: str) -> None:
    if to in catalog.state.tables:
        raise CatalogError(f"{to} exists")
    del catalog.state.tables[t.name]
    indexes = tuple(replace(i, name=f"pk_{to}") if i.name == f"pk_{t.name}" else i for i in t.indexes)
    catalog.put(replace(t, name=to, indexes=indexes))
    for other in list(catalog.state.tables.values()):
        if any(f.parent == t.name for f in other.foreign_keys):
            catalog.put(replace(other, foreign_keys=tuple(replace(f, parent=to) if f.parent == t.name else f for f in other.foreign_keys)))


def _rename_column(catalog: Catalog, t: Table, old: str, new: str) -> None:
    t.column(old)
    if any(c.name == new for c in t.columns):
        raise CatalogError(f"{t.name}.{new} exists")
    swap = lambda xs: tuple(new if x == old else x for x in xs)
    changed = replace(
        t,
        columns=tuple(replace(c, name=new) if c.name == old else c for c in t.columns),
        primary_key=swap(t.primary_key),
        foreign_keys=tuple(replace(f, columns=swap(f.columns)) for f in t.foreign_keys),
        indexes=tuple(replace(i, expressions=tuple(e.replace(f"`{old}`", f"`{new}`") for e in i.expressions)) for i in t.indexes),
    )
    catalog.put_rows(changed, t.rows.withColumnRenamed(old, new))


__all__ = ["ConstraintError", "alter_table", "create_index", "create_table", "drop_index", "drop_table", "parse_table"]
