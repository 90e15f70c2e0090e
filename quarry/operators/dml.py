"""Writing rows: constraints are joins and aggregations against the touched keys; a change is a new version.

Rows that are added are written once, beside the files that are there; a change of rows rewrites the
files that hold one of them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Table


class ConstraintError(ValueError):
    """Rows that a table's constraints don't allow."""


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Expr:
    return reduce(lambda x, y: x & y, [a[x] == b[y] for x, y in pairs])


def conform(table: Table, rows: DataFrame, given: list[str]) -> DataFrame:
    """Rows with all columns of the table: values cast, those not given by default or null."""
    out = []
    for c in table.columns:
        if c.name in given:
            value = F.col(f"`{rows.columns[given.index(c.name)]}`")
        else:
            value = F.expr(c.default) if c.default is not None else F.lit(None)
        out.append(value.cast(c.type).alias(c.name))
    return rows.select(*out)


def fill_counters(table: Table, rows: DataFrame) -> tuple[DataFrame, int]:
    """Null auto-increment values get the next numbers, in the order of the rows' own numbers."""
    auto = [c.name for c in table.columns if c.auto]
    counter = table.counter
    for name in auto:
        # Ranges of the batch are numbered apart, and one row a range gives where each begins.
        marked = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id())
        missing = F.col(name).isNull()
        sizes = marked.filter(missing).groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
        base = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
        rank = F.row_number().over(Window.partitionBy("_p", missing).orderBy("_n"))
        numbered = marked.withColumn("_r", rank).join(base, "_p", "left")
        rows = numbered.withColumn(name, F.when(missing, F.lit(counter) + F.col("_b") + F.col("_r")).otherwise(F.col(name)).cast(table.column(name).type)).select(*rows.columns)
        # Numbers that a statement gives itself count too, so that a later one can't repeat them.
        top = rows.agg(F.max(name)).first()[0]
        counter = max(counter, int(top or 0))
    return rows, counter


def check_values(table: Table, rows: DataFrame) -> None:
    """NOT NULL, ENUM, SET: one aggregation finds the first rule that is broken."""
    rules: list[tuple[str, Expr]] = []
    for c in table.columns:
        if c.not_null or c.name in table.primary_key:
            rules.append((f"{table.name}.{c.name} may not be null", F.col(c.name).isNull()))
        if c.kind == "ENUM":
            rules.append((f"{table.name}.{c.name} must be one of {', '.join(c.arguments)}", ~F.lower(c.name).isin(*[a.lower() for a in c.arguments])))
        if c.kind == "SET":
            allowed = F.array(*[F.lit(a.lower()) for a in c.arguments])
            rules.append((f"{table.name}.{c.name} must hold members of {', '.join(c.arguments)}", (F.col(c.name) != "") & (F.size(F.array_except(F.split(F.lower(c.name), ","), allowed)) > 0)))
        if c.unsigned:
            rules.append((f"{table.name}.{c.name} may not be negative", F.col(c.name) < 0))
    if rules:
        broken = rows.agg(*[F.max(F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, (_, rule) in enumerate(rules)]).first()
        for i, (what, _) in enumerate(rules):
            if broken[i]:
                raise ConstraintError(what)


def unique_keys(table: Table) -> list[tuple[str, list[Expr], Expr | None]]:
    """(name, key expressions, condition) of the primary key and unique indexes."""
    out = [(f"pk_{table.name}", [F.col(f"`{c}`") for c in table.primary_key], None)] if table.primary_key else []
    for i in table.indexes:
        if i.unique and i.name != f"pk_{table.name}":
            out.append((i.name, [F.expr(e) for e in i.expressions], F.expr(i.where) if i.where else None))
    return out


def check_unique(table: Table, fresh: DataFrame, old: DataFrame | None) -> None:
    """No key of ``fresh`` twice, nor among ``old`` rows; keys with nulls may repeat."""
    for name, keys, where in unique_keys(table):
        named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        cut = lambda df: (df if where is None else df.filter(where)).select(*named).dropna()  # noqa: B023, E731
        new = cut(fresh)
        names = [f"k{i}" for i in range(len(keys))]
        twice = new.groupBy(*names).count().filter("count > 1").limit(1)
        if not twice.isEmpty() or (old is not None and not new.join(cut(old), names, "left_semi").limit(1).isEmpty()):
            raise ConstraintError(f"a key of {name} would repeat")


def check_foreign(catalog: Catalog, table: Table, rows: DataFrame) -> None:
    """Every foreign key without nulls has its parent."""
    for f in table.foreign_keys:
        parent = catalog.table(f.parent).rows if f.parent != table.name else (table.rows.unionByName(rows) if table.rows is not None else rows)
        a = rows.select(*[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(f.columns)]).dropna()
        b = parent.select(*[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(f.parent_columns)])
        if not a.join(b, _same(a, b, [(f"a{i}", f"b{i}") for i in range(len(f.columns))]), "left_anti").limit(1).isEmpty():
            raise ConstraintError(f"{table.name}.{', '.join(f.columns)} must be in {f.parent}")


def matches_any_key(table: Table, rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Rows that do (left_semi) or don't (left_anti) share a unique key with ``other``."""
    if how == "left_anti":
        for _, keys, where in unique_keys(table):
            rows = _by_key(rows, other, keys, where, "left_anti")
        return rows
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    found = reduce(DataFrame.union, [_by_key(marked, other, keys, where, "left_semi").select("_row") for _, keys, where in unique_keys(table)])
    return marked.join(found.distinct(), "_row", "left_semi").drop("_row")


def _by_key(rows: DataFrame, other: DataFrame, keys: list[Expr], where: Expr | None, how: str) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    held = (other if where is None else other.filter(where)).select(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    mine = rows.withColumns({f"{n}x": (k if where is None else F.when(where, k)) for k, n in zip(keys, names, strict=True)})
    return mine.join(held, _same(mine, held, [(f"{n}x", n) for n in names]), how).drop(*[f"{n}x" for n in names])


def insert(catalog: Catalog, table: Table, rows: DataFrame, given: list[str] | None = None, mode: str = "plain", update: dict[str, str] | None = None) -> int:
    """Add rows; returns how many rows were added or changed.

    mode: plain (a repeated key is an error), ignore (such rows are left out), replace (they take
    the old rows' place).  ``update``: for repeated keys, the old row's columns by SQL over the old
    row, ``VALUES(c)`` written ``new.c``."""
    fresh, path = catalog.store(conform(table, rows, given or [c.name for c in table.columns]), f"{table.name}-batch")
    fresh, counter = fill_counters(table, fresh)
    if any(c.auto for c in table.columns):
        fresh, path = catalog.store(fresh, f"{table.name}-batch")
    check_values(table, fresh)
    old, touched, rest = table.rows, [], None
    keyed = bool(unique_keys(table))
    changed = 0
    if keyed and mode in ("ignore", "replace"):
        # Of the batch's own repeated keys the first (ignore) or the last (replace) counts.
        fresh = fresh.withColumn("_at", F.monotonically_increasing_id())
        for _, keys, where in unique_keys(table):
            order = F.col("_at").asc() if mode == "ignore" else F.col("_at").desc()
            nulls = reduce(lambda a, b: a | b, [k.isNull() for k in keys])
            skip = nulls if where is None else nulls | ~F.coalesce(where, F.lit(False))
            rank = F.row_number().over(Window.partitionBy(*keys, F.when(skip, F.col("_at"))).orderBy(order))
            fresh = fresh.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
        fresh = fresh.drop("_at")
        if mode == "ignore":
            fresh = matches_any_key(table, fresh, old, "left_anti")
        fresh, path = catalog.store(fresh, f"{table.name}-batch")
        if mode == "replace":
            placed = catalog.with_files(table)
            touched = _files_of(matches_any_key(table, placed, fresh, "left_semi"))
            rest = matches_any_key(table, _inside(placed, touched), fresh, "left_anti")
    elif keyed and update:
        check_unique(table, fresh, None)
        meets, _ = catalog.store(matches_any_key(table, fresh, old, "left_semi"), f"{table.name}-batch")
        changed = meets.count()
        if changed:
            placed = catalog.with_files(table)
            touched = _files_of(matches_any_key(table, placed, meets, "left_semi"))
            rest = _updated_by_key(table, _inside(placed, touched), meets, update)
            fresh, path = catalog.store(matches_any_key(table, fresh, meets, "left_anti"), f"{table.name}-batch")
            check_values(table, rest)
            check_unique(table, _updated_by_key(table, old, meets, update).unionByName(fresh), None)
            check_foreign(catalog, table, rest)
    else:
        check_unique(table, fresh, old)
    check_foreign(catalog, table, fresh)
    count = fresh.count()
    if touched:
        catalog.put_files(table, touched, rest, ((path, 0),), counter=counter)
    elif count:
        catalog.add_rows(table, path, counter=counter)
    return count + changed


def _files_of(rows: DataFrame) -> list[str]:
    """The files that rows are in: one name a file."""
    return [r["_file"] for r in rows.select("_file").distinct().collect()]


def _inside(rows: DataFrame, files: list[str]) -> DataFrame:
    return rows.filter(F.col("_file").isin(*files) if files else F.lit(False))


def _updated_by_key(table: Table, old: DataFrame, fresh: DataFrame, update: dict[str, str]) -> DataFrame:
    """Old rows that meet a new one by a key, changed by expressions over both."""
    out = old
    names = [c.name for c in table.columns]
    for _, keys, where in unique_keys(table):
        side = fresh.select(*[(k if where is None else F.when(where, k)).alias(f"_n{i}") for i, k in enumerate(keys)], F.struct(*fresh.columns).alias("new"))
        mine = out.withColumns({f"_o{i}": (k if where is None else F.when(where, k)) for i, k in enumerate(keys)})
        both = mine.join(side, _same(mine, side, [(f"_o{i}", f"_n{i}") for i in range(len(keys))]), "left")
        out = both.select(*[(F.when(F.col("new").isNotNull(), F.expr(update[n])).otherwise(F.col(f"`{n}`")).cast(table.column(n).type) if n in update else F.col(f"`{n}`")).alias(n) for n in names])
    return out


def _hits(catalog: Catalog, table: Table, where: Expr | None) -> tuple[DataFrame, list[str], int]:
    """The rows marked by whether a change is for them, the files with such rows, and their number."""
    marked = catalog.with_files(table).withColumn("_hit", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    found = marked.filter("_hit").groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file
    return marked, [r["_file"] for r in found], sum(r["n"] for r in found)


def update(catalog: Catalog, table: Table, changes: dict[str, Expr], where: Expr | None) -> int:
    """Change rows in place: expressions see the old row."""
    marked, touched, count = _hits(catalog, table, where)
    if not count:
        return 0
    new = marked.select("_hit", "_file", *[(F.when(F.col("_hit"), changes[c.name]).otherwise(F.col(f"`{c.name}`")).cast(c.type) if c.name in changes else F.col(f"`{c.name}`")).alias(c.name) for c in table.columns])
    check_values(table, new.filter("_hit"))
    keys = {c for _, ks, _ in unique_keys(table) for c in changes if any(c in str(k) for k in ks)}
    if keys:
        check_unique(table, new, None)
    if any(set(f.columns) & set(changes) for f in table.foreign_keys):
        plain = new.drop("_hit", "_file")
        check_foreign(catalog, replace(table, rows=plain), new.filter("_hit").drop("_hit", "_file"))
    catalog.put_files(table, touched, _inside(new, touched))
    return count


def delete(catalog: Catalog, table: Table, where: Expr | None) -> int:
    """Leave out the rows for which the condition is true."""
    marked, touched, count = _hits(catalog, table, where)
    if count:
        catalog.put_files(table, touched, _inside(marked, touched).filter("not _hit"))
    return count
