"""information_schema: small DataFrames over the catalog's metadata, and the key-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog

SCHEMAS = {
    "schemata": "catalog_name string, schema_name string, default_character_set_name string",
    "tables": "table_schema string, table_name string, table_type string, row_count long",
    "columns": "table_schema string, table_name string, column_name string, data_type string, ordinal_position long, is_auto_increment boolean",
    "statistics": "table_schema string, table_name string, non_unique boolean, index_name string, seq_in_index long, column_name string, index_type string, cardinality long, total_rows long",
    "key_column_usage": "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position long, referenced_table_schema string, referenced_table_name string, referenced_column_name string",
    "indexes": "table_name string, index_name string, is_unique boolean, index_type string",
    "session_status": "VARIABLE_NAME string, VARIABLE_VALUE string",
    "global_status": "VARIABLE_NAME string, VARIABLE_VALUE string",
}


def rows_of(name: str, catalog: Catalog, status: dict[str, object]) -> list[tuple]:
    """The rows of a metadata view; counts are asked of the tables' files."""
    s = catalog.state
    count = lambda t: t.rows.count() if t.rows is not None else 0
    if name == "schemata":
        return [("def", d, "utf8mb4") for d in sorted(s.databases)]
    if name == "tables":
        return [("default", t.name, "MATERIALIZED VIEW" if t.name in s.materialized else "BASE TABLE", count(t)) for _, t in sorted(s.tables.items())] + [("default", v, "VIEW", None) for v in sorted(s.views)]
    if name == "columns":
        return [("default", t.name, c.name, c.declared, i, c.auto) for _, t in sorted(s.tables.items()) for i, c in enumerate(t.columns, 1)]
    if name == "statistics":
        out = []
        for _, t in sorted(s.tables.items()):
            for i in t.indexes:
                keys = t.rows.select(*[F.expr(e).alias(f"k{k}") for k, e in enumerate(i.expressions)])
                figures = keys.agg(F.count_distinct(F.struct(*keys.columns)).alias("d"), F.count(F.lit(1)).alias("n")).first()
                out += [("default", t.name, not i.unique, i.name, k, e, i.kind, figures["d"], figures["n"]) for k, e in enumerate(i.expressions, 1)]
        return out
    if name == "key_column_usage":
        out = [(f"pk_{t.name}", "default", t.name, c, k, None, None, None) for _, t in sorted(s.tables.items()) for k, c in enumerate(t.primary_key, 1)]
        return out + [(f.name, "default", t.name, c, k, "default", f.parent, p) for _, t in sorted(s.tables.items()) for f in t.foreign_keys for k, (c, p) in enumerate(zip(f.columns, f.parent_columns, strict=True), 1)]
    if name == "indexes":
        return [(t.name, i.name, i.unique, i.kind) for _, t in sorted(s.tables.items()) for i in t.indexes]
    if name == "global_status":
        return [(k, str(v)) for k, v in status.items()]
    return []


def view(name: str, catalog: Catalog, status: dict[str, object]) -> DataFrame:
    return catalog.spark.createDataFrame(rows_of(name, catalog, status), SCHEMAS[name])
