"""Further registered queries: definitions, constraints, access, key-value commands, sources, streams.

What a statement answers or leaves behind is the result; the SQL beside it says the same of the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kv import Channels
from ..session import Engine
from ..sources.storage import read_table, shared_dir, write_table
from ..streaming import events as streaming
from .registry import _ALL, _PLACES, _with_nations, engine, query, sql, table


def answers(spark: SparkSession, found: dict[str, object]) -> DataFrame:
    """Named answers as rows of text."""
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "step string, answer string")


def said(**wanted: object) -> str:
    """The SQL of named answers that are the same for any table."""
    rows = ", ".join("('{}', '{}')".format(k, str(v).replace("'", "''")) for k, v in wanted.items())
    return f"SELECT * FROM (VALUES {rows}) t(step, answer)"


def refused(run: Callable[[], object]) -> str:
    """The kind of error that a statement gives."""
    try:
        run()
    except Exception as e:
        return type(e).__name__
    return "allowed"


def place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry/registry-{uuid.uuid4().hex}"


# Predicates, names and clauses that other queries don't have
sql("where_is_false", "SELECT p_partkey FROM part WHERE (nullif(p_size, 5) > 25) IS FALSE")
sql("not_expression", "SELECT p_partkey, NOT (p_size > 25) AS small FROM part")
sql("having_like", "SELECT p_brand, MAX(p_name) AS top FROM part GROUP BY p_brand HAVING MAX(p_name) LIKE '%w%'")
sql("having_in_subquery", "SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size HAVING p_size IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql("auto_names", "SELECT p_partkey, p_size FROM part WHERE p_size < 4")
sql("from_dual", "SELECT 1 + 1 AS two FROM dual", "SELECT 2 AS two")
sql("join_natural", "SELECT doc_id, toxic FROM (SELECT doc_id FROM documents) d NATURAL JOIN labels")
sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")
sql("join_range", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON b.s_suppkey BETWEEN a.n_nationkey AND a.n_nationkey + 2")
sql("approx_distinct", "SELECT l_returnflag, APPROX_COUNT_DISTINCT(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_returnflag")
sql("percentile_exact", "SELECT p_brand, PERCENTILE(p_size, 0.5) AS m FROM part GROUP BY p_brand", "SELECT p_brand, quantile_cont(p_size, 0.5) AS m FROM part GROUP BY p_brand")
sql("filtered_aggregate", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_custkey")
sql("named_window", "SELECT o_orderkey, SUM(o_totalprice) OVER w AS v FROM orders WINDOW w AS (PARTITION BY o_custkey)", "SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey) AS v FROM orders")
sql("win_ignore_nulls", "SELECT p_partkey, LAST_VALUE(nullif(p_size, 10)) IGNORE NULLS OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM part", "SELECT p_partkey, LAST_VALUE(nullif(p_size, 10) IGNORE NULLS) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM part")
sql("system_variables", "SELECT @@auto_increment_increment AS a, @@character_set_server AS b, @@collation_server AS c, @@net_write_timeout AS d, @@net_read_timeout AS e, @@max_allowed_packet AS f", "SELECT 1 AS a, 'utf8mb4' AS b, 'utf8mb4_general_ci' AS c, 60 AS d, 30 AS e, 67108864 AS f")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("told", table(spark, sf_dir, "events").select("event_id", F.col("props").alias("attrs")))
    return e.sql("SELECT t.event_id, t.attrs.k AS k FROM told t")


@query("SELECT p_brand, p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS v FROM part")
def ir_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = {"units": "Rows", "start": {"Preceding": {"Literal": {"Int": 1}}}, "end": {"Following": {"Literal": {"Int": 2}}}}
    over = {"func_type": "Sum", "args": [{"Column": "p_size"}], "partition_by": [{"Column": "p_brand"}], "order_by": [{"expr": {"Column": "p_partkey"}, "order": "Asc"}], "frame": frame}
    return engine(spark, sf_dir).ir({"Select": {"table": "part", "columns": [{"expr": {"Column": "p_brand"}}, {"expr": {"Column": "p_partkey"}}, {"expr": {"WindowFunc": over}, "alias": "v"}]}})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_custkey) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def ir_having_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    count, top = ({"FunctionCall": {"name": f, "args": [a]}} for f, a in (("Count", "Star"), ("Max", {"Column": "o_custkey"})))
    rich = {"table": "customer", "columns": [{"expr": {"Column": "c_custkey"}}], "where_clause": {"Comparison": [{"Column": "c_acctbal"}, "Gt", {"Literal": {"Int": 5000}}]}}
    return engine(spark, sf_dir).ir({"Select": {"table": "orders", "columns": [{"expr": {"Column": "o_custkey"}}, {"expr": count, "alias": "n"}], "group_by": [{"Column": "o_custkey"}], "having": {"InSubquery": [top, rich]}}})


# Views and joins with metadata
@query("SELECT n_name, 'INT' AS data_type FROM nation WHERE n_nationkey = 3")
def join_information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir).sql("SELECT p.name AS n_name, c.data_type FROM places p JOIN information_schema.columns c ON c.ordinal_position = p.id WHERE c.column_name = 'region'")


@query("SELECT r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) ON r_regionkey = n_regionkey")
def join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("CREATE VIEW sizes (k, n) AS SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey")
    return e.sql("SELECT r_name, n FROM region JOIN sizes ON r_regionkey = k")


@query(f"SELECT * FROM ({_PLACES}) WHERE id <> 4 UNION ALL SELECT 900, 'by view', 1")
def view_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("CREATE VIEW simple AS SELECT * FROM places; INSERT INTO simple VALUES (900, 'by view', 1); DELETE FROM simple WHERE id = 4")
    return e.sql(_ALL)


@query("SELECT n_name FROM nation WHERE n_regionkey = 3")
def view_alter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute_batch("CREATE VIEW a AS SELECT n_name FROM nation; ALTER VIEW a AS SELECT n_name FROM nation WHERE n_regionkey = 3; CREATE VIEW b AS SELECT * FROM a; CREATE VIEW c AS SELECT 1 AS x; DROP VIEW c")
    return e.sql("SELECT * FROM b")


# Definitions
@query(said(dropped="AnalysisException", again="allowed", twice="CatalogError", database="CatalogError"))
def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("DROP TABLE places; CREATE DATABASE shop; DROP DATABASE shop")
    return answers(spark, {"dropped": refused(lambda: e.sql(_ALL)), "again": refused(lambda: e.sql("DROP TABLE IF EXISTS places")), "twice": refused(lambda: e.sql("DROP TABLE places")), "database": refused(lambda: e.sql("USE shop"))})


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 77, 'given'")
def ddl_alter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column goes; a default and a rule come and go."""
    e = _with_nations(spark, sf_dir)
    e.execute_batch("ALTER TABLE places DROP COLUMN region; ALTER TABLE places ALTER COLUMN name SET DEFAULT 'given'; INSERT INTO places (id) VALUES (77); ALTER TABLE places ALTER COLUMN name DROP DEFAULT; ALTER TABLE places ALTER COLUMN name DROP NOT NULL; ALTER TABLE places ALTER COLUMN name SET NOT NULL; ALTER TABLE places ENGINE = any; ALTER TABLE places CHARACTER SET utf8mb4")
    return e.sql("SELECT * FROM places")


@query(said(primary="ConstraintError", dropped="allowed", foreign="ConstraintError", free="allowed", existing="ConstraintError"))
def ddl_alter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("CREATE TABLE stops (no INT, place INT); INSERT INTO stops VALUES (1, 3), (2, 4); ALTER TABLE stops ADD PRIMARY KEY (no); ALTER TABLE stops ADD CONSTRAINT f FOREIGN KEY (place) REFERENCES places (id)")
    found = {"primary": refused(lambda: e.sql("INSERT INTO stops VALUES (1, 5)")), "foreign": refused(lambda: e.sql("INSERT INTO stops VALUES (3, 999)"))}
    e.execute_batch("ALTER TABLE stops DROP PRIMARY KEY; ALTER TABLE stops DROP FOREIGN KEY f")
    found |= {"dropped": refused(lambda: e.sql("INSERT INTO stops VALUES (1, 5)")), "free": refused(lambda: e.sql("INSERT INTO stops VALUES (3, 999)")), "existing": refused(lambda: e.sql("ALTER TABLE stops ADD PRIMARY KEY (no)"))}
    return answers(spark, found)


@query(said(unique="ConstraintError", partial="allowed", partial_again="ConstraintError", expression="ConstraintError", dropped="allowed"))
def ddl_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("CREATE UNIQUE INDEX names ON places (name) USING HASH; CREATE UNIQUE INDEX one_nine ON places (region) USING BTREE WHERE region = 9; CREATE UNIQUE INDEX lowered ON places (LOWER(name))")
    found = {"unique": refused(lambda: e.sql("INSERT INTO places VALUES (800, 'NATION_1', 1)")), "partial": refused(lambda: e.sql("INSERT INTO places VALUES (801, 'a', 9)")), "partial_again": refused(lambda: e.sql("INSERT INTO places VALUES (802, 'b', 9)")), "expression": refused(lambda: e.sql("INSERT INTO places VALUES (803, 'nation_2', 1)"))}
    e.execute_batch("DROP INDEX lowered ON places; DROP INDEX names ON places")
    return answers(spark, found | {"dropped": refused(lambda: e.sql("INSERT INTO places VALUES (803, 'nation_2', 1)"))})


@query("SELECT id, n, big FROM (SELECT n_nationkey AS id, 1 AS n, n_nationkey > 12 AS big FROM nation)")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on an indexed column, a key at a time for all keys: the condition reaches the files."""
    e = _with_nations(spark, sf_dir)
    e.sql("CREATE INDEX by_id ON places (id)")
    return e.sql("SELECT a.id, (SELECT COUNT(*) FROM places b WHERE b.id = a.id) AS n, a.id > 12 AS big FROM places a")


@query(said(key="ConstraintError", missing="ConstraintError", null="ConstraintError", parent="ConstraintError", enum="ConstraintError", members="ConstraintError", unsigned="ConstraintError", right="1"))
def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.sql("CREATE TABLE trips (no INT PRIMARY KEY, place INT, way ENUM('rail', 'road'), with_ SET('bike', 'dog'), km INT UNSIGNED, FOREIGN KEY (place) REFERENCES places (id))")
    tried = {"key": "(3, 'x', 1)", "missing": "(700, NULL, 1)", "null": "(NULL, 'x', 1)"}
    found = {k: refused(lambda v=v: e.sql(f"INSERT INTO places VALUES {v}")) for k, v in tried.items()}
    tried = {"parent": "(1, 999, 'rail', '', 5)", "enum": "(1, 3, 'air', '', 5)", "members": "(1, 3, 'rail', 'bike,cat', 5)", "unsigned": "(1, 3, 'rail', '', -5)"}
    found |= {k: refused(lambda v=v: e.sql(f"INSERT INTO trips VALUES {v}")) for k, v in tried.items()}
    return answers(spark, found | {"right": e.sql("INSERT INTO trips VALUES (1, 3, 'rail', 'bike,dog', 5)").affected})


@query("SELECT 'fires' AS trigger_name, 'BEFORE' AS timing, 'INSERT' AS event, 'places' AS table_name")
def trigger_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _with_nations(spark, sf_dir)
    e.execute_batch("CREATE TRIGGER fires BEFORE INSERT ON places FOR EACH ROW SET @a = 1; CREATE TRIGGER gone AFTER DELETE ON places FOR EACH ROW SET @b = 1; DROP TRIGGER gone")
    return spark.createDataFrame([(k, v["timing"], v["event"], v["table"]) for k, v in e.catalog.state.triggers.items()], "trigger_name string, timing string, event string, table_name string")


# Metadata and administration
_INDEXED = "CREATE INDEX by_region ON places (region) USING HASH; CREATE TABLE stops (no INT PRIMARY KEY, place INT REFERENCES places (id)); CREATE DATABASE shop"


def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    e = _with_nations(spark, sf_dir)
    e.execute_batch(_INDEXED)
    return e


def metadata(key: str, statement: str, oracle: str) -> None:
    """A statement on a catalog of two tables, an index and a database."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _indexed(spark, sf_dir).sql(statement)

    run.__name__ = key
    query(oracle)(run)


metadata("infoschema_schemata", "SELECT schema_name, default_character_set_name AS c FROM information_schema.schemata", "SELECT * FROM (VALUES ('default', 'utf8mb4'), ('shop', 'utf8mb4')) t(schema_name, c)")
metadata("infoschema_statistics", "SELECT table_name, index_name, non_unique, column_name, cardinality, total_rows FROM information_schema.statistics WHERE table_name = 'places'", "SELECT 'places' AS table_name, 'pk_places' AS index_name, FALSE AS non_unique, '`id`' AS column_name, count(DISTINCT n_nationkey) AS cardinality, count(*) AS total_rows FROM nation UNION ALL SELECT 'places', 'by_region', TRUE, '`region`', count(DISTINCT n_regionkey), count(*) FROM nation")
metadata("infoschema_key_column_usage", "SELECT constraint_name, table_name, column_name, referenced_table_name AS r, referenced_column_name AS rc FROM information_schema.key_column_usage", "SELECT * FROM (VALUES ('pk_places', 'places', 'id', NULL, NULL), ('pk_stops', 'stops', 'no', NULL, NULL), ('fk_stops_place', 'stops', 'place', 'places', 'id')) t(constraint_name, table_name, column_name, r, rc)")
metadata("infoschema_indexes", "SELECT * FROM information_schema.indexes", "SELECT * FROM (VALUES ('places', 'pk_places', TRUE, 'BTREE'), ('places', 'by_region', FALSE, 'HASH'), ('stops', 'pk_stops', TRUE, 'BTREE')) t(table_name, index_name, is_unique, index_type)")
metadata("infoschema_global_status", "SELECT VARIABLE_NAME, VARIABLE_VALUE FROM information_schema.global_status WHERE VARIABLE_NAME IN ('Com_create', 'Com_insert')", "SELECT * FROM (VALUES ('Com_create', '4'), ('Com_insert', '1')) t(VARIABLE_NAME, VARIABLE_VALUE)")
metadata("infoschema_session_status", "SELECT COUNT(*) AS n FROM information_schema.session_status", "SELECT 0 AS n")
metadata("show_tables", "SHOW TABLES LIKE '%p%s'", "SELECT * FROM (VALUES ('pages'), ('places'), ('stops')) t(table_name)")
metadata("show_databases", "SHOW DATABASES", "SELECT * FROM (VALUES ('default'), ('shop')) t(schema_name)")
metadata("show_columns", "SHOW COLUMNS FROM places", "SELECT * FROM (VALUES ('id', 'INT', 'NO', 'PRI', NULL, ''), ('name', 'TEXT', 'NO', '', NULL, ''), ('region', 'INT', 'YES', '', '7', '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
metadata("describe_table", "DESCRIBE stops", "SELECT * FROM (VALUES ('no', 'INT', 'NO', 'PRI', NULL, ''), ('place', 'INT', 'YES', '', NULL, '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
metadata("show_create_table", "SHOW CREATE TABLE stops", "SELECT 'stops' AS \"Table\", 'CREATE TABLE `stops` (`no` INT, `place` INT, PRIMARY KEY (`no`), CONSTRAINT `fk_stops_place` FOREIGN KEY (`place`) REFERENCES `places` (`id`))' AS \"Create Table\"")
metadata("show_create_database", "SHOW CREATE DATABASE shop", "SELECT 'shop' AS \"Database\", 'CREATE DATABASE `shop`' AS \"Create Database\"")
metadata("show_index", "SHOW INDEX FROM stops", "SELECT 'default' AS table_schema, 'stops' AS table_name, FALSE AS non_unique, 'pk_stops' AS index_name, 1 AS seq_in_index, '`no`' AS column_name, 'BTREE' AS index_type, 0 AS cardinality, 0 AS total_rows")
metadata("show_variables", "SHOW VARIABLES LIKE 'net%'", "SELECT * FROM (VALUES ('net_read_timeout', '30'), ('net_write_timeout', '60')) t(\"Variable_name\", \"Value\")")
metadata("show_status", "SHOW STATUS LIKE 'Com_cr%'", "SELECT 'Com_create' AS \"Variable_name\", '4' AS \"Value\"")
metadata("show_processlist", "SHOW PROCESSLIST", "SELECT 1 AS \"Id\", 'owner' AS \"User\", 'localhost' AS \"Host\", 'default' AS db, 'Query' AS \"Command\", 0 AS \"Time\", '' AS \"State\", 'SHOW PROCESSLIST' AS \"Info\"")


@query(said(use="shop", unknown="CatalogError", kill="0", errors="1"))
def use_and_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _indexed(spark, sf_dir)
    e.sql("USE shop")
    return answers(spark, {"use": e.database, "unknown": refused(lambda: e.sql("USE nowhere")), "kill": e.sql("KILL 12").affected, "errors": e.metrics.counts["Errors"]})


@query(said(login="Denied", none="Denied", granted="25", other="Denied", write="Denied", revoked="Denied", all="25", dropped="Denied"))
def access_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _indexed(spark, sf_dir)
    e.sql("CREATE USER kim IDENTIFIED BY 'pw'")
    kim = e.as_user("kim", "pw")
    found = {"login": refused(lambda: e.as_user("kim", "no")), "none": refused(lambda: kim.sql(_ALL))}
    e.sql("GRANT SELECT ON places TO kim")
    found |= {"granted": kim.sql(_ALL).count(), "other": refused(lambda: kim.sql("SELECT * FROM stops")), "write": refused(lambda: kim.sql("DELETE FROM places"))}
    e.sql("REVOKE SELECT ON places FROM kim")
    found["revoked"] = refused(lambda: kim.sql(_ALL))
    e.sql("GRANT ALL ON *.* TO kim")
    found["all"] = kim.sql("DELETE FROM places").affected
    e.sql("DROP USER kim")
    return answers(spark, found | {"dropped": refused(lambda: e.as_user("kim", "pw"))})


@query(said(read="Denied", write="Denied", granted="1", remove="Denied"))
def access_key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.execute_batch("CREATE USER kim IDENTIFIED BY 'pw'")
    e.kv.set("a", "1")
    kim = e.as_user("kim", "pw")
    found = {"read": refused(lambda: kim.kv.get("a")), "write": refused(lambda: kim.ir({"KvSet": {"key": "a", "value": {"Int": 2}}}))}
    e.sql("GRANT SELECT ON *.* TO kim")
    return answers(spark, found | {"granted": kim.kv.get("a"), "remove": refused(lambda: kim.kv.delete("a"))})


# Routines
@query("SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 6 AND n_nationkey <> 3")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WHILE, IF, CASE, REPEAT, LOOP with LEAVE and ITERATE add up the numbers that are left out."""
    e = engine(spark, sf_dir)
    e.sql("""CREATE PROCEDURE pick(IN k INT) BEGIN
        DECLARE i INT DEFAULT 0; DECLARE s INT DEFAULT 0; DECLARE low INT DEFAULT 0;
        WHILE i < k DO SET i = i + 1; IF i % 2 = 0 THEN SET s = s + i; END IF; END WHILE;
        REPEAT SET s = s - 1; UNTIL s <= 3 END REPEAT;
        again: LOOP SET low = low + 1; IF low < 3 THEN ITERATE again; END IF; LEAVE again; END LOOP;
        CASE WHEN s = low THEN SET i = 6; ELSE SET i = 0; END CASE;
        SELECT n_nationkey AS n FROM nation WHERE n_nationkey < i AND n_nationkey <> s; END""")
    return e.sql("CALL pick(6)")


@query(said(affected="1", count="26", failed="False"))
def batch_and_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's statements in order, and a statement's answer as the query interface sends it."""
    e = _with_nations(spark, sf_dir)
    e.execute_batch("INSERT INTO places VALUES (50, 'a', 1); -- a note; \nUPDATE places SET region = 2 WHERE id = 50;")
    told = e.respond("UPDATE places SET name = 'b' WHERE id = 50 AND region = 2")
    return answers(spark, {"affected": told["rows_affected"], "count": e.respond("SELECT COUNT(*) AS n FROM places")["data"][0][0], "failed": e.respond("SELECT nothing FROM places")["success"]})


@query(_PLACES)
def snapshot_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _with_nations(spark, sf_dir), place(spark)
    e.save(path)
    e.sql("DELETE FROM places")
    return engine(spark, sf_dir).load(path).sql(_ALL)


@query(_PLACES)
def dump_to_restore_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = _with_nations(spark, sf_dir), place(spark)
    e.dump_to(path)
    other = engine(spark, sf_dir)
    other.restore_from(path)
    return other.sql(_ALL)


# Definitions of the JSON form
def _column(name: str, kind: object, **more: object) -> dict:
    return {"name": name, "data_type": kind, **more}


def _ir_tables(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    e.ir({"CreateTable": {"name": "sites", "columns": [_column("id", "Int"), _column("name", "Text", is_not_null=True), _column("region", "BigInt", default_value={"Int": 7})], "primary_key": ["id"], "foreign_keys": []}})
    e.sql("INSERT INTO sites SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return e


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 90, 'x', 7")
def ir_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.sql("INSERT INTO sites (id, name) VALUES (90, 'x')")
    return e.sql("SELECT * FROM sites")


@query("SELECT n_nationkey AS id, n_name AS title, 'none' AS note FROM nation")
def ir_alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    for action in ({"AddColumn": _column("note", "Text", default_value={"Text": "none"})}, {"RenameColumn": {"old_name": "name", "new_name": "title"}}, {"DropColumn": "region"}, {"RenameTable": "spots"}):
        e.ir({"AlterTable": {"table": "sites", "action": action}})
    return e.sql("SELECT * FROM spots")


@query(said(repeated="ConstraintError", elsewhere="1"))
def ir_create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.ir({"CreateIndex": {"name": "u", "table": "sites", "expressions": [{"ScalarFunc": {"name": "Lower", "args": [{"Column": "name"}]}}], "unique": True, "index_type": "BTree", "where_clause": {"Comparison": [{"Column": "region"}, "Eq", {"Literal": {"Int": 1}}]}}})
    return answers(spark, {"repeated": refused(lambda: e.sql("INSERT INTO sites VALUES (90, 'nation_1', 1)")), "elsewhere": e.sql("INSERT INTO sites VALUES (90, 'nation_1', 0)").affected})


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey")
def ir_materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.ir({"CreateMaterializedView": {"name": "m", "query": {"table": "sites", "columns": [{"expr": {"Column": "region"}}, {"expr": {"FunctionCall": {"name": "Count", "args": ["Star"]}}, "alias": "n"}], "group_by": [{"Column": "region"}]}}})
    e.sql("DELETE FROM sites WHERE id <= 4")
    return e.sql("SELECT * FROM m")


@query("SELECT n_nationkey AS no, n_name AS what FROM nation WHERE n_nationkey < 9")
def ir_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.ir({"CreateView": {"name": "v", "query": {"table": "sites", "columns": [{"expr": {"Column": "id"}}, {"expr": {"Column": "name"}}]}, "columns": ["no", "what"], "with_check_option": False}})
    return e.sql("SELECT * FROM v WHERE no < 9")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey >= 20")
def ir_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.ir({"CreateProcedure": {"name": "above", "params": [{"name": "k", "data_type": "Int", "mode": "In"}], "body": {"Select": {"table": "sites", "columns": [{"expr": {"Column": "name"}}], "where_clause": {"Comparison": [{"Column": "id"}, "Gte", {"Column": "k"}]}}}}})
    out = e.ir({"Call": {"name": "above", "args": [{"Literal": {"Int": 20}}]}})
    e.ir({"DropProcedure": {"name": "above"}})
    return out


@query(said(value="21", dropped="CatalogError"))
def ir_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.ir({"CreateFunction": {"name": "thrice", "params": [{"name": "x", "data_type": "Int", "mode": "In"}], "return_type": "Int", "body": {"Select": {"table": "", "columns": [{"expr": {"BinaryOp": [{"Column": "x"}, "Mul", {"Literal": {"Int": 3}}]}, "alias": "v"}]}}}})
    value = e.sql("CALL thrice(7)").first()[0]
    e.ir({"DropFunction": {"name": "thrice"}})
    return answers(spark, {"value": value, "dropped": refused(lambda: e.sql("CALL thrice(1)"))})


@query(said(made="AFTER DELETE sites", dropped="0"))
def ir_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ir_tables(spark, sf_dir)
    e.ir({"CreateTrigger": {"name": "t", "timing": "After", "event": "Delete", "table": "sites", "body": "Begin"}})
    made = e.catalog.state.triggers["t"]
    e.ir({"DropTrigger": {"name": "t"}})
    return answers(spark, {"made": f"{made['timing']} {made['event']} {made['table']}", "dropped": len(e.catalog.state.triggers)})


# Key-value commands on structures taken from tables
def _keyed(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string")).alias("key")


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    """Hashes and strings of customers, lists of their orders, sets of segments, ranks of suppliers."""
    e = engine(spark, sf_dir)
    c, o, s = (table(spark, sf_dir, n) for n in ("customer", "orders", "supplier"))
    e.kv.load("kv_strings", c.select(_keyed("n:", "c_custkey"), F.col("c_name").alias("value"), F.lit(None).cast("long").alias("expiry")))
    e.kv.load("kv_hash", c.select(_keyed("c:", "c_custkey"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")).union(c.select(_keyed("c:", "c_custkey"), F.lit("name"), "c_name")))
    e.kv.load("kv_list", o.select(_keyed("o:", "o_custkey"), F.col("o_orderkey").alias("index"), F.col("o_orderkey").cast("string").alias("value")))
    e.kv.load("kv_set", c.select(F.col("c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("member")).distinct())
    e.kv.load("kv_zset", s.select(F.lit("balance").alias("key"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("member")))
    ev = table(spark, sf_dir, "events")
    e.kv.load("kv_stream", ev.select(F.col("event_type").alias("key"), (F.col("event_id") + 1).alias("id"), F.lit("user").alias("field"), F.col("user_id").cast("string").alias("value")).filter("value is not null"))
    return e


def rows_of(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


@query("SELECT 'n:' || c_custkey AS key, CASE WHEN c_custkey = 5 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey BETWEEN 3 AND 6")
def kv_get_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    kv.set("n:5", "new")
    return rows_of(spark, [(f"n:{k}", kv.get(f"n:{k}")) for k in (3, 4, 5, 6)], "key string, value string")


@query(said(ttl="30", none="-1", gone="-2", expired="None", expire="True", exists="2"))
def kv_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    kv.clock = lambda: 1_000_000
    kv.set("t", "x", ex=30)
    kv.set("p", "x", pxat=900_000)
    return answers(spark, {"ttl": kv.ttl("t"), "none": kv.ttl("n:3"), "gone": kv.ttl("nobody"), "expired": kv.get("p"), "expire": kv.expire("n:3", 5), "exists": kv.exists("n:3", "t", "p")})


@query("SELECT 'n:' || c_custkey AS key FROM customer WHERE c_custkey BETWEEN 10 AND 19 AND c_custkey <> 12")
def kv_del_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    assert kv.delete("n:12", "nobody") == 1
    return rows_of(spark, [(k,) for k in kv.keys("n:1?")], "key string")


@query("SELECT 'segment' AS field, c_mktsegment AS value FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'note', 'kept' UNION ALL SELECT 'name', 'changed'")
def kv_hash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    assert kv.hset("c:7", {"name": "changed", "note": "kept"}) == 1 and not kv.hsetnx("c:7", "note", "lost") and kv.hsetnx("c:7", "other", "x")
    assert kv.hget("c:7", "name") == "changed" and kv.hdel("c:7", "other", "nothing") == 1
    return rows_of(spark, list(kv.hgetall("c:7").items()), "field string, value string")


@query("SELECT CAST(row_number() OVER (ORDER BY o) AS BIGINT) AS at, v FROM (SELECT o_orderkey AS o, CAST(o_orderkey AS VARCHAR) AS v FROM orders WHERE o_custkey = 8 UNION ALL SELECT -1, 'head' UNION ALL SELECT 9000000000, 'tail')")
def kv_list_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    n = kv.llen("o:8")
    assert kv.lpush("o:8", "head") == n + 1 and kv.rpush("o:8", "tail") == n + 2
    return rows_of(spark, list(enumerate(kv.lrange("o:8", 0, -1), 1)), "at long, v string")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders WHERE o_custkey = 8) SELECT CASE WHEN a = 1 THEN 'first' WHEN b <= 2 THEN 'last' ELSE 'left' END AS which, CAST(o_orderkey AS VARCHAR) AS v FROM o")
def kv_list_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    popped = [("first", v) for v in kv.lpop("o:8")] + [("last", v) for v in kv.rpop("o:8", 2)]
    return rows_of(spark, popped + [("left", v) for v in kv.lrange("o:8", 0, -1)], "which string, v string")


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS member FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3 UNION SELECT 'more'")
def kv_set_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    assert kv.sadd("BUILDING", "more", "more") == 1 and kv.sadd("BUILDING", "more") == 0
    kv.srem("BUILDING", "3", "nothing")
    assert kv.sismember("BUILDING", "more") and not kv.sismember("BUILDING", "3")
    return rows_of(spark, [(m,) for m in kv.smembers("BUILDING")], "member string")


@query("SELECT member, score FROM (SELECT s_name AS member, CASE WHEN s_suppkey = 2 THEN -5000.0 ELSE s_acctbal END AS score FROM supplier) ORDER BY score, member LIMIT 5")
def kv_zset_add_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    name = table(spark, sf_dir, "supplier").filter("s_suppkey = 2").first()["s_name"]
    assert kv.zadd("balance", {name: -5000.0}) == 0
    return rows_of(spark, kv.zrange("balance", 0, 4, withscores=True), "member string, score double")


@query("SELECT s_name AS member FROM supplier WHERE s_acctbal BETWEEN 1000 AND 3000 AND s_name <> 'Supplier#000000004'")
def kv_zset_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    kv.zrem("balance", "Supplier#000000004", "nobody")
    return rows_of(spark, [(m,) for m in kv.zrangebyscore("balance", 1000, 3000)], "member string")


@query("SELECT event_id + 1 AS id, CAST(user_id AS VARCHAR) AS user FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND event_id + 1 BETWEEN 50 AND 400 ORDER BY 1 LIMIT 20")
def kv_stream_xrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    return rows_of(spark, [(i, f["user"]) for i, f in kv.xrange("click", 50, 400, 20)], "id long, user string")


@query("SELECT 'length' AS step, CAST(count(*) + 2 AS VARCHAR) AS answer FROM events WHERE event_type = 'click' AND user_id IS NOT NULL UNION ALL SELECT 'next', CAST(max(event_id) + 2 AS VARCHAR) FROM events WHERE event_type = 'click' AND user_id IS NOT NULL UNION ALL SELECT 'given', '9000000' UNION ALL SELECT 'below', 'ValueError'")
def kv_stream_xadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir).kv
    found = {"next": kv.xadd("click", {"user": "x"}), "given": kv.xadd("click", {"user": "y"}, 9_000_000), "below": refused(lambda: kv.xadd("click", {"user": "z"}, 5))}
    return answers(spark, found | {"length": kv.xlen("click")})


@query(said(both="2", pattern="[('news', 'a')]", channels="['news']", count="{'news': 1}", after="1"))
def publish_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Channels()
    c.subscribe("me", "news")
    c.subscribe("you", "n*s", pattern=True)
    found = {"both": c.publish("news", "a"), "pattern": c.messages("you"), "channels": c.channels(), "count": c.numsub("news")}
    c.unsubscribe("me", "news")
    return answers(spark, found | {"after": c.publish("news", "b")})


# Functions of one's own, and joins on order
@query("SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")
def aggregate_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    e = engine(spark, sf_dir)
    e.register_function("spread_of", F.pandas_udf(spread, "double", F.PandasUDFType.GROUPED_AGG))
    return e.sql("SELECT o_orderstatus, spread_of(o_totalprice) AS spread FROM orders GROUP BY o_orderstatus")


@query("SELECT n_nationkey, unnest(range(n_nationkey % 3)) AS k FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Below:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    e = engine(spark, sf_dir)
    e.register_function("below", F.udtf(Below, returnType="k: bigint"))
    return e.sql("SELECT n_nationkey, b.k FROM nation, LATERAL below(CAST(n_nationkey % 3 AS INT)) b")


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(event_id) AS bought FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL GROUP BY user_id, ts) SELECT e.event_id, p.bought FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last purchase before it."""
    from ..operators.joins import asof_join

    e = table(spark, sf_dir, "events").filter("user_id is not null or event_type = 'click'")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought"))
    return asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"]).select("event_id", "bought")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 40")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import interval_join

    spans = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 40).alias("top"))
    return interval_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "s_acctbal", "top", 50).select("p_partkey", "s_suppkey")


# Sources, logs and streams
@query("SELECT n_nationkey, n_name, n_regionkey, kind FROM nation, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) t(kind)")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, nations = None, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))
    for kind in ("parquet", "orc", "json", "csv"):
        path = place(spark)
        write_table(nations, path, kind, **({"header": True} if kind == "csv" else {}))
        own = read_table(spark, path, kind, **({"header": True, "inferSchema": True} if kind == "csv" else {}))
        own = own.select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"), F.lit(kind).alias("kind"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT 2 AS id, 'b' AS v UNION ALL SELECT 3, 'c'")
def append_log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = streaming.AppendLog(spark, place(spark))
    log.append("k", [{"v": "a"}, {"v": "b"}])
    log.append("other", [{"v": "z"}])
    log.append("k", [{"v": "c"}])
    return log.range("k", 2).select("id", F.col("fields")["v"].alias("v"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sliding(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream with a watermark, in micro-batches, as its complete output."""
    path, name = place(spark), f"windows_{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(path)
    stream = streaming.event_stream(spark, path, events.schema)
    q = streaming.tumbling(stream, late="400 days").writeStream.format("memory").queryName(name).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_refreshes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A materialized view kept by micro-batches that add rows to its table."""
    e, path = engine(spark, sf_dir), place(spark)
    e.execute_batch("CREATE TABLE seen (event_id BIGINT PRIMARY KEY, event_type TEXT); CREATE MATERIALIZED VIEW kinds AS SELECT event_type, COUNT(*) AS n FROM seen GROUP BY event_type")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartition(2).write.parquet(path)

    def add(rows: DataFrame, batch: int) -> None:
        own = Engine(rows.sparkSession)  # a micro-batch's rows belong to a session of their own
        own.catalog = e.catalog
        own.register("batch", rows)
        own.sql("INSERT INTO seen SELECT event_id, event_type FROM batch")

    q = streaming.refresh_each_batch(streaming.event_stream(spark, path, events.schema), add, f"{path}-checkpoint").start()
    q.processAllAvailable()
    q.stop()
    return e.sql("SELECT * FROM kinds")


# Search
@query("SELECT 100 AS n")
def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search gives its hundred best rows: more documents than that hold one of these words."""
    e = engine(spark, sf_dir)
    e.register("texts", table(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.sql("SEARCH texts 'the la die de and'").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])mit[^\\p{L}\\p{N}]+license($|[^\\p{L}\\p{N}])')")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), '"mit license"', top=None).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def search_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "+source:src1", top=None).select("doc_id")
