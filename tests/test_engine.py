"""Statements of the dialect: definitions, writes, constraints, transactions, access, dumps."""

from dataclasses import replace

import pytest

from quarry.operators.dml import ConstraintError
from quarry.operators.rbac import Denied
from quarry.plans.lexer import SqlError, statements, tokens
from quarry.session import CommandResult, Engine, create_statement
from quarry.sources.catalog import CatalogError


@pytest.fixture
def e(spark):
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_constraints(e):
    e.execute_batch("""CREATE TABLE rivers (name TEXT PRIMARY KEY, km INT UNSIGNED);
        CREATE TABLE gauges (no INT PRIMARY KEY, river TEXT, state ENUM('dry', 'low', 'high'), sensors SET('flow', 'heat', 'salt'), FOREIGN KEY (river) REFERENCES rivers (name));
        INSERT INTO rivers VALUES ('Ebro', 930), ('Oder', 854); INSERT INTO gauges VALUES (31, 'Ebro', 'low', 'flow,salt'), (32, NULL, NULL, '')""")
    bad = ["INSERT INTO gauges VALUES (32, 'Oder', 'dry', '')", "INSERT INTO gauges VALUES (33, 'Rhone', 'dry', '')", "INSERT INTO gauges VALUES (33, 'Oder', 'frozen', '')", "INSERT INTO gauges VALUES (33, 'Oder', 'dry', 'flow,wind')", "INSERT INTO gauges VALUES (NULL, 'Oder', 'dry', '')", "INSERT INTO rivers VALUES ('Po', -1)", "UPDATE gauges SET no = 31 WHERE river IS NULL", "UPDATE gauges SET river = 'Rhone'"]
    for statement in bad:
        with pytest.raises(ConstraintError):
            e.sql(statement)
    assert e.sql("SELECT * FROM gauges").count() == 2 and e.sql("SELECT * FROM rivers").count() == 2
    with pytest.raises(CatalogError):
        e.sql("DROP TABLE canals")


def test_indexes(e):
    e.execute_batch("CREATE TABLE berths (place INT, side TEXT, plate TEXT); INSERT INTO berths VALUES (1, 'lee', 'Aa-1'), (2, 'lee', 'bb-2'), (3, 'windward', 'cc-3'); CREATE UNIQUE INDEX windward_once ON berths (side) USING BTREE WHERE side = 'windward'; CREATE UNIQUE INDEX plates ON berths (UPPER(plate)) USING HASH")
    for bad in ("(4, 'windward', 'dd-4')", "(4, 'lee', 'aA-1')"):
        with pytest.raises(ConstraintError):
            e.sql(f"INSERT INTO berths VALUES {bad}")
    e.sql("INSERT INTO berths VALUES (4, 'lee', 'dd-4')")
    assert rows(e.sql("SELECT index_name, index_type, is_unique FROM information_schema.indexes ORDER BY index_name")) == [("plates", "HASH", True), ("windward_once", "BTREE", True)]
    e.sql("DROP INDEX plates ON berths")
    with pytest.raises(ConstraintError):
        e.sql("CREATE UNIQUE INDEX sides ON berths (side)")


def test_auto_increment_and_defaults(e):
    e.execute_batch("CREATE TABLE u (id INT AUTO_INCREMENT PRIMARY KEY, name TEXT DEFAULT 'x'); INSERT INTO u (name) VALUES ('a'), ('b'); INSERT INTO u VALUES (NULL, 'c'); INSERT INTO u VALUES (10, DEFAULT); INSERT INTO u (name) VALUES ('e')")
    assert rows(e.sql("SELECT id, name FROM u ORDER BY id")) == [(1, "a"), (2, "b"), (3, "c"), (10, "x"), (11, "e")]
    e.execute_batch("CREATE TABLE tasks (id SERIAL, task TEXT); INSERT INTO tasks (task) VALUES ('t')")
    assert rows(e.sql("SELECT * FROM tasks")) == [(1, "t")]


def test_alter(e):
    e.execute_batch("CREATE TABLE a (id INT, name TEXT); INSERT INTO a VALUES (1, 'x'); ALTER TABLE a ADD COLUMN age INT; UPDATE a SET age = 30; ALTER TABLE a RENAME COLUMN name TO label; ALTER TABLE a ALTER COLUMN label SET DEFAULT 'd'; INSERT INTO a (id) VALUES (2); ALTER TABLE a ADD PRIMARY KEY (id); ALTER TABLE a DROP COLUMN age; ALTER TABLE a MODIFY COLUMN id BIGINT; ALTER TABLE a ENGINE = x; ALTER TABLE a RENAME TO b")
    assert rows(e.sql("SELECT * FROM b ORDER BY id")) == [(1, "x"), (2, "d")]
    assert dict(e.sql("SELECT * FROM b").dtypes)["id"] == "bigint"
    with pytest.raises(CatalogError):
        e.catalog.table("a")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO b VALUES (1, 'y')")
    e.sql("ALTER TABLE b DROP PRIMARY KEY")
    e.sql("INSERT INTO b VALUES (1, 'y')")


def test_transactions(e):
    e.execute_batch("CREATE TABLE t (id INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT s; INSERT INTO t VALUES (2); ROLLBACK TO SAVEPOINT s; INSERT INTO t VALUES (3)")
    assert e.catalog.committed.tables["t"].rows.count() == 0
    e.sql("COMMIT")
    assert rows(e.sql("SELECT id FROM t ORDER BY id")) == [(1,), (3,)]
    # The table changes while a transaction has changed it too: its commit fails.
    e.sql("BEGIN")
    e.sql("INSERT INTO t VALUES (4)")
    t = e.catalog.committed.tables["t"]
    e.catalog.committed.tables["t"] = replace(t, version=t.version + 1)
    with pytest.raises(CatalogError):
        e.sql("COMMIT")


def test_views(e):
    e.execute_batch("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 10), (2, 20); CREATE VIEW big (k) AS SELECT id FROM t WHERE v > 15; CREATE VIEW simple AS SELECT * FROM t")
    assert rows(e.sql("SELECT * FROM big")) == [(2,)]
    e.sql("INSERT INTO simple VALUES (3, 30)")
    assert rows(e.sql("SELECT k FROM big JOIN t ON k = id ORDER BY k")) == [(2,), (3,)]
    e.sql("ALTER VIEW big AS SELECT id FROM t")
    assert e.sql("SELECT * FROM big").count() == 3
    e.sql("CREATE MATERIALIZED VIEW m AS SELECT COUNT(*) AS n, SUM(v) AS s FROM simple")
    assert rows(e.sql("SELECT * FROM m")) == [(3, 60)]
    e.sql("DELETE FROM t WHERE id = 3")
    assert rows(e.sql("SELECT * FROM m")) == [(2, 30)]
    e.sql("DROP VIEW big")
    e.sql("CREATE VIEW grouped AS SELECT v FROM t GROUP BY v")
    with pytest.raises(SqlError):
        e.sql("INSERT INTO grouped VALUES (1)")


def test_prepared_and_variables(e):
    e.execute_batch("CREATE TABLE u (id INT, name TEXT); INSERT INTO u VALUES (41, 'fir'), (42, 'oak')")
    e.sql("PREPARE p FROM 'SELECT name FROM u WHERE id = ?'")
    e.sql("SET @x = 40 + 2")
    assert rows(e.sql("EXECUTE p USING @x")) == [("oak",)]
    assert rows(e.sql("SELECT name FROM u WHERE id = $1 OR name = $2 ORDER BY id", [41, "oak"])) == [("fir",), ("oak",)]
    e.sql("DEALLOCATE PREPARE p")
    with pytest.raises(SqlError):
        e.sql("EXECUTE p USING 1")
    with pytest.raises(SqlError):
        e.sql("SELECT * FROM u WHERE id = ? AND name = ?", [1])
    e.sql("PREPARE q FROM 'INSERT INTO u VALUES (?, ?)'")
    e.sql("EXECUTE q USING 3, 'it''s'")
    assert rows(e.sql("SELECT name FROM u WHERE id = 3")) == [("it's",)]


def test_access(e):
    e.execute_batch("CREATE TABLE t (id INT); CREATE TABLE o (id INT); CREATE USER bob IDENTIFIED BY 'secret'")
    bob = e.as_user("bob", "secret")
    with pytest.raises(Denied):
        e.as_user("bob", "wrong")
    with pytest.raises(Denied):
        bob.sql("SELECT * FROM t")
    e.sql("GRANT SELECT, INSERT ON t TO bob")
    bob.sql("INSERT INTO t VALUES (1)")
    assert bob.sql("SELECT * FROM t").count() == 1
    with pytest.raises(Denied):
        bob.sql("SELECT * FROM t JOIN o ON t.id = o.id")
    e.sql("REVOKE SELECT ON t FROM bob")
    with pytest.raises(Denied):
        bob.sql("SELECT * FROM t")
    e.sql("GRANT ALL ON *.* TO bob")
    bob.sql("DELETE FROM t")


def test_catalog_statements(e):
    e.execute_batch("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, p_id INT REFERENCES p (id)); CREATE DATABASE shop; CREATE TRIGGER tr BEFORE INSERT ON p FOR EACH ROW SET @a = 1")
    assert rows(e.sql("SHOW TABLES")) == [("c",), ("p",)]
    assert ("shop",) in rows(e.sql("SHOW DATABASES"))
    assert rows(e.sql("DESCRIBE c"))[0][:4] == ("id", "INT", "NO", "PRI")
    assert rows(e.sql("SELECT constraint_name, referenced_table_name FROM information_schema.key_column_usage WHERE table_name = 'c' ORDER BY constraint_name")) == [("fk_c_p_id", "p"), ("pk_c", None)]
    assert "PRIMARY KEY" in e.sql("SHOW CREATE TABLE c").first()[1]
    assert e.sql("SHOW INDEX FROM c").count() == 1
    assert rows(e.sql("SHOW VARIABLES LIKE 'autoc%'")) == [("autocommit", "1")]
    assert dict(rows(e.sql("SHOW STATUS LIKE 'Com_create'"))) == {"Com_create": "4"}
    stages = [r[0] for r in rows(e.sql("EXPLAIN SELECT p_id, COUNT(*) AS n FROM c WHERE id > 1 GROUP BY p_id ORDER BY n LIMIT 3"))]
    assert stages[0] == "SCAN" and {"FILTER", "AGGREGATE", "ORDER", "LIMIT"} <= set(stages)
    e.execute_batch("USE shop; KILL 3; DROP TRIGGER tr; DROP DATABASE shop; DROP TABLE IF EXISTS nothing")
    assert isinstance(e.sql("DROP TABLE c"), CommandResult)


def test_dump_restore_save_load(e, spark, tmp_path):
    e.execute_batch("CREATE TABLE d (id INT, name TEXT, at DATETIME); CREATE UNIQUE INDEX names ON d (name); INSERT INTO d VALUES (1, 'ali\\'ce', '2020-01-02 03:04:05'), (2, NULL, NULL)")
    again = Engine(spark)
    again.restore(e.dump())
    assert sorted(rows(again.sql("SELECT * FROM d")), key=str) == sorted(rows(e.sql("SELECT * FROM d")), key=str)
    with pytest.raises(ConstraintError):
        again.sql("INSERT INTO d VALUES (3, 'ali''ce', NULL)")
    e.kv.set("k", "v")
    e.sql("CREATE VIEW v AS SELECT name FROM d")
    e.save(f"file://{tmp_path}/snapshot")
    third = Engine(spark).load(f"file://{tmp_path}/snapshot")
    assert third.sql("SELECT * FROM v").count() == 2 and third.kv.get("k") == "v"
    e.dump_to(f"file://{tmp_path}/dump")
    assert spark.read.text(f"file://{tmp_path}/dump/*/*").filter("value like 'INSERT%'").count() == 2


def test_routines(e):
    e.execute_batch("""CREATE TABLE t (id INT); INSERT INTO t VALUES (1), (2), (3);
        CREATE FUNCTION plus(a INT, b INT) RETURNS INT RETURN a + b;
        CREATE PROCEDURE above(IN k INT) BEGIN SELECT id FROM t WHERE id > k ORDER BY id; END;
        CREATE PROCEDURE count_up(IN k INT) BEGIN DECLARE i INT DEFAULT 0; WHILE i < k DO SET i = i + 1; END WHILE; SELECT i AS i; END;
        CREATE PROCEDURE add_row(IN k INT) BEGIN INSERT INTO t VALUES (k); END""")
    assert rows(e.sql("SELECT plus(id, 1) AS v FROM t ORDER BY id")) == [(2,), (3,), (4,)]
    assert rows(e.sql("CALL above(1)")) == [(2,), (3,)]
    assert rows(e.sql("CALL count_up(4)")) == [(4,)]
    e.sql("CALL add_row(9)")
    assert e.sql("SELECT * FROM t").count() == 4
    e.sql("DROP PROCEDURE above")
    with pytest.raises(CatalogError):
        e.sql("CALL above(1)")


def test_compat(spark):
    e = Engine(spark, compat=True)
    assert rows(e.sql("SELECT CONCAT('a', NULL), 7 / 2, 7.0 / 2")) == [("aNULL", 3.0, 3.5)]
    e.sql("CREATE TABLE n (v INT)")
    assert rows(e.sql("SELECT SUM(v) FROM n")) == [(0,)]
    assert rows(Engine(spark).sql("SELECT CONCAT('a', NULL), 7 / 2")) == [(None, 3.5)]


def test_scripts():
    assert statements("SELECT ';' -- no; \n; # x;\n/* ; */ SELECT 2;") == ["SELECT ';' -- no;", "# x;\n/* ; */ SELECT 2"]
    assert len(statements("CREATE PROCEDURE p() BEGIN IF a THEN SELECT 1; END IF; SELECT 2; END; SELECT 3")) == 2
    assert statements("DELIMITER //\nCREATE PROCEDURE p() BEGIN SELECT 1; END//\nDELIMITER ;\nSELECT 2;") == ["CREATE PROCEDURE p() BEGIN SELECT 1; END", "SELECT 2"]
    assert [t.kind for t in tokens("a.`b` = 'it''s' + 1.5 <= ?")] == ["word", "sign", "quoted", "sign", "string", "sign", "number", "sign", "param"]


def test_json_form_writes(e):
    e.sql("CREATE TABLE j (id INT PRIMARY KEY, name TEXT)")
    row = lambda i, n: [{"Literal": {"Int": i}}, {"Literal": {"Text": n}}]
    e.ir({"Insert": {"table": "j", "values": row(1, "a")}})
    e.ir({"Sequence": [{"Insert": {"table": "j", "values": row(2, "b")}}, {"Insert": {"table": "j", "values": row(1, "z"), "mode": "Replace"}}]})
    where = {"Comparison": [{"Column": "id"}, "Eq", {"Literal": {"Int": 2}}]}
    e.ir({"Update": {"table": "j", "assignments": [["name", {"ScalarFunc": {"name": "Upper", "args": [{"Column": "name"}]}}]], "where_clause": where}})
    assert sorted(rows(e.ir({"Select": {"table": "j", "columns": [{"expr": "Star"}]}}))) == [(1, "z"), (2, "B")]
    e.ir({"Delete": {"table": "j", "where_clause": where}})
    assert rows(e.ir({"Select": {"table": "j", "columns": [{"expr": {"FunctionCall": {"name": "Count", "args": ["Star"]}}, "alias": "n"}]}})) == [(1,)]
    assert e.ir({"KvSet": {"key": "k", "value": {"Int": 3}}}) is None and e.ir({"KvGet": {"key": "k"}}) == "3"
    recursive = {"with_clause": {"recursive": True, "ctes": [{"name": "s", "query": {"columns": [{"expr": {"Literal": {"Int": 1}}, "alias": "n"}], "set_operations": [{"operator": "UnionAll", "select": {"table": "s", "columns": [{"expr": {"BinaryOp": [{"Column": "n"}, "Add", {"Literal": {"Int": 1}}]}, "alias": "n"}], "where_clause": {"Comparison": [{"Column": "n"}, "Lt", {"Literal": {"Int": 5}}]}}}]}}]}, "table": "s", "columns": [{"expr": {"Column": "n"}}]}
    assert sorted(rows(e.ir({"Select": recursive}))) == [(1,), (2,), (3,), (4,), (5,)]


def test_vacuum(e):
    e.execute_batch("CREATE TABLE v (id INT); INSERT INTO v VALUES (1); INSERT INTO v VALUES (3); UPDATE v SET id = 2 WHERE id = 3")
    e.kv.set("a", "1")
    e.kv.set("a", "2")
    assert e.vacuum() > 0
    assert e.sql("SELECT * FROM v").count() == 2 and e.kv.get("a") == "2" and e.vacuum() == 0


def test_responses(e):
    assert e.respond("CREATE TABLE r (id INT)")["success"] and e.respond("INSERT INTO r VALUES (1), (2)")["rows_affected"] == 2
    assert e.respond("SELECT id FROM r WHERE id > 1") == {"success": True, "columns": ["id"], "data": [[2]], "rows_affected": 0, "error": None}
    assert not e.respond("SELECT nothing FROM r")["success"] and not e.respond("")["success"]


def test_create_statement_reads_back(e, spark):
    e.sql("CREATE TABLE c (id BIGINT UNSIGNED NOT NULL, kind ENUM('a', 'b') DEFAULT 'a', price DECIMAL(10, 2), body JSON, PRIMARY KEY (id))")
    other = Engine(spark)
    other.execute_batch(create_statement(e.catalog.table("c")))
    assert other.catalog.table("c").columns == e.catalog.table("c").columns
    e.sql("""INSERT INTO c (id, price, body) VALUES (1, 2.50, '{"user": {"id": 123}}')""")
    assert rows(e.sql("SELECT id FROM c WHERE body.user.id = 123")) == [(1,)]
    assert rows(e.sql("SELECT x.kind FROM c x WHERE x.body.user.id > 100")) == [("a",)]


def test_join_by_a_range_deals_rows_out_by_bins(spark):
    """Few values of the equality and very many rows: pairs that are compared are hardly more than those that match."""
    from pyspark.sql import functions as F

    odd = [(i, 1, v) for i, v in enumerate([float("nan"), float("inf"), -float("inf"), None, 1e300, 1e18, 1e18 + 128, -0.0, 0.0, 4.999999999999999, 5.0, -1e-320, 9007199254740993.0, 9007199254740996.0])]
    rows = odd + [(100 + i, i % 2, i * 0.1) for i in range(400)] + [(1000, None, 1.0)]
    e = Engine(spark)
    e.register("t", spark.createDataFrame(rows, "id int, k int, x double"))
    sql = "SELECT p.id AS a, q.id AS b FROM t p JOIN t q ON p.k = q.k AND p.x < q.x AND q.x - p.x < 5"
    got = e.sql(sql)
    nan = lambda v: v != v
    less = lambda x, y: not nan(x) and (nan(y) or x < y)
    want = sorted((a, b) for a, j, x in rows for b, k, y in rows if j is not None and j == k and x is not None and y is not None and less(x, y) and y - x < 5)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 9000
    assert sorted(map(tuple, e.sql("SELECT p.id, q.id FROM t AS q INNER JOIN t AS p ON q.x - p.x < 5 AND p.k = q.k AND p.x < q.x WHERE p.id < 200").collect())) == [w for w in want if w[0] < 200]
    # 20,000 rows of one key: 200 million pairs without bins.
    e.register("u", spark.range(20000).select("id", F.lit(1).alias("k"), (F.col("id") / 8).alias("x")))
    many = e.sql(sql.replace("t p", "u p").replace("t q", "u q"))
    assert many.count() == sum(min(39, 19999 - i) for i in range(20000))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_band" in plan and "Broadcast" not in plan
    # Types and shapes of other rules are left as they are.
    assert e.sql("SELECT p.id FROM t p JOIN t q ON p.k = q.k AND p.id < q.id AND q.id - p.id < 2 OR p.id = q.id").count() > 0
    assert e.sql("SELECT * FROM t p JOIN t q ON p.k = q.k AND p.x < q.x AND q.x - p.x < 5").columns == ["id", "k", "x"] * 2
