"""What writes leave behind: files, indexes, views, dumps; definitions of the JSON form; access."""

import pytest

from quarry.operators.dml import ConstraintError
from quarry.operators.rbac import Denied
from quarry.session import Engine

HARBOURS = """
    CREATE TABLE harbours (code TEXT PRIMARY KEY, town TEXT NOT NULL, depth DOUBLE);
    CREATE TABLE boats (hull BIGINT PRIMARY KEY, harbour TEXT, metres DOUBLE, crew INT);
    INSERT INTO harbours VALUES ('KI', 'Kiel', 11.5), ('OS', 'Oslo', 14.25), ('VI', 'Vigo', NULL);
    INSERT INTO boats VALUES (7001, 'KI', 12.0, 4), (7002, 'OS', 31.5, 9), (7003, 'OS', 8.25, 2), (7004, NULL, 19.0, 4), (7005, 'KI', 19.0, 6)"""


@pytest.fixture
def e(spark):
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_filters_orders_joins_and_windows(e):
    e.execute_batch(HARBOURS)
    assert rows(e.sql("SELECT hull FROM boats WHERE metres >= 19 AND crew < 9 ORDER BY hull DESC")) == [(7005,), (7004,)]
    assert rows(e.sql("SELECT town, hull FROM boats INNER JOIN harbours ON harbour = code WHERE crew > 3 ORDER BY metres, town")) == [("Kiel", 7001), ("Kiel", 7005), ("Oslo", 7002)]
    assert rows(e.sql("SELECT h.town, COUNT(b.hull) AS n FROM harbours h LEFT JOIN boats b ON b.harbour = h.code GROUP BY h.town ORDER BY n DESC, h.town")) == [("Kiel", 2), ("Oslo", 2), ("Vigo", 0)]
    ranked = "SELECT hull, RANK() OVER (ORDER BY metres DESC) AS r, DENSE_RANK() OVER (ORDER BY metres DESC) AS d, LEAD(hull, 2) OVER (ORDER BY hull) AS later FROM boats ORDER BY hull"
    assert rows(e.sql(ranked)) == [(7001, 4, 3, 7003), (7002, 1, 1, 7004), (7003, 5, 4, 7005), (7004, 2, 2, None), (7005, 2, 2, None)]


def test_changes_and_what_a_rollback_leaves(e):
    e.execute_batch(HARBOURS)
    assert e.sql("UPDATE boats SET crew = crew + 1, harbour = 'VI' WHERE harbour IS NULL").affected == 1
    e.execute_batch("START TRANSACTION; DELETE FROM boats WHERE metres < 15; ROLLBACK")
    assert rows(e.sql("SELECT SUM(crew), COUNT(*) FROM boats")) == [(26, 5)]
    e.execute_batch("START TRANSACTION; DELETE FROM boats WHERE metres < 15; COMMIT")
    assert rows(e.sql("SELECT hull, harbour, crew FROM boats ORDER BY hull")) == [(7002, "OS", 9), (7004, "VI", 5), (7005, "KI", 6)]


def test_writes_add_files(e):
    """What an INSERT writes doesn't depend on the table's size; parts are merged by levels; a change
    rewrites the files that it is for."""
    e.sql("CREATE TABLE big (id INT PRIMARY KEY, v INT)")
    e.sql("INSERT INTO big SELECT id, id % 10 FROM range(20000)")
    for k in range(10):
        e.sql(f"INSERT INTO big VALUES ({100_000 + k}, {k})")
    parts = e.catalog.table("big").parts
    assert len(parts) < 9 and e.sql("SELECT * FROM big").count() == 20_010
    assert e.catalog.files.size(parts[-1][0]) < 3000
    held = {f for p, _ in parts for f in e.catalog.files.inside(p)}
    assert e.sql("UPDATE big SET v = -1 WHERE id = 100009").affected == 1
    after = {f for p, _ in e.catalog.table("big").parts for f in e.catalog.files.inside(p)}
    assert len(held - after) == 1 and rows(e.sql("SELECT v FROM big WHERE id >= 100008 ORDER BY id")) == [(8,), (-1,)]
    assert e.sql("DELETE FROM big WHERE id IN (SELECT id FROM big WHERE v = 3 AND id < 100)").affected == 10
    assert e.sql("REPLACE INTO big VALUES (100000, 77), (7, 78), (555555, 79)").affected == 3
    assert rows(e.sql("SELECT v FROM big WHERE id IN (100000, 7, 555555) ORDER BY v")) == [(77,), (78,), (79,)]
    assert e.sql("SELECT * FROM big").count() == 20_010 - 10 + 1
    assert e.vacuum() > 0 and e.sql("SELECT * FROM big").count() == 20_001


def test_failed_change_leaves_the_table(e):
    e.execute_batch("CREATE TABLE k (id INT PRIMARY KEY); INSERT INTO k VALUES (1), (2)")
    with pytest.raises(ConstraintError):
        e.sql("UPDATE k SET id = 1 WHERE id IN (SELECT MAX(id) FROM k)")
    assert e.sql("SELECT * FROM k").columns == ["id"] and rows(e.sql("SELECT * FROM k ORDER BY id")) == [(1,), (2,)]


def test_two_engines_on_one_session(spark):
    """Tables of one name, planned in turn."""
    one, two = Engine(spark), Engine(spark)
    one.execute_batch("CREATE TABLE same (a INT); INSERT INTO same VALUES (1)")
    two.execute_batch("CREATE TABLE same (b TEXT); INSERT INTO same VALUES ('x'), ('y')")
    first, second = one.sql("SELECT a FROM same"), two.sql("SELECT same.b FROM same ORDER BY b")
    assert rows(first) == [(1,)] and rows(second) == [("x",), ("y",)]
    assert not [t for t in spark.catalog.listTables() if t.name == "same"]


def test_json_columns_of_any_name(e, spark):
    e.execute_batch("""CREATE TABLE notes (id INT, body JSON, extra TEXT); INSERT INTO notes VALUES (1, '{"a": {"b": 5}}', '{"k": "v"}'), (2, NULL, 'no json')""")
    assert rows(e.sql("SELECT id FROM notes WHERE body.a.b = 5")) == [(1,)]
    assert rows(e.sql("SELECT n.extra.k FROM notes n ORDER BY n.id")) == [("v",), (None,)]
    e.register("given", spark.createDataFrame([(1, '{"x": 3}', "t")], "id int, attrs string, text string"))
    assert rows(e.sql("SELECT attrs.x, text.id FROM given AS text")) == [("3", 1)]
    assert rows(e.ir({"Select": {"table": "given", "columns": [{"expr": {"Column": "attrs.x"}, "alias": "x"}]}})) == [("3",)]
    assert rows(e.sql("SELECT 2 + 3 AS s FROM dual")) == [(5,)]


def test_search_follows_writes(e):
    e.execute_batch("CREATE TABLE posts (id INT PRIMARY KEY, body TEXT); INSERT INTO posts VALUES (1, 'red kite over the hill'), (2, 'a red red fox')")
    found = lambda q: [r["id"] for r in e.sql(f"SEARCH posts '{q}'").collect()]
    assert found("red") == [2, 1] and found("+red -fox") == [1] and found('"kite over"') == [1]
    segments = dict(e.catalog.state.segments)
    e.sql("INSERT INTO posts VALUES (3, 'kite')")
    assert found("kite") == [3, 1] and segments.items() <= e.catalog.state.segments.items()
    e.sql("UPDATE posts SET body = 'blue heron' WHERE id = 1")
    assert found("kite") == [3] and found("heron") == [1]
    e.sql("DELETE FROM posts WHERE id = 3")
    assert found("kite") == [] and e.vacuum() > 0 and found("fox") == [2]


def test_definitions_of_the_json_form(e):
    column = lambda n, t, **more: {"name": n, "data_type": t, **more}
    pick = lambda t, *cs: {"table": t, "columns": [{"expr": {"Column": c}} for c in cs]}
    e.ir({"CreateTable": {"name": "g", "columns": [column("id", "Int", is_auto_increment=True), column("name", {"VarChar": 20}, is_not_null=True, default_value={"Text": "none"}), column("price", {"Decimal": [8, 2]}), column("kind", {"Enum": ["a", "b"]})], "primary_key": ["id"], "foreign_keys": []}})
    e.ir({"CreateTable": {"name": "h", "columns": [column("g_id", "Int")], "primary_key": None, "foreign_keys": [{"name": "fk", "columns": ["g_id"], "ref_table": "g", "ref_columns": ["id"]}]}})
    e.sql("INSERT INTO g (price, kind) VALUES (1.5, 'a'), (2.25, 'b')")
    assert rows(e.sql("SELECT id, name, CAST(price AS STRING), kind FROM g ORDER BY id")) == [(1, "none", "1.50", "a"), (2, "none", "2.25", "b")]
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO h VALUES (9)")
    e.ir({"CreateIndex": {"name": "u", "table": "g", "expressions": [{"ScalarFunc": {"name": "Lower", "args": [{"Column": "kind"}]}}], "unique": True, "index_type": "Hash", "where_clause": {"Comparison": [{"Column": "price"}, "Gt", {"Literal": {"Int": 2}}]}}})
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO g (price, kind) VALUES (9, 'b')")
    for action in ({"AddColumn": column("note", "Text")}, {"RenameColumn": {"old_name": "note", "new_name": "remark"}}, {"SetDefault": {"column": "remark", "value": {"Text": "r"}}}, {"ModifyColumn": {"name": "id", "data_type": "BigInt"}}, {"SetNotNull": {"column": "price"}}, {"DropNotNull": {"column": "price"}}, {"AlterEngine": {"engine": "x"}}, {"AlterCharset": {"charset": "utf8"}}):
        e.ir({"AlterTable": {"table": "g", "action": action}})
    e.sql("INSERT INTO g (price) VALUES (3)")
    assert rows(e.sql("SELECT remark FROM g ORDER BY id")) == [(None,), (None,), ("r",)] and dict(e.sql("SELECT * FROM g").dtypes)["id"] == "bigint"
    e.ir({"AlterTable": {"table": "h", "action": {"DropForeignKey": {"name": "fk"}}}})
    e.sql("INSERT INTO h VALUES (9)")
    e.ir({"AlterTable": {"table": "h", "action": {"RenameTable": "hh"}}})
    e.ir({"CreateMaterializedView": {"name": "m", "query": {"table": "g", "columns": [{"expr": {"FunctionCall": {"name": "Count", "args": ["Star"]}}, "alias": "n"}]}}})
    e.sql("DELETE FROM g WHERE remark = 'r'")
    assert rows(e.sql("SELECT n FROM m")) == [(2,)]
    e.ir({"CreateTrigger": {"name": "t", "timing": "Before", "event": "Insert", "table": "g", "body": "Begin"}})
    assert e.catalog.state.triggers["t"]["timing"] == "BEFORE"
    e.ir({"DropTrigger": {"name": "t"}})
    e.ir({"CreateProcedure": {"name": "p", "params": [{"name": "k", "data_type": "Int", "mode": "In"}], "body": {"Select": {**pick("g", "id"), "where_clause": {"Comparison": [{"Column": "id"}, "Gte", {"Column": "k"}]}}}}})
    assert rows(e.ir({"Call": {"name": "p", "args": [{"Literal": {"Int": 2}}]}})) == [(2,)] and sorted(rows(e.sql("CALL p(1)"))) == [(1,), (2,)]
    e.ir({"CreateFunction": {"name": "f", "params": [{"name": "x", "data_type": "Int", "mode": "In"}], "return_type": "Int", "body": {"Select": {"table": "", "columns": [{"expr": {"BinaryOp": [{"Column": "x"}, "Mul", {"Literal": {"Int": 3}}]}, "alias": "v"}]}}}})
    assert rows(e.sql("CALL f(7)")) == [(21,)]
    e.ir({"DropProcedure": {"name": "p"}})
    e.ir({"DropFunction": {"name": "f"}})
    assert not e.catalog.state.routines
    # Views are in the catalog: in transactions, information_schema and snapshots.
    e.sql("BEGIN")
    e.ir({"CreateView": {"name": "v", "query": pick("g", "id", "kind"), "columns": ["no", "what"], "with_check_option": False}})
    assert rows(e.sql("SELECT what FROM v WHERE no = 2")) == [("b",)] and ("v", "VIEW") in rows(e.sql("SELECT table_name, table_type FROM information_schema.tables"))
    e.sql("ROLLBACK")
    assert "v" not in e.catalog.state.views
    having = {"table": "g", "columns": [{"expr": {"Column": "kind"}}], "group_by": [{"Column": "kind"}], "having": {"InSubquery": [{"FunctionCall": {"name": "Max", "args": [{"Column": "id"}]}}, pick("g", "id")]}}
    assert sorted(rows(e.ir({"Select": having}))) == [("a",), ("b",)]


def test_key_value_access(e):
    e.execute_batch("CREATE USER kim IDENTIFIED BY 'pw'")
    e.kv.set("a", "1")
    kim = e.as_user("kim", "pw")
    for denied in (lambda: kim.kv.get("a"), lambda: kim.kv.set("a", "2"), lambda: kim.ir({"KvDel": {"keys": ["a"]}}), lambda: kim.ir({"KvGet": {"key": "a"}})):
        with pytest.raises(Denied):
            denied()
    e.sql("GRANT SELECT, INSERT ON *.* TO kim")
    kim.kv.set("a", "2")
    assert kim.ir({"KvGet": {"key": "a"}}) == "2"
    with pytest.raises(Denied):
        kim.kv.delete("a")


def test_key_value_log(e):
    """Commands add their own rows; merged logs and marks of what is gone give the same structures."""
    for k in range(10):
        e.kv.hset("h", {f"f{k % 4}": str(k)})
    e.kv.hdel("h", "f0")
    assert e.kv.hgetall("h") == {"f1": "9", "f2": "6", "f3": "7"}
    parts = e.catalog.state.stores["kv_hash"].parts
    assert len(parts) < 8 and max(level for _, level in parts) == 1
    e.kv.hset("h", {"f0": "again"})
    assert e.kv.hget("h", "f0") == "again" and e.vacuum() > 0 and e.kv.hgetall("h")["f3"] == "7"


def test_dump_of_any_text(e, spark, tmp_path):
    e.sql("CREATE TABLE d (id INT, said TEXT)")
    said = ["plain", "it's", "two\nlines", "back \\ slash \\n", "NULL", "('x', NULL);", "", None]
    for k, text in enumerate(said):
        e.sql("INSERT INTO d VALUES (?, ?)", [k, text])
    e.dump_to(f"file://{tmp_path}/dump")
    other, third = Engine(spark), Engine(spark)
    other.restore_from(f"file://{tmp_path}/dump")
    third.restore(e.dump())
    assert rows(other.sql("SELECT said FROM d ORDER BY id")) == rows(third.sql("SELECT said FROM d ORDER BY id")) == [(x,) for x in said]


def test_vacuum_where_the_folder_has_no_scheme(spark, tmp_path):
    e = Engine(spark, root=f"{tmp_path}/with space")
    e.execute_batch("CREATE TABLE v (id INT); INSERT INTO v VALUES (1); INSERT INTO v VALUES (2); UPDATE v SET id = 3 WHERE id = 2")
    e.kv.set("a", "1")
    assert e.vacuum() > 0
    assert sorted(rows(e.sql("SELECT id FROM v"))) == [(1,), (3,)] and e.kv.get("a") == "1" and e.vacuum() == 0
