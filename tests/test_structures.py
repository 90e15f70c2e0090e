"""Key-value structures, channels, full-text search, sources, and streams."""

import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.operators.joins import asof_join, interval_join
from quarry.operators.kv import Channels, KeyValue
from quarry.operators.search import SearchIndex, parse_query, search
from quarry.session import Engine
from quarry.sources.catalog import Catalog
from quarry.sources.storage import read_table, write_table
from quarry.streaming.events import AppendLog, event_stream, refresh_each_batch, sessions, sliding, tumbling


@pytest.fixture
def kv(spark):
    now = [1_000_000]
    out = KeyValue(Catalog(spark), clock=lambda: now[0])
    out.now = now
    return out


def test_strings(kv):
    kv.set("a", "1")
    kv.set("b", "2", ex=10)
    assert kv.get("a") == "1" and kv.ttl("a") == -1 and kv.ttl("b") == 10 and kv.ttl("none") == -2
    assert kv.expire("a", 5) and kv.get("a") == "1"
    kv.now[0] += 6_000
    assert kv.get("a") is None and kv.get("b") == "2" and kv.exists("a", "b") == 1
    kv.set("user:1", "x")
    assert kv.keys("user:?") == ["user:1"] and kv.keys("*") == ["b", "user:1"]
    assert kv.delete("b", "user:1", "none") == 2


def test_hashes_lists_sets(kv):
    assert kv.hset("h", {"f": "1", "g": "2"}) == 2 and kv.hset("h", {"f": "3"}) == 0
    assert kv.hgetall("h") == {"f": "3", "g": "2"} and not kv.hsetnx("h", "f", "9") and kv.hdel("h", "f", "x") == 1
    assert kv.rpush("l", "a", "b") == 2 and kv.lpush("l", "c", "d") == 4
    assert kv.lrange("l", 0, -1) == ["d", "c", "a", "b"] and kv.lrange("l", -2, -1) == ["a", "b"] and kv.lrange("l", 1, 2) == ["c", "a"]
    assert kv.lpop("l") == ["d"] and kv.rpop("l", 2) == ["b", "a"] and kv.llen("l") == 1
    assert kv.sadd("s", "x", "y", "x") == 2 and kv.sadd("s", "x") == 0
    assert kv.smembers("s") == {"x", "y"} and kv.sismember("s", "x") and kv.srem("s", "x", "q") == 1


def test_sorted_sets_and_streams(kv):
    assert kv.zadd("z", {"a": 2, "b": 1, "c": 3}) == 3 and kv.zadd("z", {"a": 5}) == 0
    assert kv.zrange("z", 0, -1) == ["b", "c", "a"] and kv.zrange("z", -1, -1, withscores=True) == [("a", 5.0)]
    assert kv.zrangebyscore("z", 1, 3) == ["b", "c"] and kv.zrem("z", "b") == 1
    assert [kv.xadd("x", {"k": str(i)}) for i in range(3)] == [1, 2, 3] and kv.xadd("x", {"k": "9"}, id=10) == 10
    assert kv.xrange("x", 2, 10, count=2) == [(2, {"k": "1"}), (3, {"k": "2"})] and kv.xlen("x") == 4
    with pytest.raises(ValueError):
        kv.xadd("x", {"k": "0"}, id=4)


def test_kv_tables_in_transactions(spark):
    e = Engine(spark)
    e.kv.set("a", "1")
    e.sql("BEGIN")
    e.kv.hset("h", {"f": "1"})
    e.sql("ROLLBACK")
    assert e.kv.hget("h", "f") is None
    assert [tuple(r) for r in e.sql("SELECT key, value FROM information_schema.kv_strings").collect()] == [("a", "1")]


def test_channels():
    c = Channels()
    c.subscribe("me", "news")
    c.subscribe("you", "ne*", pattern=True)
    assert c.publish("news", "hi") == 2 and c.messages("you") == [("news", "hi")] and c.numsub("news") == {"news": 1}
    c.unsubscribe("me", "news")
    assert c.publish("news", "x") == 1 and c.channels() == []


def test_search(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "a"), (2, "the lazy dog dog", "b"), (3, "quick dog", None), (4, None, None), (5, "brown quick fox", "c")], "id int, body string, note string")
    best = [r["id"] for r in search(docs, "quick dog").collect()]
    assert best[0] == 3 and set(best) == {1, 2, 3, 5}
    assert {r["id"] for r in search(docs, "+quick -fox").collect()} == {3}
    assert {r["id"] for r in search(docs, '"quick brown"').collect()} == {1}
    assert {r["id"] for r in search(docs, "note:b").collect()} == {2}
    assert search(docs, "absent").count() == 0 and parse_query("a OR b").should == [(None, "a"), (None, "b")]
    e = Engine(spark)
    e.register("d", docs)
    assert e.sql("SEARCH d 'lazy'").columns[-1] == "_score"


def test_search_splits_a_text_once(spark):
    docs = spark.createDataFrame([(1, "the die is cast, the THE die"), (2, "und die Größe größe"), (3, None), (4, "nothing")], "id int, text string")
    found = search(docs, "the die größe")
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") == 1
    assert [r["id"] for r in found.collect()] == [1, 2]
    assert [r["id"] for r in search(docs, '+die -größe "the the die"').collect()] == [1]


def test_postings_are_counted_without_a_shuffle(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from quarry.operators.search import write_segment

    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **b))[1])
    write_segment(spark.createDataFrame([(1, "b a, B a b", "x"), (2, None, ""), (3, "a", "b b")], "_row long, text string, note string"), f"{tmp_path}/s")
    assert plans and not [p for p in plans if "Exchange" in p]
    got = spark.read.parquet(f"{tmp_path}/s/postings").select("_row", "field", "term", "tf").collect()
    assert sorted(map(tuple, got)) == [(1, "note", "x", 1), (1, "text", "a", 2), (1, "text", "b", 3), (3, "note", "b", 2), (3, "text", "a", 1)]


def test_search_index_is_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    index = SearchIndex.build(docs, f"file://{tmp_path}/index")
    for q in ("license worthless", "+license -apache", "source:src1 license", '"mit license"', '+released -"mit license"', "nowhere"):
        scan, own = ([(r["doc_id"], round(r["_score"], 6)) for r in x.collect()] for x in (search(docs, q), index.search(q)))
        assert scan == own, q


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_sources(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    options = {"header": True, "inferSchema": True} if kind == "csv" else {}
    write_table(df, f"file://{tmp_path}/t", kind, **options)
    assert read_table(spark, f"file://{tmp_path}/t", kind, **options).select("id", "name").count() == 2


def test_append_log(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log")
    assert log.append("k", [{"a": "1"}, {"a": "2"}]) == [1, 2] and log.append("k", [{"a": "3"}]) == [3]
    assert [r["id"] for r in log.range("k", 2).collect()] == [2, 3] and log.length("k") == 3
    q = log.stream().writeStream.format("memory").queryName("log_out").start()
    q.processAllAvailable()
    log.append("k", [{"a": "4"}])
    time.sleep(0.1)
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM log_out").count() == 4


def test_writers_of_a_log_take_different_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/log"
    with ThreadPoolExecutor(4) as pool:
        taken = [i for ids in pool.map(lambda _: AppendLog(spark, path).append("k", [{"a": "1"}, {"a": "2"}]), range(6)) for i in ids]
    assert sorted(taken) == list(range(1, 13)) and AppendLog(spark, path).length("k") == 12


def test_joins_on_order(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), (None, 1, "n"), ("b", None, "q")], "k string, t int, v string")
    assert sorted((r["id"], r["v"]) for r in asof_join(left, right, "t", ["k"]).collect()) == [(1, "y"), (2, None), (3, None), (4, "n"), (5, None)]
    assert asof_join(left.limit(0), right, "t", ["k"]).count() == 0
    points = spark.createDataFrame([(float(x),) for x in (-1, 0, 4.9, 5, 30)], "x double")
    spans = spark.createDataFrame([(1, 0.0, 5.0), (2, -3.0, 31.0), (3, 7.0, 7.0)], "s int, lo double, hi double")
    assert sorted((r["x"], r["s"]) for r in interval_join(points, spans, "x", "lo", "hi", 4).collect()) == [(-1, 2), (0, 1), (0, 2), (4.9, 1), (4.9, 2), (5, 2), (30, 2)]
    with pytest.raises(ValueError):
        asof_join(left, right.withColumnRenamed("v", "id"), "t", ["k"])


def test_windows_stream_as_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(f"file://{tmp_path}/ev")
    stream = event_stream(spark, f"file://{tmp_path}/ev", ev.schema)
    for name, make, mode in (("tumble", lambda d, late=None: tumbling(d, late=late), "complete"), ("slide", lambda d, late=None: sliding(d, late=late), "complete"), ("sess", lambda d, late=None: sessions(d, late=late), "complete")):
        q = make(stream, "30 days").writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        key = lambda df: sorted(map(str, df.select(*[F.col(c).cast("string") for c in df.columns]).collect()))
        assert key(spark.sql(f"SELECT * FROM {name}")) == key(make(ev))


def test_refresh_each_batch(spark, tmp_path):
    seen = []
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.limit(10).coalesce(1).write.parquet(f"file://{tmp_path}/ev")
    q = refresh_each_batch(event_stream(spark, f"file://{tmp_path}/ev", ev.schema), lambda rows, i: seen.append(rows.count()), f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 10
