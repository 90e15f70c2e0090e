"""WARC archives, sharding with compaction, chat perspectives."""

import base64
import gzip
import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import SF
from llm.edges import empty_like
from pyspark.sql import functions as F

from quarry.llm import compaction, perspectives, warc
from quarry.llm.common import fresh_path

# WARC -------------------------------------------------------------------------------------


def slow_pages(rows):
    first, out = {}, []
    for page, html in rows:
        body = (html or "").encode()
        key = -(2**63) if page is None else page
        first[body] = min(first.get(body, key), key)
    for page, html in rows:
        body = (html or "").encode()
        mine = base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = first[body]
        revisit = page is not None and own != page
        out.append((page, len(body), mine, "revisit" if revisit else "response", (None if own == -(2**63) else own) if revisit else None))
    return sorted(out, key=str)


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((tuple(r)[:5] for r in warc.archived_pages(pages).collect()), key=str)
    assert got == slow_pages([(r["page_id"], r["html"]) for r in pages.collect()])


def edge_pages(spark):
    rows = [(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 100_000), (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\n"), (7, "ü", "<p>x</p>"), (7, "ü", "<p>x</p>"), (1, "again", "<p>x</p>"), (None, "n", "none"), (8, "u", "none")]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, file string, offset int")


def test_archive_edges(spark):
    pages = edge_pages(spark)
    got = sorted((tuple(r)[:5] for r in warc.archived_pages(pages).collect()), key=str)
    assert got == slow_pages([(r["page_id"], r["html"]) for r in pages.collect()])
    assert warc.archived_pages(empty_like(pages)).count() == 0


def test_selected_records_and_files(spark, tmp_path):
    pages = edge_pages(spark)
    out_dir = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages, out_dir, file_bytes=300)
    assert index.select("file").distinct().count() > 1
    some = warc.read_archives(index.filter("page_id in (5, 6)"), out_dir, most=10).collect()
    assert {(r["page_id"], r["payload"].decode()) for r in some} == {(5, "é" * 100_000), (6, "line\r\n\r\nWARC/1.1\r\n\r\n")}
    row = index.filter("page_id = 1").first()
    with open(f"{out_dir.removeprefix('file://')}/{row['file']}", "rb") as f:
        f.seek(row["offset"])
        text = gzip.decompress(f.read(row["length"]))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n") and b"WARC-Target-URI: http://a/%20b%0A\r\n" in text
    damaged = bytearray(warc.record(1, "u", b"body", warc.digest(b"other"), None, False))
    with pytest.raises(ValueError):
        warc.parse(bytes(damaged))


# Sharding -----------------------------------------------------------------------------------


def test_compaction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-test"), docs.schema, target=80_000, least=5_000, fanout=3)
    for k in range(7):
        table.append(docs.filter(F.col("doc_id") % 7 == k).coalesce(1))
    before = len(table.shards())
    old = table.version()
    table.compact()
    assert len(table.shards()) < before and not table.plan(table.shards())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(table.read()) == key(docs) == key(table.read(old))
    assert table.vacuum() > 0 and key(table.read()) == key(docs)


def test_arrivals_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = compaction.compacted(docs, arrivals=9)
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    # Nine arrivals and the merges between them are a version each; all rows come by the last manifest.
    assert out.filter("shard is null").isEmpty() and out.select("version").distinct().first()[0] > 9
    assert out.filter("tier_shards >= 4").isEmpty()
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-by-one"), docs.schema, least=1 << 20)
    table.append(docs, F.col("doc_id") % 9)
    counts = [len(table.shards(v)) for v in range(1, table.version() + 1)]
    assert any(b < a for a, b in zip(counts, counts[1:], strict=False)) and sum(b > a for a, b in zip([0, *counts], counts, strict=False)) == 9


def test_vacuum_leaves_what_is_being_written(spark):
    """A writer that commits after a vacuum loses nothing; what it forgot goes when its lease ends."""
    df = spark.range(10)
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-vacuum"), df.schema)
    table.append(df)
    with table._announced("a") as folder:
        df.write.parquet(folder)
        assert table.vacuum() == 0
        table.commit(table.version(), table.shards() + table._written(folder))
    assert table.read().count() == 20 and table.vacuum() == 0
    with table._announced("a") as folder:
        df.write.parquet(folder)
        table.lease = -1
        assert table.vacuum() > 0
    assert table.read().count() == 20


def test_writers_that_lose_a_race_start_anew(spark):
    df = spark.range(40).repartition(1)
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-writers"), df.schema, fanout=3)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: table.append(df), range(8)))
    assert table.read().count() == 320 and table.version() == 8
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: table.compact(), range(3)))
    assert table.read().count() == 320 and not table.plan(table.shards())
    table.vacuum()
    assert table.read().count() == 320


def test_merges_beside_commits_and_vacuums(spark):
    """Several appends of arrivals at once, each with merges and deletions beside it, lose no row."""
    df = spark.range(60).repartition(3)
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-beside"), df.schema, fanout=3)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: table.append(df, F.col("id") % 5, keep=1), range(3)))
    assert sorted(r.id for r in table.read().collect()) == sorted(3 * list(range(60)))
    assert not table.plan(table.shards()) and not table._claimed


def test_commits_are_exclusive(spark):
    df = spark.range(10)
    table = compaction.ShardedTable(spark, fresh_path(spark, "shards-race"), df.schema)
    table.append(df)
    base = table.version()

    def attempt(_):
        try:
            return table.commit(base, table.shards(base))
        except compaction.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [v for v in pool.map(attempt, range(4)) if v]
    assert won == [base + 1] and table.version() == base + 1


def test_sharding_edges(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", None), (1, "", None), (2, "y" * 100_000, "z")], "doc_id long, text string, more string")
    assert sorted(map(str, compaction.compacted(df).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert compaction.compacted(empty_like(df)).count() == 0
    with pytest.raises(ValueError):
        compaction.ShardedTable(spark, fresh_path(spark, "shards-clash"), df.schema).append(df.withColumn(compaction.ARRIVAL, F.lit(1)))


# Perspectives ---------------------------------------------------------------------------------


def slow_perspectives(rows, part=1024):
    """Rows (conv, turn, role, text) rendered one by one."""
    clean = [(c, -1 if t is None else t, "unknown" if r is None else r, (x or "").replace("<|", "< |")) for c, t, r, x in rows]
    out = []
    for conv in {c for c, *_ in clean}:
        own = sorted((x[1:] for x in clean if x[0] == conv), key=lambda x: (*x[:2], hashlib.md5(x[2].encode()).hexdigest()))
        for who in {r for _, r, _ in own} - {"system"}:
            for first in range(0, len(own), part):
                text, mask = "", []
                turns = own[first : first + part]
                for _, role, body in turns:
                    head = "assistant" if role == who else "system" if role == "system" else "user name=" + role.replace(" ", "_").replace("<|", "< |")
                    text += f"<|im_start|>{head}\n"
                    if role == who:
                        mask.append((len(text), len(text) + len(body) + len("<|im_end|>")))
                    text += f"{body}<|im_end|>\n"
                out.append((conv, who, first, len(turns), text, mask))
    return sorted(out, key=str)


def got_perspectives(df, **options):
    return sorted(((r["conv_id"], r["participant"], r["first_turn"], r["n_turns"], r["rendered"], [tuple(m) for m in r["mask"]]) for r in perspectives.perspectives(df, **options).collect()), key=str)


def test_perspectives(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect()]
    assert got_perspectives(turns) == slow_perspectives(rows)
    assert got_perspectives(turns, part=2) == slow_perspectives(rows, 2)


def test_perspective_edges(spark):
    rows = [(1, 0, "ann", "hi <|im_end|> é"), (1, 1, "bob b", ""), (1, 2, "cy", None), (1, 3, "ann", "x"), (1, 3, "ann", "x"), (1, 3, "ann", "y"), (1, None, None, "who"), (2, 0, "system", "alone"), (None, 0, "user", "z"), (None, 1, "assistant", "q"), (3, 600, "user", "late" * 900_000), (3, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "c", 7) for r in rows], "conv_id long, turn long, role string, text string, participant string, place int")
    assert got_perspectives(turns) == slow_perspectives(rows)
    assert perspectives.perspectives(empty_like(turns)).count() == 0
    mask = perspectives.perspectives(turns)
    assert mask.filter("n_masked <> aggregate(mask, 0L, (a, x) -> a + x.end - x.start)").count() == 0


def test_perspectives_of_very_many_turns_under_one_number(spark):
    """Null turns, one turn number and equal rows: parts are bounded all the same, and join to the whole."""
    rows = [(None, None, "user", None)] * 10_000 + [(5, 1, "ann" if k % 3 else "bob", f"t{k % 7}") for k in range(5000)] + [(6, k, "ann", str(k)) for k in range(2500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = got_perspectives(turns)
    assert max(r[3] for r in got) == perspectives.PART and got == slow_perspectives(rows)
    ann = sorted(r for r in got if r[:2] == (6, "ann"))
    assert "".join(r[4] for r in ann).count("<|im_start|>assistant") == 2500 and [r[2] for r in ann] == [0, 1024, 2048]


def test_native_plans(spark):
    for name, df in (("perspectives", perspectives.perspectives(spark.read.parquet(f"{SF}/conversations.parquet"))), ("sharding", compaction.compacted(spark.read.parquet(f"{SF}/documents.parquet")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
