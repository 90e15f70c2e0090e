"""The corpus pipeline, and the SQL of the operators' queries."""

import hashlib

import pytest
from compare import difference, duck
from conftest import SF
from llm.edges import edge_docs
from llm.test_dedup import slow_components, slow_suffix
from llm.test_text_operators import check_packing, slow_contaminated

import corpus_pipeline
from quarry.llm import pipeline, queries
from quarry.llm.common import saved


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_sql(spark, key):
    assert difference(spark, duck(SF), queries.QUERIES[key], queries.ORACLES[key], SF) == ""


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = queries.table(spark, SF, "documents")
    toxic = saved(pipeline.toxicity(spark, docs, SF), "t")
    assert toxic.columns == docs.columns
    near = saved(pipeline.near_dedup(spark, toxic, SF), "n")
    kept = {r[0] for r in slow_components(rows(toxic), 5) if r[3]}
    assert {i for i, _ in rows(near)} == kept
    cut = saved(pipeline.suffix_removal(spark, near, SF), "s")
    assert cut.columns == docs.columns and cut.count() == near.count()
    before, after = dict(rows(near)), dict(rows(cut))
    for i, n_bytes, n_removed, _, sha in slow_suffix(rows(near)):
        left = after[i].encode()
        if hashlib.sha256(left).hexdigest() != sha:  # a character was cut in part
            assert n_bytes - n_removed - 6 <= len(left) <= n_bytes - n_removed
        if not n_removed:
            assert after[i] == before[i]
    clean = saved(pipeline.decontamination(spark, cut, SF), "d")
    found = {x[0] for x in slow_contaminated(rows(cut), [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()])}
    assert {i for i, _ in rows(clean)} == {i for i, _ in rows(cut)} - found and found
    from quarry.llm.tokens import encoder
    import numpy as np

    encode = encoder(queries.TOKENIZER)
    expected = {i: np.frombuffer(encode.encode(t.encode()) + np.array([1], "<u4").tobytes(), "<u4") for i, t in rows(clean)}
    assert check_packing(pipeline.packing(spark, clean, SF).collect(), expected) == 0


def test_own_replacement_characters_stay(spark):
    """A cut through a character takes that one only."""
    shared = "".join(chr(0x100 + k) for k in range(60))
    docs = spark.createDataFrame([(1, f"{shared} one", "en", "s", 1), (2, f"� two {chr(0x140)}{shared[1:]} �", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    after = dict(rows(pipeline.suffix_removal(spark, docs, SF)))
    assert after[1] == rows(docs)[0][1] and after[2].count("�") == 2 and after[2] == "� two �"


def test_scratch_tables_go(spark):
    from quarry.llm import common

    before = set(_files(spark))
    out = corpus_pipeline.run(spark, SF)
    left = set(_files(spark)) - before
    assert left == {out.quarry_path.rpartition("/")[2]} and common._written == []


def _files(spark):
    from quarry.llm import common

    path = spark._jvm.org.apache.hadoop.fs.Path(common.fresh_path(spark, "x")).getParent()
    return [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def test_toxicity_stage(spark):
    """What goes is labelled toxic, what stays isn't, but for a few."""
    folder = SF.replace("0.001", "0.01")
    docs = queries.table(spark, folder, "documents")
    kept = {i for i, _ in rows(pipeline.toxicity(spark, docs, folder))}
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, folder, "labels").collect()}
    wrong = sum((i in kept) == bool(y) for i, y in labels.items())
    assert wrong / len(labels) < 0.08 and len(kept) < docs.count()


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_edges(spark):
    docs = edge_docs(spark)
    for _, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "edge")
    assert docs.count() > 0
