"""Near-duplicates, suffix-array dedup, components: brute force and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF
from llm.edges import edge_docs, empty_like
from pyspark.sql import functions as F

from quarry.llm import common, graph, neardup, pipeline, suffixdedup, suffixsort


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def slow_components(docs, size, limit=80):
    """Every pair of rows compared."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= limit * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else low[find(k)], True if i is None else low[find(k)] == i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, size=size).collect()), key=str)
    assert got == slow_components([(r["doc_id"], r["text"]) for r in docs.collect()], size)


def variants(n, seed=1):
    """Copies of one text with more and more words changed, and chains of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((i * 3, " ".join(words)))
        if i % 10 == 0:
            base[rng.randrange(120)] = f"y{i}"
    return out


def test_groups_of_variants(spark, monkeypatch):
    rows = variants(160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows, 4)
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, size=4).collect()), key=str) == want
    # The same in blocks of a few rows: what joins them meets in pairs of blocks.
    for rows_, rounds in ((16, 3), (16, 0), (5, 1)):
        monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_)
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        assert sorted((tuple(r) for r in neardup.near_duplicates(df, size=4).collect()), key=str) == want


def test_a_group_of_near_copies_is_moved_once(spark, monkeypatch):
    """What links to a representative meets nothing else: blocks don't multiply a large group."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:150], *[f"y{i}{k}" for k in range(50)]])) for i in range(3)]
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    held = {}
    placed = neardup._placed

    def watched(stars, near, limit):
        out, edges = placed(stars, near, limit)
        held["members"], held["moved"] = stars.count(), out.count()
        return out, edges

    monkeypatch.setattr(neardup, "_placed", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.near_duplicates(df, size=4).collect()), key=str) == slow_components(rows, 4)
    assert held["members"] > 400 and held["moved"] < held["members"]


def test_near_duplicate_edges(spark):
    docs = edge_docs(spark).withColumns({"component_id": F.lit("c"), "sig": F.lit(0)})
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == slow_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    assert neardup.near_duplicates(empty_like(docs)).count() == 0


def test_linked_and_identical_rows_under_one_id(spark):
    """Texts of one doc_id are judged apart, and of identical rows one stays."""
    words = [f"w{i}" for i in range(60)]
    a, near, other, same = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"o{i}" for i in range(30)), " ".join(f"s{i}" for i in range(30))
    rows = [(3, near), (9, a), (9, other), (12, same), (12, same), (15, same), (20, other + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "src", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (9, 3, False), (9, 9, True), (12, 12, False), (12, 12, True), (15, 12, False), (20, 9, False)]
    left = sorted((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs, SF).collect())
    assert left == [(3, near), (9, other), (12, same)]


def test_pruning_keeps_what_may_reach_the_threshold():
    for n, m in neardup.least_matches(0.8, 1e-8):
        below = sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert below < 1e-8
    assert neardup.least_matches(0.8, 1e-8)[-1][1] < 0.8 * neardup.HASHES


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = neardup.signature(np.concatenate((shared, a))), neardup.signature(np.concatenate((shared, b)))
    assert abs((x == y).mean() - 0.8) < 0.12


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(40)] + [(200, 200), (None, 3), (7, None)] + [(900, i) for i in range(901, 960)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in root if find(x) != x} and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(5000)], "x long")
    import pyarrow as pa

    held = common.id_filter(df, "x")
    assert held.has(pa.array([i * 7 for i in range(5000)])).all()
    assert held.has(pa.array([i * 7 + 1 for i in range(5000)])).mean() < 0.05
    assert not held.has(pa.array([None], pa.int64())).any()


# Suffix-array dedup ---------------------------------------------------------------------------


def slow_suffix(docs, length=100):
    """Every window of every text, in order."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def test_suffix_dedup(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert digest(suffixdedup.suffix_dedup(docs)) == slow_suffix([(r["doc_id"], r["text"]) for r in docs.collect()])


def passages(n, seed=2):
    """Texts that share passages whole, in part, shifted, and many times."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    common_ = [" ".join(word() for _ in range(rng.randrange(10, 80))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(common_)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [" ".join(word() for _ in range(rng.randrange(0, 12))), rng.choice([p, p[a:b], "ab " * rng.randrange(60)])]
        rows.append((i, "|".join(parts)))
    return rows


@pytest.mark.parametrize("many", [2000, 3])
def test_suffix_passages(spark, monkeypatch, many):
    """Also with nearly every anchor taken window by window."""
    monkeypatch.setattr(suffixdedup, "MANY_RUNS", many)
    rows = passages(120)
    assert digest(suffixdedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == slow_suffix(rows)


def test_suffix_segments(spark, monkeypatch):
    """Texts longer than a segment are the same as in one piece."""
    rows = passages(30, seed=9)
    want = slow_suffix(rows)
    monkeypatch.setattr(suffixdedup, "SEGMENT", 64)
    out = [(i, *suffixdedup.runs(t.encode(), 100)) for i, t in rows if len(t.encode()) >= 100]
    assert all(int(x[4].sum()) == len(dict(rows)[x[0]].encode()) - 99 for x in out)
    assert digest(suffixdedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_suffix_common_anchor_far_on(spark, monkeypatch):
    """Window by window beyond position 2**23 the same goes as by the suffix sort."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(160))
    parts = [np.random.default_rng(8).integers(97, 123, (1 << 23) + 100, dtype=np.uint8).tobytes().decode()]
    for k in range(12):  # different runs around the same anchors
        parts += [passage[k : 150 + k % 5], f" {k} " * 5]
    docs = spark.createDataFrame([(1, "".join(parts)), (2, passage)], "doc_id long, text string")
    want = digest(suffixdedup.suffix_dedup(docs))
    monkeypatch.setattr(suffixdedup, "MANY_RUNS", 3)
    assert digest(suffixdedup.suffix_dedup(docs)) == want and want[0][2] > 1000


def test_suffix_edges(spark):
    docs = edge_docs(spark).withColumns({"spans": F.lit("s"), "anchor": F.lit(1)})
    got = digest(suffixdedup.suffix_dedup(docs))
    rows = sorted([(r["doc_id"], r["text"]) for r in docs.collect()], key=lambda r: str(r))
    # Of rows with one id the order among themselves is the operator's own: sums are compared.
    want = slow_suffix(rows)
    total = lambda xs, i: sum(x[2] for x in xs if x[0] == i)
    for i in (None, 1, 2, 3, 4, 5, 6, 7, 8):
        assert total(got, i) == total(want, i)
    assert len(got) == docs.count() and suffixdedup.suffix_dedup(empty_like(docs)).count() == 0
    distinct = docs.filter("doc_id is not null and doc_id not in (6, 9)")
    assert digest(suffixdedup.suffix_dedup(distinct)) == slow_suffix([(r["doc_id"], r["text"]) for r in distinct.collect()])


def test_suffix_sort():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1300] = text[2000:2300]
    order = suffixsort.SuffixOrder(text, 50)
    starts = np.arange(len(text) - 50)
    lists = np.sort(rng.integers(0, 20, len(starts)))
    along, classes = order.classes(starts, lists)
    keys = [(lists[k], bytes(text[starts[k] : starts[k] + 50])) for k in along]
    assert keys == sorted(keys)
    assert all((keys[k] == keys[k + 1]) == (classes[k] == classes[k + 1]) for k in range(len(keys) - 1))
    assert len(order.sort(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_suffix_sort_verifies(monkeypatch):
    """Equal hashes of different strings are found out."""
    order = suffixsort.SuffixOrder(np.frombuffer(b"abcdefgh" * 20, np.uint8), 8)
    monkeypatch.setattr(order, "extension", lambda a, b: np.full(len(a), 8))
    with pytest.raises(ArithmeticError):
        order.classes(np.array([0, 1]), np.array([0, 0]))


def test_folding_goes_by_a_salted_digest_of_the_bytes():
    """Runs of other bytes, or under another salt, have other digests; equal ones have equal anchors too."""
    text = bytes(np.random.default_rng(1).integers(97, 123, 4000, dtype=np.uint8)) * 2
    anchor, run, start, count = suffixdedup.runs(text, 100, b"one")
    seen = {}
    for a, r, i, n in zip(anchor.tolist(), run.tolist(), start.tolist(), count.tolist(), strict=True):
        assert seen.setdefault(r, (a, text[i : i + n + 99])) == (a, text[i : i + n + 99])
    assert len(seen) < len(run) and not set(run.tolist()) & set(suffixdedup.runs(text, 100, b"two")[1].tolist())


def test_characters_go_whole():
    text = "aé�bü".encode()
    assert suffixdedup.kept_bytes(text, [(2, 3)], True) == ("a�bü".encode(), 2, 1)
    assert suffixdedup.kept_bytes(text, [(1, 2), (4, 5)], True) == ("abü".encode(), 5, 1)
    assert suffixdedup.kept_bytes(text, [(7, 8)], True) == ("aé�b".encode(), 2, 1)
    assert suffixdedup.kept_bytes(text, [], True) == (text, 0, 0) and suffixdedup.kept_bytes(b"", [], True) == (b"", 0, 0)


def test_spans():
    doc, start, end = suffixdedup.joined_spans(np.array([1, 1, 0, 1]), np.array([5, 0, 3, 9]), np.array([9, 4, 4, 12]))
    assert list(zip(doc, start, end, strict=True)) == [(0, 3, 4), (1, 0, 4), (1, 5, 12)]
    assert suffixdedup.kept_bytes(b"0123456789", [(2, 4), (4, 5), (8, 10)]) == (b"01567", 5, 2)
