"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly.

Items are partitioned by the size of their shingle set.  An item's sketch is its
``n - ceil(t * n) + 1`` smallest MinHash values of ``n`` shingles (a bottom-k signature): a document that
contains the share ``t`` of the item must contain one of them, however long the document is, so the
search loses nothing (banded signatures would: a short item's Jaccard similarity to a long document
is near 0).  A document's own hashes above the largest sketch hash of a size partition are never
looked up in it.  Candidates are verified on all their shingles.

Up to ``RESIDENT_BYTES`` of benchmark text the sketches travel with the tasks.  Beyond it, the same
sketches meet in a join by partition and hash, for which documents send only hashes that a filter of
bounded size may know; candidates are verified by counting their common 64-bit shingle hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; items of fewer than ``size`` words are
one shingle of all their words, items without words match nothing, null texts are empty.
Null and repeated ids are reported row by row.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_filter, other_work, saved, scratch, shingle_hashes, utf8, word_hashes

#: Bytes of benchmark text up to which items travel with the tasks; beyond it, shuffle joins.
RESIDENT_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, n_item_shingles long, n_shared long"


def shingle_set(text: bytes | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, as tuples of words."""
    words = (text or b"").lower().split()
    width = min(size, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def needed(n: int, threshold: float) -> int:
    """Shared shingles that make a containment of ``threshold``."""
    return math.ceil(threshold * n - 1e-9)


class Sketches:
    """Sketch tables by shingle width and size class, for lookups with numpy."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.items = [(i, shingle_set(t, size)) for i, t in items]
        tables: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            words = word_hashes(text or b"")
            if len(words):
                hashes = shingle_hashes(words, size)
                key = min(size, len(words)), len(hashes).bit_length()
                tables.setdefault(key, []).extend((h, k) for h in hashes[: _sketch_size(len(hashes), threshold)].tolist())
        self.tables = [(width, np.array([h for h, _ in rows], np.uint64), np.array([k for _, k in rows])) for (width, _), found in sorted(tables.items()) for rows in [sorted(found)]]

    def candidates(self, text: bytes | None) -> list[int]:
        """Items of which the text holds a sketch hash."""
        words = word_hashes(text or b"")
        found: set[int] = set()
        for width in {t[0] for t in self.tables}:
            if len(words) < width:
                continue
            own = shingle_hashes(words, width)
            for w, hashes, at in self.tables:
                if w == width:
                    low = own[: np.searchsorted(own, hashes[-1], "right")]
                    place = np.searchsorted(low, hashes)
                    place[place == len(low)] = 0
                    if len(low):
                        found.update(at[low[place] == hashes].tolist())
        return sorted(found)

    def verified(self, text: bytes | None) -> list[tuple[int | None, int, int]]:
        """(item, its shingles, shared ones) of the items that the text contains."""
        out, sets = [], {}
        for k in self.candidates(text):
            item, wanted = self.items[k]
            width = len(next(iter(wanted)))
            if width not in sets:
                sets[width] = shingle_set(text, width)
            shared = len(wanted & sets[width])
            if shared >= needed(len(wanted), self.threshold):
                out.append((item, len(wanted), shared))
        return out


def _rows(ids: list, found: list[list[tuple]]) -> pa.RecordBatch:
    flat = [(i, *x) for i, xs in zip(ids, found, strict=True) for x in xs]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else [[]] * 4)], names=[x.split()[0] for x in FOUND.split(", ")])


@bounded_batches
def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """All (doc_id, item_id) with at least ``threshold`` of the item's shingles in the document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = items.select(F.col("item_id").cast("long"), "text")
    own = _resident(items, resident_bytes)
    if own is None:
        return _by_shuffle(docs, items, size, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        sketches = Sketches(own, size, threshold)
        for batch in batches:
            yield _rows(batch.column("doc_id").to_pylist(), [sketches.verified(t) for t in utf8(batch.column("text"))])

    return docs.mapInArrow(run, FOUND)


def _resident(items: DataFrame, most: int) -> list[tuple[int | None, bytes | None]] | None:
    """The items, if their size lets them travel with the tasks."""
    if (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0) > most:
        return None
    return [(r["item_id"], r["text"].encode() if r["text"] is not None else None) for r in items.collect()]


@bounded_batches
def clean_documents(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, resident_bytes: int = RESIDENT_BYTES) -> DataFrame:
    """The rows, all columns kept, that contain no item."""
    items = items.select(F.col("item_id").cast("long"), "text")
    own = _resident(items, resident_bytes)
    if own is None:
        marked = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-marked")
        found = _by_shuffle(marked.select(F.col("_row").alias("doc_id"), "text"), items, size, threshold)
        return marked.join(found.select(F.col("doc_id").alias("_gone")).distinct(), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        sketches = Sketches(own, size, threshold)
        for batch in batches:
            yield batch.filter(pa.array([not sketches.verified(t) for t in utf8(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sketch_size(n: int, threshold: float) -> int:
    return n - needed(n, threshold) + 1


def _hash_rows(i: list, width: list, class_: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A row per hash, of the sizes given once for each array of hashes."""
    n = [len(h) for h in hashes]
    spread = [pa.array(np.repeat(np.array(c, np.int64), n)) for c in (i, width, class_)]
    return pa.RecordBatch.from_arrays([*spread, pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], names=["i", "width", "class", "hash"])


_HASHES = "i long, width long, class long, hash long"


def _by_shuffle(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size.  Rows get numbers of their own here, so repeated ids stay
    apart; both tables are written once for that."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        docs = saved(docs.withColumn("d", F.monotonically_increasing_id()), "decontam-docs")
        items = saved(items.withColumn("i", F.monotonically_increasing_id()), "decontam-items")

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: tuple[list, list, list, list] = [], [], [], []
                for i, text in zip(batch.column("i").to_pylist(), utf8(batch.column("text")), strict=True):
                    words = word_hashes(text or b"")
                    if len(words):
                        hashes = shingle_hashes(words, size)
                        for column, value in zip(own, (i, min(size, len(words)), len(hashes).bit_length(), hashes.view(np.int64)), strict=True):
                            column.append(value)
                yield _hash_rows(*own)

        wanted = saved(items.select("i", "text").mapInArrow(shingles, _HASHES), "decontam-shingles")
        sizes = saved(wanted.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "decontam-sizes")
        # An item's hashes in unsigned order, as its sketch takes the smallest.
        unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
        ranked = wanted.join(sizes, "i").withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(unsigned)))
        sketches = saved(ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select(*[x.split()[0] for x in _HASHES.split(", ")]), "decontam-sketches")
        # At most ``size`` widths and 64 sizes: the largest sketch hash of each partition.
        top = {(r["width"], r["class"]): r["top"] & ((1 << 64) - 1) for r in sketches.groupBy("width", "class").agg(F.max(unsigned).alias("top")).select("width", "class", F.col("top").bitwiseXOR(F.lit(-(1 << 63))).alias("top")).collect()}
        known = id_filter(sketches.select("hash"), "hash")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: tuple[list, list, list, list] = [], [], [], []
                for d, text in zip(batch.column("d").to_pylist(), utf8(batch.column("text")), strict=True):
                    words = word_hashes(text or b"")
                    for width in {w for w, _ in top if w <= len(words)}:
                        hashes = shingle_hashes(words, width)
                        hashes = hashes[known.has(pa.array(hashes.view(np.int64)))]
                        for (w, class_), most in top.items():
                            low = hashes[: np.searchsorted(hashes, np.uint64(most), "right")]
                            if w == width and len(low):
                                for column, value in zip(own, (d, width, class_, low.view(np.int64)), strict=True):
                                    column.append(value)
                yield _hash_rows(*own)

        probes = docs.select("d", "text").mapInArrow(probe, _HASHES).withColumnRenamed("i", "d")
        pairs = saved(probes.join(sketches, ["width", "class", "hash"]).select("d", "i", "width").distinct(), "decontam-candidates")
        every, asked = id_filter(wanted.select("hash"), "hash"), id_filter(pairs.select("d"), "d")

        def of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(asked.has(batch.column("d"))))
                own: tuple[list, list, list, list] = [], [], [], []
                for d, text in zip(batch.column("d").to_pylist(), utf8(batch.column("text")), strict=True):
                    words = word_hashes(text or b"")
                    for width in {w for w, _ in top if w <= len(words)}:
                        hashes = shingle_hashes(words, width).view(np.int64)
                        for column, value in zip(own, (d, width, 0, hashes[every.has(pa.array(hashes))]), strict=True):
                            column.append(value)
                yield _hash_rows(*own)

        # Common shingles are counted where they meet, and only of candidates.
        held = docs.select("d", "text").mapInArrow(of_candidates, _HASHES).withColumnRenamed("i", "d").drop("class")
        common = held.join(wanted.drop("class"), ["width", "hash"]).groupBy("d", "i").agg(F.count(F.lit(1)).alias("n_shared"))
        common = common.join(pairs.select("d", "i"), ["d", "i"], "left_semi").join(sizes, "i").filter(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
        out = common.join(docs.select("d", "doc_id"), "d").join(items.select("i", "item_id"), "i")
        return keep(saved(out.select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_shared"), "decontam-found"))
