"""Suffix-array deduplication: bytes of strings of ``length`` bytes that start earlier elsewhere go.

Every window of ``length`` bytes is charged to its anchor, the ``GRAM``-byte string in it of
the smallest hash, so equal windows have equal anchors at equal places.  A run is a stretch
of windows of one document with one anchor.  Runs with the same bytes are folded first where
they are read, then once over all, by their anchor and a salted BLAKE2 digest of their bytes (64 bits,
a new salt for each job, so no text can aim at it): all but the earliest only hold windows that
start earlier.  Anchors that still have several different runs get their
bytes, and the windows at equal distance from the anchor are put in order by the hash-compared
suffix sort; equal neighbours are verified bytewise and all but the earliest are marked.
Anchors of very many different runs are taken window by window and folded like runs, so no
task holds an unbounded group; the result is the same.

Order is by doc_id (null first), repeated doc_ids by text, then the start.  Null texts are empty;
matches never cross documents; strings are judged on the input.  Repeated rows count as
documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_only, id_filter, mix, other_work, prefix_hash, release, saved, scratch, span_hash, utf8
from .suffixsort import SuffixOrder

GRAM = 32
#: Different runs of one anchor beyond which its windows are taken one by one.
MANY_RUNS = 2000
#: Windows that the suffix sort takes at once, unless one anchor has more.
SORT_WINDOWS = 200_000
#: Windows of a document looked at at once; positions fit the low bits of a sort key.
SEGMENT = 1 << 19

_LOW = np.uint64((1 << 24) - 1)


def runs(text: bytes, length: int, salt: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, digest of the bytes, first window, windows) of every run of a document."""
    digest = hashlib.blake2b
    out: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8)[begin : begin + SEGMENT + length - 1]
        prefix = prefix_hash(data)
        at = np.arange(len(data) - GRAM + 1)
        gram = mix(span_hash(prefix, at, at + GRAM))
        low = (gram & ~_LOW) | at.astype(np.uint64)
        want, width = length - GRAM + 1, 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        anchor = (low & _LOW).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(start, len(anchor)))
        place = anchor[start]
        spans = zip((start + begin).tolist(), (start + begin + count + length - 1).tolist(), strict=True)
        run = np.frombuffer(b"".join([digest(text[a:b], digest_size=8, salt=salt).digest() for a, b in spans]), np.uint64)
        out.append((gram[place], run, start + begin, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fold(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows are the first, by ``order``, of those with equal ``keys``."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    first = np.ones(len(by), bool)
    if len(by):
        same = np.ones(len(by) - 1, bool)
        for k in keys:
            same &= k[by[1:]] == k[by[:-1]]
        first[1:] = ~same
    out = np.zeros(len(by), bool)
    out[by[first]] = True
    return out


def joined_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    # Running maxima of ends within a document: documents are numbered, ends shifted apart.
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    shift = number * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], start[1:] + shift[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - shift[first]


# A table of events: span (kind 0: first, second = start, end) or run (kind 1: first window,
# windows), keyed by the anchor, or for spans by anything that spreads.
EVENTS = "anchor long, run long, doc long, first long, second int, kind byte"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8())


def _events(anchor, run, doc, first, second, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((anchor, run, doc, first, second, kind), _TYPES, strict=True)], names=[x.split()[0] for x in EVENTS.split(", ")])


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key that spreads places of any document and position."""
    return mix(doc.astype(np.uint64) + (start.astype(np.uint64) << np.uint64(20))).view(np.int64)


def _spans(doc, start, end) -> pa.RecordBatch:
    doc, start, end = joined_spans(doc, start, end)
    return _events(_spread(doc, start), np.zeros(len(doc), np.int64), doc, start, (end - start).astype(np.int32), np.zeros(len(doc), np.int8))


def _read_runs(batches: Iterator[pa.RecordBatch], length: int, salt: bytes) -> Iterator[pa.RecordBatch]:
    """Events of texts: runs folded within some megabytes, and spans of the folded ones."""
    other_work()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            anchor, run, doc, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
            first = fold((anchor, run), (doc, start))
            rest = ~first
            yield _spans(doc[rest], start[rest], start[rest] + count[rest] + length - 1)
            for k in range(0, len(own := np.flatnonzero(first)), 100_000):
                part = own[k : k + 100_000]
                yield _events(anchor[part].view(np.int64), run[part].view(np.int64), doc[part], start[part], count[part], np.ones(len(part), np.int8))
        held.clear()
        size = 0

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), strict=True):
            if text and len(text) >= length:
                anchor, run, start, count = runs(text, length, salt)
                held.append((anchor, run, np.full(len(run), doc), start, count))
                size += len(run)
                if size > 1_000_000:
                    yield from flush()
    yield from flush()


def _meet(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Events sorted by (anchor, run, doc, first): spans pass; of each run the earliest stays and
    the others become spans; the earliest run of an anchor stays only if another run follows."""
    other_work()
    before: tuple[int, int] | None = None  # anchor and run of the row before
    pending: tuple | None = None  # an anchor's first run, until another one is seen

    for batch in batches:
        anchor, run, doc, start, count, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if (spans := kind == 0).any():
            yield _events(*(x[spans] for x in (anchor, run, doc, start, count, kind)))
            anchor, run, doc, start, count = (x[~spans] for x in (anchor, run, doc, start, count))
        if not len(anchor):
            continue
        last_anchor = np.concatenate(([before[0] if before else ~anchor[0]], anchor[:-1]))
        last_run = np.concatenate(([before[1] if before else ~run[0]], run[:-1]))
        same_anchor = anchor == last_anchor
        repeat = same_anchor & (run == last_run)
        before = int(anchor[-1]), int(run[-1])
        if repeat.any():
            yield _spans(doc[repeat], start[repeat], start[repeat] + count[repeat] + length - 1)
        own = np.flatnonzero(~repeat)
        if not len(own):
            continue
        follows = same_anchor[own]  # another run of the anchor came before
        if pending and follows[0]:
            yield _events(*([x] for x in pending), [1])
        if pending:
            pending = None if follows[0] or len(own) else pending
        # An anchor's first run stays if the next different run has the same anchor.
        leads = np.append(follows[1:], False)
        stays = follows | leads
        if not follows[-1]:
            k = own[-1]
            pending = (int(anchor[k]), int(run[k]), int(doc[k]), int(start[k]), int(count[k]))
            stays[-1] = False
        keep = own[stays]
        if len(keep):
            yield _events(anchor[keep], run[keep], doc[keep], start[keep], count[keep], np.ones(len(keep), np.int8))


CONTEXTS = "anchor long, place int, doc long, first long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted runs; runs of very common anchors window by window, folded."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])

    other_work()
    seen: dict[bytes, tuple[int, int]] = {}

    def folded() -> list[tuple]:
        rows = [(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), 1, doc, i, window) for window, (doc, i) in seen.items()]
        seen.clear()
        return rows

    for batch in batches:
        rows: list[tuple] = []
        later: list[tuple[int, int]] = []
        for doc, text, wanted in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                first, count = w["first"], w["second"]
                if not w["common"]:
                    rows.append((w["anchor"], count, doc, first, text[first : first + count + length - 1]))
                    continue
                for i in range(first, first + count):
                    window = text[i : i + length]
                    other = seen.setdefault(window, (doc, i))
                    if other != (doc, i):  # folded here: the later of the two goes, as a row without bytes
                        seen[window] = min(other, (doc, i))
                        later.append(max(other, (doc, i)))
        if later:
            keys = _spread(*np.array(later, np.int64).T).tolist()
            rows += [(key, 1, *place, None) for key, place in zip(keys, later, strict=True)]
        yield out(rows)
        if len(seen) > 100_000:
            yield out(folded())
    yield out(folded())


def _sorted_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that start earlier elsewhere; contexts come sorted by anchor."""
    other_work()
    held: list[tuple[int, int, int, int, bytes]] = []
    windows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal windows
        if len(held) > 1:
            anchor, count, doc, first = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:4])
            bodies = [r[4] for r in held]
            text = np.frombuffer(b"".join(bodies), np.uint8)
            begin = np.concatenate(([0], np.cumsum([len(b) for b in bodies])[:-1]))
            order = SuffixOrder(text, length)
            # Where the anchor is in each run: the first place of its hash from the last window's start on.
            # (Windows of very common anchors are lists of their own and need no place.)
            gram = mix(span_hash(order.prefix, at := np.arange(len(text) - GRAM + 1), at + GRAM)).view(np.int64)
            number = np.repeat(np.arange(len(held)), count)
            inner = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
            place = np.zeros(len(held), np.int64)
            open_ = np.arange(len(held))
            offset = count - 1  # the anchor lies in every window of the run, so not before the last one's start
            while len(open_):
                hit = gram[begin[open_] + offset[open_]] == anchor[open_]
                place[open_[hit]] = offset[open_[hit]]
                open_ = open_[~hit]
                offset[open_] += 1
                open_ = open_[offset[open_] + GRAM <= length + count[open_] - 1]
            group = np.unique(anchor, return_inverse=True)[1]
            lists = np.unique(group[number] * (1 << 24) + (inner - place[number] + (1 << 23)), return_inverse=True)[1]
            by = np.argsort(lists, kind="stable")
            start = (begin[number] + inner)[by]
            window_doc, window_at = doc[number][by], (first[number] + inner)[by]
            along, classes = order.classes(start, lists[by])
            window_doc, window_at = window_doc[along], window_at[along]
            earliest = fold((classes,), (window_doc, window_at))
            rest = ~earliest
            if rest.any():
                yield _spans(window_doc[rest], window_at[rest], window_at[rest] + length)
        held.clear()
        windows = 0

    last = None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if gone := [r for r in rows if r[4] is None]:
            _, _, doc, first, _ = zip(*gone, strict=True)
            at = np.array(first, np.int64)
            yield _spans(np.array(doc, np.int64), at, at + length)
        for row in rows:
            if row[4] is None:
                continue
            if row[0] != last and windows > SORT_WINDOWS:
                yield from flush()
            last = row[0]
            held.append(row)
            windows += row[1]
    yield from flush()


@bounded_batches
def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs(doc, text)``, with distinct numbers ``doc``, to spans (doc, start, end), which may overlap."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    docs = docs.filter("doc is not null")  # said here for either join, so that they can share an exchange
    salt = os.urandom(16)
    events = docs.mapInArrow(lambda b: _read_runs(b, length, salt), EVENTS).repartition("anchor").sortWithinPartitions("anchor", "run", "doc", "first")
    met = saved(events.mapInArrow(lambda b: _meet(b, length), EVENTS), "suffix-events")
    release(docs.sparkSession)
    wanted = met.filter("kind = 1")
    common = saved(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY_RUNS).select("anchor"), "suffix-common")
    marked = wanted.join(common.withColumn("common", F.lit(True)), "anchor", "left")
    by_doc = marked.groupBy("doc").agg(F.collect_list(F.struct("anchor", "first", "second", F.coalesce("common", F.lit(False)).alias("common"))).alias("wanted"))
    by_doc = saved(by_doc, "suffix-wanted")
    asked = held_only(docs.select("doc", "text"), id_filter(by_doc, "doc"), "doc")
    contexts = asked.join(by_doc, "doc").select("doc", "text", "wanted").mapInArrow(lambda b: _contexts(b, length), CONTEXTS)
    sorted_ = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _sorted_windows(b, length), EVENTS)
    span = ["doc", F.col("first").alias("start"), (F.col("first") + F.col("second")).alias("end")]
    return met.filter("kind = 0").select(*span).union(sorted_.filter("kind = 0").select(*span))


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``doc``, an order-keeping number of each row: the doc_id itself if these are distinct
    and not null, else a row number by (doc_id, text)."""
    clash = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1)
    if clash.isEmpty():
        return docs.withColumn("doc", F.col("doc_id"))
    return _ranked(docs)


def _ranked(docs: DataFrame) -> DataFrame:
    """Row numbers in order of (doc_id, text): ranges are sorted apart and counted, one row a range."""
    ranged = docs.repartitionByRange("doc_id", F.xxhash64("text"), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    placed = saved(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("inside")), "suffix-ranked")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("low"))
    base = counts.select("part", "low", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.join(base, "part").withColumn("doc", F.col("base") + F.col("inside") - F.col("low")).drop("part", "inside", "low", "base")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def to_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Joined spans, with the whole of characters that they cut in part."""
    out = []
    for a, b in spans:
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return joined(out)


def kept_bytes(text: bytes, spans: list, characters: bool = False) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal removed runs."""
    spans = joined(spans)
    if characters:
        spans = to_characters(text, spans)
    edges = [0, *(x for span in spans for x in span), len(text)]
    parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return b"".join(parts), sum(b - a for a, b in spans), len(spans)


@bounded_batches
def suffix_dedup(docs: DataFrame, length: int = 100, keep: list[str] | None = None, characters: bool = False) -> DataFrame:
    """doc_id, the columns ``keep``, n_bytes, n_removed, n_spans, and ``kept`` (the bytes left).  With
    ``characters`` one that is removed in part goes whole."""
    keep = keep or []
    docs = numbered(docs.select(F.col("doc_id").cast("long"), "text", *keep)).filter("doc is not null")
    with scratch(docs.sparkSession) as held_on:
        spans = repeated_spans(docs.select("doc", "text"), length)
        by_doc = held_on(saved(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "suffix-spans"))
    # Only texts that lose something are shuffled to their spans; the filter's false alarms find none.
    held = id_filter(by_doc, "doc")
    docs = docs.select("doc", "doc_id", *keep, "text")
    hit = held_only(docs, held, "doc").join(by_doc, "doc", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("doc", "text"))
    n = 2 + len(keep)  # doc, doc_id and the columns to keep come first, then the text, then its spans

    def cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            if whole:
                batch = batch.filter(pa.array(~held.has(batch.column(0))))
            found = [None] * batch.num_rows if whole else batch.column(n + 1).to_pylist()
            sizes, kept, removed, counts = [], [], [], []
            for text, spans in zip(utf8(batch.column(n)), found, strict=True):
                left, r, c = kept_bytes(text or b"", [(s["start"], s["end"]) for s in spans or []], characters)
                sizes.append(len(text or b""))
                kept.append(left)
                removed.append(r)
                counts.append(c)
            columns = [*(batch.column(i) for i in range(1, n)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "n_bytes", "n_removed", "n_spans", "kept"])

    schema += ", n_bytes long, n_removed long, n_spans long, kept binary"
    lossy = hit.select("doc", "doc_id", *keep, "text", "spans").mapInArrow(lambda b: cut(b, False), schema)
    return lossy.unionByName(docs.mapInArrow(lambda b: cut(b, True), schema))
