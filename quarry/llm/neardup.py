"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, represented by its smallest row number.  Banded
signatures of the representatives give buckets; each bucket is a star around its smallest
member, its hub, so links of a bucket of any size cost one row per member.  All candidate
pairs of a bucket meet in the group of its hub.  There, signatures are compared batch by
batch: after each, pairs whose posterior probability of reaching the threshold is below
``miss`` are pruned; so are pairs that the triangle inequality of the Jaccard distance rules
out through the hub.  Survivors are verified on their full shingle sets, most similar first,
until both are linked; only links that were verified leave a group.

A group beyond a block's size is thinned first: in ``ROUNDS`` rounds its members are compared with one
representative, in as many tasks as there are blocks, and those that link to it need no comparison
among themselves.  Of the rest only members at most twice the distance away can link to one of
them; these meet in pairs of blocks, and the rest goes on to the next representative.  What is left
at last is split into blocks, and pairs of blocks, that other tasks can take.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds 64-bit hashes of shingles.
Fewer words than a shingle make one shingle; null, empty and wordless texts have an empty set
and are linked with nothing.  Rows without a doc_id are kept and unlinked.  Rows are numbered in
order of (doc_id, text) and linked by number, so texts under one doc_id are judged apart; of a
component the row of the smallest number is kept.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, bounded_batches, id_filter, mix, other_work, saved, scratch, shingle_hashes, utf8, word_hashes
from .graph import components
from .suffixdedup import numbered

#: Two texts of similarity 0.8 share no band with a probability of (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time.
STEP = 32
#: Members of a hub's group, and shingles in it, that one task compares at once.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000
#: Representatives that a larger group is compared with before its blocks meet.
ROUNDS = 3

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set, 16 bits of each minimum."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(low, (hashes[k : k + 512, None] * _A + _B).min(0), out=low)
    return mix(low).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key per band of every row of ``sig``."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), bands.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + bands[:, :, k])
    return key.view(np.int64)


@cache
def least_matches(threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(values compared, matches below which a pair is pruned): under a uniform prior the posterior
    is Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


class Groups:
    """Verifies the pairs of one hub's group; ``limit`` is the threshold in per cent."""

    def __init__(self, limit: int, miss: float):
        self.limit, self.least = limit, least_matches(limit / 100, miss)

    def shared(self, a: np.ndarray, b: np.ndarray) -> int:
        both = np.concatenate((a, b))
        both.sort()
        return int((both[1:] == both[:-1]).sum())

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.limit * max(len(a), len(b)):
            return False
        x = self.shared(a, b)
        return 100 * x >= self.limit * (len(a) + len(b) - x)

    def links(self, ids: list[int], sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, hub: np.ndarray | None) -> list[tuple[int, int]]:
        """Verified links that join the pairs' components: of left with right rows, or among all
        if both are the same.  ``hub``: the hub's set."""
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        size = np.array([len(s) for s in sets])
        away = np.zeros(len(ids))
        if hub is not None and len(ids) > 3:
            common = np.array([self.shared(s, hub) for s in sets])
            away = 1 - common / (size + len(hub) - common)
        found: list[tuple[int, int]] = []
        order = left[np.argsort(away[left], kind="stable")]
        inner = left is right
        for place, i in enumerate(order.tolist()):
            other = order[:place] if inner else right
            if not len(other):
                continue
            mine, theirs = size[i], size[other]
            alive = other[(100 * np.minimum(mine, theirs) >= self.limit * np.maximum(mine, theirs)) & (np.abs(away[other] - away[i]) <= 1 - self.limit / 100 + 1e-9)]
            matches = np.zeros(len(alive), np.int64)
            start = 0
            for n, least in self.least:
                matches += (sigs[alive, start:n] == sigs[i, start:n]).sum(1)
                keep = matches >= least
                alive, matches, start = alive[keep], matches[keep], n
                if not len(alive):
                    break
            for j in alive[np.argsort(-matches, kind="stable")].tolist():
                a, b = find(i), find(j)
                if a != b and self.linked(sets[i], sets[j]):
                    root[a] = b
                    found.append((ids[i], ids[j]))
        return found


def shingle_features(docs: DataFrame, size: int) -> DataFrame:
    """doc, doc_id, n_shingles, and of texts with words: a digest of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in utf8(batch.column("text")):
                own = shingle_hashes(word_hashes(text or b""), size)
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc", "doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, n_shingles long, digest binary, sig binary")


@bounded_batches
def near_duplicates(docs: DataFrame, size: int = 5, limit: int = 80, miss: float = 1e-8) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_shingles, component_id, kept: components of the links
    with 100 * intersection >= ``limit`` * union."""
    rows = row_components(numbered(docs.select(F.col("doc_id").cast("long"), "text")), size, limit, miss)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@bounded_batches
def row_components(docs: DataFrame, size: int = 5, limit: int = 80, miss: float = 1e-8) -> DataFrame:
    """``near_duplicates`` of rows that have distinct numbers ``doc`` in order of doc_id, with these."""
    with scratch(docs.sparkSession) as keep:
        features = keep(saved(shingle_features(docs, size), "neardup-features"))
        classes = saved(features.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "neardup-classes")

        def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("rep", "n"))], names=["key", "rep", "n"])

        bands = classes.select("rep", "n", "sig").mapInArrow(banded, "key long, rep long, n long")
        hubs = saved(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("key", "hub"), "neardup-hubs")
        stars = saved(bands.join(hubs, "key").groupBy("hub", "rep").agg(F.max("n").alias("n")), "neardup-stars")
        # The sets of all that share a bucket, made once more from their texts.  A filter of bounded size
        # leaves most other texts out where they are read; what it lets pass besides, joins leave out.
        near = saved(_sets(docs, size, id_filter(stars.select("rep").distinct(), "rep")), "neardup-sets")
        placed, edges = _placed(stars, near, limit)
        grouped = placed.join(near, placed.rep == near.doc).select(*_GROUP, "own", "rep", "sig", "set")
        grouped = grouped.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "rep")
        edges = edges.unionByName(grouped.mapInArrow(lambda batches: _verify(batches, Groups(limit, miss)), "a long, b long"))
        joined = components(edges)
        # Of linked classes only: their component's number, and the doc_id that has it.
        names = classes.select(F.col("rep").alias("component"), F.col("rep_id").alias("component_id"))
        moved = joined.join(names, "component").select("node", "component", "component_id")
        ends = classes.select("digest", "rep", "rep_id").join(moved, F.col("rep") == F.col("node"), "left")
        ends = keep(saved(ends.select("digest", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "rep_id").alias("component_id")), "neardup-ends"))
    out = features.select("doc", "doc_id", "n_shingles", "digest").join(ends, "digest", "left")
    known = F.col("doc_id").isNotNull()
    component_id = F.when(known, F.coalesce("component_id", "doc_id"))
    return out.select("doc", "doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(~known | (F.col("doc") == F.col("component")), F.lit(True)).alias("kept"))


_GROUP = ["hub", "round", "p", "q"]


def _blocks() -> Column:
    """How many blocks the members of a group are, by their number and their shingles."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _placed(stars: DataFrame, near: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of ``stars(hub, rep, n)``: the blocks (hub, round, p, q, own, rep) in which members meet, of own
    block p or q, and the links (a, b) found on the way."""
    far = 1 - limit / 100 + 1e-9
    blocks = saved(stars.groupBy("hub").agg(_blocks().alias("blocks")).filter("blocks > 1"), "neardup-large")
    members = stars.join(blocks.select("hub"), "hub", "left_semi")
    placed = _pairs_of_blocks(stars.join(blocks.select("hub"), "hub", "left_anti").withColumn("blocks", F.lit(1)), -1)
    edges = near.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    for k in range(ROUNDS):
        if blocks.isEmpty():
            return placed, edges
        away = saved(_compared(members, blocks, near, limit), "neardup-spokes")
        edges = edges.unionByName(away.filter("linked").select(F.col("centre").alias("a"), F.col("rep").alias("b")))
        rest = away.filter("not linked")
        # Who may link to a member that the representative stands for, and to which of these.
        near_rest = rest.filter(F.col("away") <= 2 * far)
        reach = saved(near_rest.groupBy("hub").agg(F.min("away").alias("least"), _blocks().alias("left")), "neardup-reach")
        facing = away.filter("linked").join(reach, "hub").filter(F.col("away") >= F.col("least") - far)
        right = saved(facing.groupBy("hub").agg(_blocks().alias("right")), "neardup-facing")
        spread = reach.select("hub", "left").join(right, "hub")
        own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
        others = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = near_rest.join(spread, "hub").withColumn("p", own("left")).withColumn("q", F.explode(others("right"))).withColumn("q", F.col("left") + F.col("q")).withColumn("own", F.col("p"))
        turned = facing.select("hub", "rep").join(spread, "hub").withColumn("q", F.col("left") + own("right")).withColumn("p", F.explode(others("left"))).withColumn("own", F.col("q"))
        placed = placed.unionByName(left.unionByName(turned, True).select("hub", F.lit(k).alias("round"), "p", "q", "own", "rep"))
        # The rest goes on; what fits in one block by now meets there.
        members = rest.select("hub", "rep", "n")
        sizes = saved(members.groupBy("hub").agg(_blocks().alias("blocks")), "neardup-rest")
        blocks = sizes.filter("blocks > 1")
        small = members.join(sizes.filter("blocks = 1"), "hub").select("hub", "rep", "blocks")
        placed = placed.unionByName(_pairs_of_blocks(small, ROUNDS + k))
        members = members.join(blocks.select("hub"), "hub", "left_semi")
    return placed.unionByName(_pairs_of_blocks(members.join(blocks, "hub"), 2 * ROUNDS)), edges


def _pairs_of_blocks(members: DataFrame, stage: int) -> DataFrame:
    """Every pair of blocks of a group (hub, rep, blocks)."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    each = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("hub", F.lit(stage).alias("round"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep")


_AWAY = "hub long, centre long, rep long, n long, away double, linked boolean"


def _compared(members: DataFrame, blocks: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """Every member of a group but its smallest with the distance from that one, the centre."""
    centres = saved(members.groupBy("hub").agg(F.min("rep").alias("centre")).join(blocks, "hub"), "neardup-centres")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    own = members.join(centres, "hub").filter("rep <> centre").select("hub", "centre", block.alias("block"), "rep")
    first = centres.select("hub", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("rep"))
    both = own.unionByName(first)
    both = both.join(near, both.rep == near.doc).select("hub", "centre", "block", "rep", "set")
    both = both.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("rep") != F.col("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, key, middle = Groups(limit, 0.0), None, None
        for batch in batches:
            rows = []
            for hub, centre, at, rep, items in zip(*(batch.column(c).to_pylist() for c in ("hub", "centre", "block", "rep", "set")), strict=True):
                own = np.frombuffer(items, np.uint64)
                if (hub, at) != key:  # the centre comes first
                    key, middle = (hub, at), own
                    continue
                common = groups.shared(own, middle)
                union = len(own) + len(middle) - common
                rows.append((hub, centre, rep, len(own), 1 - common / union, 100 * common >= limit * union))
            types = (*[pa.int64()] * 4, pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=[x.split()[0] for x in _AWAY.split(", ")])

    return both.mapInArrow(run, _AWAY)


def _sets(docs: DataFrame, size: int, held: IdFilter) -> DataFrame:
    """doc, signature and set of the documents that may be in ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            batch = batch.filter(pa.array(held.has(batch.column("doc"))))
            own = [shingle_hashes(word_hashes(t or b""), size) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([signature(x).tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["doc", "sig", "set"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, sig binary, set binary")


def _verify(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    other_work()
    key, rows, found = None, [], []

    def close() -> None:
        if len(rows) > 1:
            ids = [r[0] for r in rows]
            sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, HASHES)
            sets = [np.frombuffer(r[3], np.uint64) for r in rows]
            blocks = np.array([r[1] for r in rows])
            hub = next((s for i, s in zip(ids, sets, strict=True) if i == key[0]), None)
            if key[2] == key[3]:
                every = np.arange(len(ids))
                found.extend(groups.links(ids, sigs, sets, every, every, hub))
            else:
                found.extend(groups.links(ids, sigs, sets, np.flatnonzero(blocks == key[2]), np.flatnonzero(blocks == key[3]), hub))
        rows.clear()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[], []])], names=["a", "b"])
        found.clear()
        return out

    for got in batches:
        for *group, own, rep, sig, items in zip(*(got.column(c).to_pylist() for c in (*_GROUP, "own", "rep", "sig", "set")), strict=True):
            if group != key:
                close()
                key = group
            rows.append((rep, own, sig, items))
        if len(found) > 10_000:
            yield batch()
    close()
    yield batch()
