"""Vector bin packing with the dot-product heuristic, for instruction data.

An example asks for (tokens, segments = 1, loss-bearing tokens); a sequence offers
(max_tokens, max_segments, max_loss).  The open sequence takes, of the examples that fit
in every dimension, the one whose demand has the largest weighted dot product with what
is left; equal demands are one type with a count, so a step looks at types, not rows.

With ``cut`` the example of the largest dot product is split where nothing fits whole,
and a sequence that still isn't full is cut into runs of powers of two, which need no padding.

Packing works on the blocks of a task: no shuffle, memory bounded by ``BLOCK`` examples.
Null and empty texts are the end id alone; repeated and null ids are packed row by row.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8
from .tokens import encoder

#: Examples and ids that a task packs together.
BLOCK, BLOCK_IDS = 20_000, 8_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_pack(tokens: np.ndarray, loss: np.ndarray, max_tokens: int, max_segments: int, max_loss: int, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, start, length).  Without ``cut`` every example must fit alone and stays whole;
    with it, loss-bearing tokens are taken to lie evenly (a piece has the rounded-up share)."""
    waiting: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for i in range(len(tokens) - 1, -1, -1):
        waiting[int(tokens[i]), int(loss[i])].append((i, 0))
    kinds = np.array([(t, y, 1) for t, y in sorted(waiting, reverse=True)], np.int64).reshape(-1, 3)
    at = {(t, y): j for j, (t, y, _) in enumerate(kinds.tolist())}
    count = np.array([len(waiting[t, y]) for t, y, _ in kinds.tolist()], np.int64)
    limits = np.array([max_tokens, max_loss, max_segments], np.float64)
    if not cut and len(kinds) and (kinds > limits).any():
        raise ValueError("an example is larger than a sequence")
    # A dimension weighs as much as the examples ask of it.
    weight = (kinds * count[:, None]).sum(0) / limits / max(1, count.sum()) if len(kinds) else limits
    demand = kinds / limits * weight if len(kinds) else kinds
    bins: list[list[tuple[int, int, int]]] = []
    left = int(count.sum())
    while left:
        room, now = np.array([max_tokens, max_loss, max_segments]), []
        while left and room[2] and room[0]:
            fits = (count > 0) & (kinds <= room).all(1)
            score = demand @ (room / limits)
            if fits.any():
                j = int(np.argmax(np.where(fits, score, -1.0)))
                t, share, _ = kinds[j].tolist()
                i, start = waiting[t, share].pop()
                count[j] -= 1
                left -= 1
                now.append((i, start, t))
                room -= kinds[j]
                continue
            if not cut or not room[1]:
                break
            j = int(np.argmax(np.where(count > 0, score, -1.0)))
            t, share, _ = kinds[j].tolist()
            take = min(int(room[0]), t - 1, int(room[1]) * t // share if share else t)
            if take < 1:
                break
            i, start = waiting[t, share].pop()
            count[j] -= 1
            used = min(int(room[1]), -(-share * take // t))
            now.append((i, start, take))
            room -= (take, used, 1)
            rest = (t - take, share - used)
            if rest not in at:
                at[rest] = len(kinds)
                kinds = np.vstack([kinds, (*rest, 1)])
                demand = np.vstack([demand, kinds[-1] / limits * weight])
                count = np.append(count, 0)
            waiting[rest].append((i, start + take))
            count[at[rest]] += 1
        bins.append(now)
    return bins


def even_lengths(bin_: list[tuple[int, int, int]], max_tokens: int) -> list[list[tuple[int, int, int]]]:
    """Cut a bin's content into sequences whose lengths are powers of two (or leave a full one)."""
    total = sum(x[2] for x in bin_)
    if total == max_tokens or total & (total - 1) == 0:
        return [bin_]
    out, k = [], 0
    todo = list(bin_)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        run = []
        while want:
            i, start, n = todo[k]
            take = min(n, want)
            run.append((i, start, take))
            want -= take
            if take == n:
                k += 1
            else:
                todo[k] = (i, start + take, n - take)
        out.append(run)
    return out


@bounded_batches
def pack_examples(examples: DataFrame, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, ids: tuple[str, ...] = ("example_id",), oversize: str = "error") -> DataFrame:
    """Place whole instruction examples ``(ids..., n_tokens long, n_loss long)``: returns their ids,
    sequence_id, offset.  Examples larger than a sequence are an error, or with ``oversize`` "alone"
    sequences of their own; rows with null counts count as 0 tokens and are placed at no cost."""
    if oversize not in ("error", "alone"):
        raise ValueError("oversize must be error or alone")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*ids).schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, block, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            block.append(batch)
            held += batch.num_rows
            if held >= BLOCK:
                placed, base = place(block, base)
                yield placed
                block, held = [], 0
        if held:
            yield place(block, base)[0]

    def place(block: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(block)
        tokens, loss = (np.array([x or 0 for x in table.column(c).to_pylist()], np.int64) for c in ("_tokens", "_loss"))
        large = (tokens > max_tokens) | (loss > max_loss) if oversize == "alone" else np.zeros(len(tokens), bool)
        own = np.flatnonzero(~large)
        bins = [[(int(i), 0, int(tokens[i]))] for i in np.flatnonzero(large)]
        bins += [[(int(own[i]), start, n) for i, start, n in bin_] for bin_ in dot_product_pack(tokens[own], loss[own], max_tokens, max_segments, max_loss)]
        rows, sequences, offsets = [], [], []
        for k, bin_ in enumerate(bins):
            offset = 0
            for i, _, n in bin_:
                rows.append(i)
                sequences.append(base + k)
                offsets.append(offset)
                offset += n
        kept = table.select(list(ids)).take(pa.array(rows, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*ids, "sequence_id", "offset"]), base + len(bins)

    return examples.select(*ids, *[F.col(f"n_{c}").cast("long").alias(f"_{c}") for c in ("tokens", "loss")]).mapInArrow(run, out)


@bounded_batches
def dialogue_examples(views: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of ``perspectives`` as instruction examples: conv_id, participant, first_turn, n_tokens of the
    rendered text, and n_loss of the spans that bear loss, each encoded by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            tokens, loss = [], []
            for text, mask in zip(batch.column("rendered").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                tokens.append(len(enc.encode(text.encode())) // 4)
                loss.append(sum(len(enc.encode(text[m["start"] : m["end"]].encode())) // 4 for m in mask))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "participant", "first_turn")), pa.array(tokens, pa.int64()), pa.array(loss, pa.int64())], names=["conv_id", "participant", "first_turn", "n_tokens", "n_loss"])

    return views.select("conv_id", "participant", "first_turn", "rendered", "mask").mapInArrow(run, "conv_id long, participant string, first_turn long, n_tokens long, n_loss long")


@bounded_batches
def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256) -> DataFrame:
    """Encode and pack whole documents, every id loss-bearing.  Full pieces of long documents are
    sequences of their own; what remains of each is packed."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        rest: list[tuple] = []  # doc_id, ids before, ids, ids of the document
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            sizes = np.array([len(x[2]) // 4 for x in rest], np.int64)
            for full in dot_product_pack(sizes, sizes, max_tokens, max_segments, max_tokens, cut=True):
                for own in even_lengths(full, max_tokens):
                    offset = 0
                    for i, start, n in own:
                        doc, before, ids, total = rest[i]
                        rows.append((doc, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, base, offset))
                        offset += n
                    base += 1
            rest.clear()
            held = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
            rows.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                ids = enc.encode(text, end)
                total = len(ids) // 4
                whole = total - total % max_tokens
                for start in range(0, whole, max_tokens):
                    rows.append((doc, start, max_tokens, zlib.crc32(ids[4 * start : 4 * (start + max_tokens)]), total, base, 0))
                    base += 1
                if whole < total:
                    rest.append((doc, whole, ids[4 * whole :], total))
                    held += total - whole
                if len(rest) >= BLOCK or held >= BLOCK_IDS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)
