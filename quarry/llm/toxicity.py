"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, replaces homoglyphs and (inside words) digits and signs that stand
for letters, and turns every other sign into a space.  Lexicon entries are stems (`` stem``: by
definition the first 4 to 8 letters of words) or whole words (`` word ``) with weights; the heaviest
entry counts at each word.  Matches inside an exception phrase (two words) don't count.  The score is a logistic function of the
sum of weights and of that sum divided by length.

Weights, exceptions and the logistic function are learned from at most about
``max_fit_rows`` labelled documents (chosen by a hash of doc_id); only text is an input.
Null and empty texts match nothing and get the score of no match; repeated and null
doc_ids are scored row by row; without labels of both kinds the given lexicon (by default
empty) is used as it is.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, other_work, saved, scratch

# Letters of other scripts that look like Latin ones, and what they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs written for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_WIDE = {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B) if chr(c).isalpha()}
_SIGNS = {chr(c): " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES}
_TABLE = str.maketrans({**_SIGNS, **HOMOGLYPHS, **_WIDE, "​": "", "­": ""})
_DISGUISED = re.compile(r"\S*[0-9@$!]\S*")
_BARE = str.maketrans(dict.fromkeys(SUBSTITUTES, " "))
_SUBSTITUTE = str.maketrans(SUBSTITUTES)


def _plain(m: re.Match) -> str:
    word = m[0].rstrip("!").lstrip("$")
    letters = sum(c.isalpha() for c in word)
    return word.translate(_SUBSTITUTE) if letters > 1 or 2 * letters >= len(word) > 0 else word.translate(_BARE)


def fold(text: str | None) -> str:
    """The text as it is matched: words between single signs' spaces, with a space at either end."""
    if not text:
        return " "
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower())
    return f" {_DISGUISED.sub(_plain, text.translate(_TABLE))} "


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the logistic function's weights."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    logit: tuple[float, float, float] = (-4.0, 1.0, 0.5)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(out):
            out.make_automaton()
        return out


def matches(folded: str, automaton) -> dict[int, float]:
    """The heaviest weight at each matched word's place, exceptions taken out."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, weight) in automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
    if not spared:
        return found
    # Both in order of their starts: one sweep, with the furthest end of the exceptions begun so far.
    spared.sort()
    left, k, reach = {}, 0, -1
    for at in sorted(found):
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at >= reach:
            left[at] = found[at]
    return left


def matched_phrases(folded: str, found: Iterable[int]) -> set[str]:
    """The matched words of a text, each with the word before and with the word after it."""
    words = [(m.start() - 1, m[0]) for m in re.finditer(r"\S+", folded)]
    places, out = {at: k for k, (at, _) in enumerate(words)}, set()
    for k in [places[at] for at in found if at in places]:
        out.update(f"{words[i][1]} {words[i + 1][1]}" for i in (k - 1, k) if 0 <= i < len(words) - 1)
    return out


def inputs(total: float, words: int) -> tuple[float, float]:
    """What the logistic function sees: the sum, and the sum by length."""
    return math.log1p(total), math.log1p(1000 * total / (words + 50))


def _fit_logit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(3) * 1e-2, z.T @ (y - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def word_parts(word: str) -> Iterator[str]:
    """The entries a word can be matched by: whole, and its beginnings of 4 to 8 letters."""
    yield f" {word} "
    for k in range(4, min(9, len(word))):
        yield f" {word[:k]}"


@bounded_batches
def learn_lexicon(docs: DataFrame, labels: DataFrame, seed: Lexicon | None = None, max_fit_rows: int = 12_000, min_support: int = 4) -> Lexicon:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Three quarters of the sample give the entries (those whose log odds stay high at two
    standard errors), the rest exceptions and the logistic function.  ``max_fit_rows`` bounds
    the sample, and with ``min_support`` documents to an entry, what reaches the driver."""
    with scratch(docs.sparkSession):
        return _learn(docs, labels, seed or Lexicon(), max_fit_rows, min_support)


def _learn(docs: DataFrame, labels: DataFrame, seed: Lexicon, max_fit_rows: int, min_support: int) -> Lexicon:
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = known.count()
    share = min(1.0, max_fit_rows / max(1, n))
    # Chosen by a hash of the id: the same rows in every run, in proportion from every part.
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("calibrates", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) == 0)
    sample = saved(sample, "toxicity-sample")
    sizes = {int(r["y"]): r["n"] for r in sample.filter("not calibrates").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return seed

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            entries = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *[pa.array([c[e] for e in entries], pa.int64()) for c in seen]], names=["entry", "clean", "toxic"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[bool(y)].update({p for w in set(fold(text).split()) for p in word_parts(w)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield flush()
        yield flush()

    counted = sample.filter("not calibrates").select("text", "y").mapInArrow(parts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    odds = F.log((F.col("a") + 0.5) / (sizes[1] + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
    sure = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    rows = counted.filter(F.col("a") >= min_support).select("entry", odds.alias("w"), sure.alias("sure")).filter("sure > 1.4").collect()
    weights = dict(seed.weights)
    learned = {r["entry"]: r["w"] for r in rows}
    for entry, w in sorted(learned.items(), key=lambda x: (len(x[0]), x[0])):
        shorter = max((weights.get(entry[:k], 0.0) for k in range(2, len(entry))), default=0.0)
        if w > shorter + 0.2:
            weights[entry] = w
    lexicon = Lexicon(weights, set(seed.exceptions), seed.logit)

    def calibrate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        automaton = lexicon.automaton()
        for batch in batches:
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                folded = fold(text)
                found = matches(folded, automaton)
                rows.append((y, sum(found.values()), len(folded.split()), sorted(matched_phrases(folded, found))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string())), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()))], names=["y", "total", "words", "phrases"])

    tried = saved(sample.filter("calibrates").select("text", "y").mapInArrow(calibrate, "y long, total double, words long, phrases array<string>"), "toxicity-calibration")
    phrases = tried.select("y", F.explode("phrases").alias("p")).groupBy("p").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    lexicon.exceptions |= {r["p"] for r in phrases.filter("a = 0 and n >= 5").collect()}
    points = tried.select("y", "total", "words").collect()  # at most about a quarter of max_fit_rows
    y = np.array([r["y"] for r in points], float)
    if 0 < y.sum() < len(y):
        lexicon.logit = _fit_logit(np.array([inputs(r["total"], r["words"]) for r in points]), y)
    return lexicon


def text_score(text: str | None, lexicon: Lexicon, automaton) -> tuple[float, int, float]:
    """Score, matches, and their weight."""
    folded = fold(text)
    found = matches(folded, automaton)
    total = sum(found.values())
    b0, b1, b2 = lexicon.logit
    x1, x2 = inputs(total, len(folded.split()))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x1 + b2 * x2)))), len(found), total


@bounded_batches
def accepted(docs: DataFrame, lexicon: Lexicon, limit: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose text scores below the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        automaton = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([text_score(t, lexicon, automaton)[0] < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


SCORED = "score double, n_matches long, weight double"


@bounded_batches
def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, score (0 to 1), n_matches, weight."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        automaton = lexicon.automaton()
        for batch in batches:
            rows = list(zip(*(text_score(t, lexicon, automaton) for t in batch.column("text").to_pylist()), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, (pa.float64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "score", "n_matches", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, f"doc_id long, {SCORED}")


def held_out() -> Column:
    """Whether a doc_id is kept away from learning: crc32 of its text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows not held out and score every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lexicon = learn_lexicon(docs, labels.select(F.col("doc_id").cast("long"), "toxic").filter(~held_out()))
    return score_documents(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "weight")
