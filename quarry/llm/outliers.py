"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant.

Per language and source, the transformed statistics of the documents that pass the base rules get a
minimum-covariance-determinant estimate.  Four deterministic starts (around the coordinate-wise
medians: the rows as they are, their hyperbolic tangents, their spatial signs, and the nearest half) take
concentration steps: squared distances of *all* rows, the share ``h`` of them that lies
nearest, their mean and covariance, and so on, until the determinant falls no more.  The smallest
determinant wins, and the estimate is reweighted.  Distances fall into logarithmic bins, and sums
per bin and group hold all that a step needs; of the bin in which the share ends, rows count in part.

A group of at most ``IN_TASK`` rows takes all its steps in one task; a larger one takes the same steps
by one aggregation each with map-side sums, whatever its size.  A document is rejected beyond a
far quantile of the distance that a row outside the estimate has (an F distribution, by the number of
rows in it).

Null texts have no words; null languages and sources are groups of their own.  Sources with
fewer than ``min_group`` rows that pass (five to a dimension, what such an estimate takes) are judged by
the estimate of all passing rows of their language, and by that of all passing rows where the
language has too few itself.  Only tables of fewer than ``LEAST`` passing rows give no estimate, and no
distance.  Repeated ids are judged row by row.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, other_work, saved, scratch, utf8

COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOLS = bytes(b"#*$%&|<>")
_CONTINUED = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"

#: Dimensions of a statistic vector.
DIM = 4
#: Bins to a doubling of the squared distance, and cells of the histograms that give medians to 1.
FINE, CELLS = 64, 4096
#: Words and lines added to either side of the odds of repeated words and of repeated lines.
PRIOR = (4.0, 1.0)
#: Rows that an estimate needs at least.
LEAST = 2 * (DIM + 1)
#: Rows of a group that one task holds, as numbers.
IN_TASK = 200_000
#: A step must lower the logarithm of the determinant by this, or it was the last.
GAIN = 1e-6
#: Correlations shrink until no direction has more than this times another's variance.
CONDITION = 100.0


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    return text_and_line_counts(text)[:5]


def text_and_line_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """``text_counts`` and the number of lines that aren't blank."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, _CONTINUED + _WHITE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip(_WHITE):
            if line in seen:
                repeated += 1
            seen.add(line)
    n = len(words)
    covered = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            many = {w for w, c in Counter(windows).items() if c > 1}
            end = 0
            for i, w in enumerate(windows):
                if w in many:
                    covered += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, repeated, covered, repeated + len(seen)


@bounded_batches
def document_counts(docs: DataFrame) -> DataFrame:
    """The base statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            rows = list(zip(*map(text_and_line_counts, utf8(batch.column("text"))), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in rows)], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, COUNTS)


def statistic_vector(counts: DataFrame) -> DataFrame:
    """Adds x0..x3: mean word length, and shares of symbols, repeated words and repeated lines.
    The last two are log odds with ``PRIOR`` added to either side, so texts without any
    repetition still differ, by the length that they say it over."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    words, lines = PRIOR
    return counts.select(
        "*",
        F.log((F.col("word_chars") + 4) / (n + 1)).alias("x0"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)).alias("x1"),
        F.log((F.col("n_repeat_words") + words) / (n - F.col("n_repeat_words") + words)).alias("x2"),
        F.log((F.col("n_dup_lines") + lines) / (F.col("n_lines") - F.col("n_dup_lines") + lines)).alias("x3"),
    )


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution, by bisection of the regularised gamma function."""

    def cdf(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        for i in range(1, 2000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


#: A statistic that is the same in most documents (no symbol at all) must not make the
#: covariance singular: no spread is taken to be smaller than this.
FLOOR = np.full(DIM, 0.01) ** 2
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_MOMENTS = [f"s{i}" for i in range(DIM)] + [f"q{i}{j}" for i, j in _PAIRS]
STARTS = ("plain", "tanh", "sign", "half")
FITTED = "lang string, source string, start int, rows long, used long, det double, done boolean, " + ", ".join([f"m{i} double" for i in range(DIM)] + [f"p{i}{j} double" for i, j in _PAIRS])
_NAMES = [x.split()[0] for x in FITTED.split(", ")]
_FITTED_TYPES = [pa.string()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.float64(), pa.bool_()] + [pa.float64()] * (DIM + len(_PAIRS))
Sums = dict[str, np.ndarray]


def _rounded(x: float) -> float:
    """Ten digits: sums in another order give the same estimate."""
    return float(f"{x:.10g}")


def _shrunk(corr: np.ndarray) -> np.ndarray:
    """Correlations times the largest share that keeps the condition number at ``CONDITION``."""
    low, *_, high = np.linalg.eigvalsh(corr)
    share = 1.0 if high <= CONDITION * low else (CONDITION - 1) / (CONDITION - 1 + high - CONDITION * low)
    return share * corr + (1 - share) * np.eye(len(corr))


def _scatter(mean: np.ndarray, cov: np.ndarray) -> dict:
    """An estimate from a mean and a covariance: its determinant and its inverse too."""
    root = np.sqrt(np.maximum(np.diag(cov), FLOOR))
    corr = np.clip(cov / np.outer(root, root), -1, 1)
    np.fill_diagonal(corr, 1.0)
    corr = _shrunk(corr)
    inverse = np.linalg.inv(corr) / np.outer(root, root)
    det = math.log(np.linalg.det(corr)) + 2 * float(np.log(root).sum())
    return {"det": _rounded(det), **{f"m{i}": _rounded(mean[i]) for i in range(DIM)}, **{f"p{i}{j}": _rounded(inverse[i, j]) for i, j in _PAIRS}}


def _moments(sums: Sums, weight: np.ndarray, prefix: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and covariance of bins of which a share counts."""
    n = float((sums["n"] * weight).sum())
    mean = np.array([(sums[f"{prefix}s{i}"] * weight).sum() for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (sums[f"{prefix}q{i}{j}"] * weight).sum() / n - mean[i] * mean[j]
    return n, mean, cov


def _nearest(sums: Sums, share: float) -> np.ndarray:
    """The weights of bins that hold the nearest ``share`` of the rows: 1, a part of the last one's, 0."""
    order = np.argsort(sums["bin"])
    count = sums["n"][order].astype(float)
    before = np.cumsum(count) - count
    weight = np.zeros(len(order))
    weight[order] = np.clip((math.ceil(share * count.sum()) - before) / count, 0, 1)
    return weight


def consistent(share: float) -> float:
    """What makes the covariance of the nearest share consistent for normal rows."""
    return share / _chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


def nearest_estimate(sums: Sums, share: float) -> dict:
    """The estimate of the rows nearest by the distance that the bins are of."""
    _, mean, cov = _moments(sums, _nearest(sums, share))
    return {"rows": int(sums["n"].sum()), "used": math.ceil(share * int(sums["n"].sum())), **_scatter(mean, cov * consistent(share))}


def reweighted_estimate(sums: Sums, outer: float) -> dict:
    """The estimate of the rows within the quantile ``outer``."""
    weight = (sums["bin"] <= bin_of(chi2_quantile(outer, DIM))).astype(float)
    if not weight.any():
        weight[np.argmin(sums["bin"])] = 1.0
    n, mean, cov = _moments(sums, weight)
    return {"rows": int(sums["n"].sum()), "used": int(n), **_scatter(mean, cov * consistent(outer))}


def centre(cells: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled median deviation of each coordinate, from cells (coordinate k, cell g, rows n)."""
    mid, spread = np.zeros(DIM), np.zeros(DIM)
    for i in range(DIM):
        own = np.flatnonzero(cells["k"] == i)
        own = own[np.argsort(cells["g"][own])]
        value, count = (cells["g"][own] + 0.5) / CELLS, cells["n"][own]
        half = count.sum() / 2
        mid[i] = value[np.searchsorted(np.cumsum(count), half)]
        away = np.abs(value - mid[i])
        near = np.argsort(away, kind="stable")
        spread[i] = away[near][np.searchsorted(np.cumsum(count[near]), half)] * 1.4826
    return mid, np.sqrt(np.maximum(spread**2, FLOOR))


def starts(sums: Sums, mid: np.ndarray, spread: np.ndarray) -> list[dict]:
    """The estimates that the concentration steps begin with, from sums over bins of the distance from
    the centre: of the robust units z (s, q), of their tangents (ts, tq) and of their signs (us, uq)."""
    every = np.ones(len(sums["n"]))
    found = [np.eye(DIM), _moments(sums, every, "t")[2], _moments(sums, every, "u")[2], _moments(sums, _nearest(sums, 0.5))[2]]
    out = []
    for k, cov in enumerate(found):
        root = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = np.clip(cov / np.outer(root, root), -1, 1)
        out.append({"start": k, "rows": int(sums["n"].sum()), "used": 0, "done": False, **_scatter(mid, corr * np.outer(spread, spread)), "det": math.inf})
    return out


def bin_of(d2: float) -> int:
    """The bin of a squared distance, as the plan computes it."""
    return math.floor(math.log2(d2 + 1e-3) * FINE)


# The same sums of the rows that one task holds.


def _held_sums(x: np.ndarray, d2: np.ndarray, also: dict[str, np.ndarray] | None = None) -> Sums:
    bins, at = np.unique(np.floor(np.log2(d2 + 1e-3) * FINE), return_inverse=True)
    out = {"bin": bins, "n": np.bincount(at)}
    for prefix, values in {"": x, **(also or {})}.items():
        for i in range(DIM):
            out[f"{prefix}s{i}"] = np.bincount(at, values[:, i])
        for i, j in _PAIRS:
            out[f"{prefix}q{i}{j}"] = np.bincount(at, values[:, i] * values[:, j])
    return out


def _held_distance(x: np.ndarray, fit: dict) -> np.ndarray:
    away = x - np.array([fit[f"m{i}"] for i in range(DIM)])
    return np.maximum(sum(fit[f"p{i}{j}"] * away[:, i] * away[:, j] * (1.0 if i == j else 2.0) for i, j in _PAIRS), 0.0)


def fit_held(x: np.ndarray, h: float, outer: float) -> dict:
    """All steps for the rows of one group."""
    cells, n = np.unique(np.stack([np.repeat(np.arange(DIM), len(x)), np.floor(x.T * CELLS).ravel()]), axis=1, return_counts=True)
    mid, spread = centre({"k": cells[0], "g": cells[1], "n": n})
    z = (x - mid) / spread
    length = np.sqrt((z**2).sum(1))
    best: dict = {}
    for fit in starts(_held_sums(z, length**2, {"t": np.tanh(z), "u": z / np.maximum(length, 1e-9)[:, None]}), mid, spread):
        while True:
            after = nearest_estimate(_held_sums(x, _held_distance(x, fit)), h)
            if not after["det"] < fit["det"] - GAIN:
                break
            fit = after
        if not best or fit["det"] < best["det"]:
            best = fit
    return reweighted_estimate(_held_sums(x, _held_distance(x, best)), outer)


#: Groups that one task fits; a group is some thousands of sums at most.
GROUPS_A_TASK = 20_000


def fit_groups(sums: DataFrame, fit: Callable[[Sums], list[dict]], keys: list[str], tasks: int) -> DataFrame:
    """``fit`` of each group's rows of sums.  A group's rows are gathered into one by Spark, and few
    tasks fit all groups: short Python tasks by the hundred cost more."""
    names = [c for c in sums.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                own = {c: batch.column(k)[r].as_py() for k, c in enumerate(keys)}
                held = batch.column(len(keys))[r].values
                for out in fit({c: held.field(c).to_numpy(zero_copy_only=False) for c in names}):
                    rows.append([{"start": 0, "done": True, **out, **own}[c] for c in _NAMES])
            columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FITTED_TYPES, strict=True)], names=_NAMES)

    gathered = sums.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("held"))
    return saved(gathered.coalesce(tasks).mapInArrow(run, FITTED), "mcd-fit")


def squared_distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under the inverse covariance p00.."""
    total = None
    for i, j in _PAIRS:
        term = F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) * (1.0 if i == j else 2.0)
        total = term if total is None else total + term
    return F.greatest(total, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-3) * FINE).cast("long").alias("bin")


def _sums(values: list[Column], prefix: str = "") -> list[Column]:
    return [F.sum(v).alias(f"{prefix}s{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"{prefix}q{i}{j}") for i, j in _PAIRS]


_KEY = ["lang", "source"]
_X = [f"x{i}" for i in range(DIM)]


def concentrate(vectors: DataFrame, h: float = 0.75, outer: float = 0.975, in_task: int | None = None) -> DataFrame:
    """Estimates per (lang, source) of ``vectors(lang, source, x0..)``: columns ``FITTED``, where
    ``used`` rows lie within the quantile ``outer`` of the estimate of smallest determinant."""
    in_task = IN_TASK if in_task is None else in_task
    sizes = vectors.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"))
    with scratch(vectors.sparkSession) as keep:
        sizes = saved(sizes, "mcd-sizes")
        tasks = 2 + sizes.count() // GROUPS_A_TASK
        large = sizes.filter(F.col("rows") > in_task)
        fitted = _in_tasks(matched(vectors, sizes.filter(F.col("rows") <= in_task), "inner").select(*_KEY, *_X), h, outer)
        if not large.isEmpty():
            fitted = fitted.unionByName(_by_aggregation(saved(matched(vectors, large, "inner").select(*_KEY, *_X), "mcd-large"), h, outer, tasks))
        return keep(saved(fitted, "mcd-estimates"))


def _in_tasks(vectors: DataFrame, h: float, outer: float) -> DataFrame:
    """Groups that one task can hold, each fitted where its rows meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_work()
        key, held = None, []

        def close() -> list[list]:
            if not held:
                return []
            out = {"start": 0, "done": True, "lang": key[0], "source": key[1], **fit_held(np.concatenate(held), h, outer)}
            held.clear()
            return [[out[c] for c in _NAMES]]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FITTED_TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            rows = []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            x = np.column_stack([batch.column(2 + i).to_numpy() for i in range(DIM)])
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            begin = 0
            for end in ends if keys else []:
                if keys[begin] != key:
                    rows += close()
                    key = keys[begin]
                held.append(x[begin:end])
                begin = end
            yield batch_of(rows)
        yield batch_of(close())

    return vectors.repartition(*_KEY).sortWithinPartitions(*_KEY, *_X).mapInArrow(run, FITTED)


def _by_aggregation(vectors: DataFrame, h: float, outer: float, tasks: int) -> DataFrame:
    """Groups of any size: each step is one aggregation over all their rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(x) * CELLS).cast("long").alias("g")) for i, x in enumerate(_X)])).alias("e")
    tall = vectors.select(*_KEY, cells).groupBy(*_KEY, F.col("e.k").alias("k"), F.col("e.g").alias("g")).agg(F.count(F.lit(1)).alias("n"))

    def centred(group: Sums) -> list[dict]:
        mid, spread = centre(group)
        return [{"rows": 0, "used": 0, "det": 0.0} | {f"m{i}": float(mid[i]) for i in range(DIM)} | {f"p{i}{j}": float(spread[i]) if i == j else 0.0 for i, j in _PAIRS}]

    middle = fit_groups(tall, centred, _KEY, tasks)
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"p{i}{i}") for i, x in enumerate(_X)]
    units = matched(vectors, middle).select(*_KEY, *[v.alias(f"z{i}") for i, v in enumerate(z)], *[f"m{i}" for i in range(DIM)], *[F.col(f"p{i}{i}").alias(f"d{i}") for i in range(DIM)])
    zs = [F.col(f"z{i}") for i in range(DIM)]
    length2 = sum((v * v for v in zs[1:]), zs[0] * zs[0])
    length = F.greatest(F.sqrt(length2), F.lit(1e-9))
    first = units.groupBy(*_KEY, _bin(length2)).agg(
        F.count(F.lit(1)).alias("n"), *_sums(zs), *_sums([F.tanh(v) for v in zs], "t"), *_sums([v / length for v in zs], "u"),
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)], *[F.first(f"d{i}").alias(f"d{i}") for i in range(DIM)],
    )
    now = fit_groups(first, lambda x: starts(x, np.array([x[f"m{i}"][0] for i in range(DIM)]), np.array([x[f"d{i}"][0] for i in range(DIM)])), _KEY, tasks)

    def refit(fits: DataFrame, fit: Callable[[Sums], dict]) -> DataFrame:
        binned = matched(vectors, fits).groupBy(*_KEY, "start", _bin(squared_distance())).agg(F.count(F.lit(1)).alias("n"), *_sums([F.col(x) for x in _X]))
        return fit_groups(binned, lambda x: [fit(x)], [*_KEY, "start"], tasks)

    while True:
        open_ = now.filter("not done")
        if open_.isEmpty():
            break
        after = refit(open_, lambda x: nearest_estimate(x, h)).drop("done").withColumnsRenamed({c: f"_{c}" for c in _NAMES if c != "done"})
        pair = now.join(after, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")), "left")
        better = F.coalesce(F.col("_det") < F.col("det") - GAIN, F.lit(False))
        now = saved(pair.select(*_KEY, "start", *[(~better if c == "done" else F.when(better, F.col(f"_{c}")).otherwise(F.col(c))).alias(c) for c in _NAMES[3:]]), "mcd-step")
    least = F.min_by(F.struct(*_NAMES), F.struct("det", "start"))
    return refit(saved(now.groupBy(*_KEY).agg(least.alias("e")).select("e.*"), "mcd-best"), lambda x: reweighted_estimate(x, outer))


def matched(vectors: DataFrame, fitted: DataFrame, how: str = "inner") -> DataFrame:
    """Each row with its group's estimate; Spark broadcasts the estimates if their files are
    small, else it can split a large group."""
    other = fitted.withColumnsRenamed({"lang": "_l", "source": "_s"})
    return vectors.join(other, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), how).drop("_l", "_s")


def _chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def pooled(vectors: DataFrame, min_group: int) -> tuple[DataFrame, DataFrame]:
    """The rows with lang and source replaced by the key of the estimate that judges them, and the
    passing rows that estimates are made from, once for each estimate that they belong to.

    The key of a source is (=lang, =source), of a language (=lang, *), of all rows (*, *)."""
    every = F.lit("*")
    counts = saved(vectors.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("rows")), "quality-groups")
    langs = counts.groupBy("lang").agg(F.sum("rows").alias("in_lang"), F.min("rows").alias("least"))
    langs = langs.select(F.col("lang").alias("_k"), "in_lang", (F.col("least") < min_group).alias("has_small"))
    small, few = F.col("rows") < min_group, F.col("in_lang") < min_group
    groups = counts.join(langs, F.col("lang").eqNullSafe(F.col("_k"))).select(
        F.col("lang").alias("_l"),
        F.col("source").alias("_s"),
        F.when(small & few, every).otherwise(F.concat(F.lit("="), "lang")).alias("to_lang"),
        F.when(small, every).otherwise(F.concat(F.lit("="), "source")).alias("to_source"),
        (F.col("has_small") & ~few).alias("for_lang"),
        (small & few).alias("for_all"),
    )
    groups = saved(groups, "quality-moved")
    joined = vectors.join(groups, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")))
    own = joined.withColumns({"own_lang": F.concat(F.lit("="), "lang"), "own": ~(F.col("to_source").eqNullSafe(every)), "lang": F.col("to_lang"), "source": F.col("to_source")})
    own = saved(own.drop("_l", "_s", "to_lang", "to_source", "for_all"), "quality-vectors")
    passed, values = own.filter(~F.col("base_failed")), [f"x{i}" for i in range(DIM)]
    sample = passed.filter("own").select("lang", "source", *values)
    sample = sample.union(passed.filter("for_lang").select(F.col("own_lang").alias("lang"), every.alias("source"), *values))
    if not groups.filter("for_all").isEmpty():
        sample = sample.union(passed.select(every.alias("lang"), every.alias("source"), *values))
    return own, sample


def outside_limit(used: float, confidence: float) -> float:
    """The squared distance that a row outside an estimate of ``used`` rows exceeds with probability
    1 - ``confidence``: (w + 1) (w - 1) p / (w (w - p)) times an F(p, w - p) quantile."""
    w = max(float(used), DIM + 1.0)
    b = (w - DIM) / 2
    low, high = 0.0, 1.0  # x = nu / (nu + p f) has the tail I_x(b, p / 2), a polynomial for even p
    for _ in range(200):
        x = (low + high) / 2
        tail, term = 0.0, 1.0
        for j in range(DIM // 2):
            tail += term
            term *= (b + j) / (j + 1) * (1 - x)
        low, high = (x, high) if x**b * tail < 1 - confidence else (low, x)
    f = (1 / max(low, 1e-300) - 1) * (w - DIM) / DIM
    return (w + 1) * (w - 1) * DIM / (w * (w - DIM)) * f


def quality_verdicts(docs: DataFrame, confidence: float = 1 - 1e-6, min_group: int = 5 * DIM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the squared distance (null: no estimate)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    with scratch(docs.sparkSession) as keep:
        counts = saved(document_counts(docs), "quality-counts")
        vectors, sample = pooled(statistic_vector(counts.withColumn("base_failed", failed)), min_group)
        fitted = concentrate(sample)
        keep(vectors)
        limits = saved(fitted.select("used").distinct().mapInArrow(lambda batches: _limits(batches, confidence), "_used long, far double"), "quality-limits")
        fitted = keep(saved(fitted.join(limits, F.col("used") == F.col("_used")).drop("_used", "start", "det", "done"), "quality-fitted"))
    judged = matched(vectors, fitted, "left").withColumn("distance2", F.when(F.col("rows") >= LEAST, squared_distance()))
    far = F.coalesce(F.col("distance2") > F.col("far"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance2")


def _limits(batches: Iterator[pa.RecordBatch], confidence: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        used = batch.column(0)
        yield pa.RecordBatch.from_arrays([used, pa.array([outside_limit(n, confidence) for n in used.to_pylist()], pa.float64())], names=["_used", "far"])
