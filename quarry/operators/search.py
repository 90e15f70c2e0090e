"""Full-text search: postings as DataFrames, BM25 ranking.

A query has words (any may match), ``+word`` (must), ``-word`` (must not), ``"a phrase"`` (must
follow each other) and ``column:word``.  Every column of a row is searched.

A table of the catalog is searched by its index: a segment of postings for each of its files, made
when a search first meets the file.  Files are never changed, so an index follows every write: rows
that are added or rewritten are in new files, and segments of files that went go with them.  Other
DataFrames are scanned.  Ties are in the order of the columns' values, texts by their MD5.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Rows that a search returns.
TOP = 100
_SPLIT = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]+"
_PART = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


@dataclass
class Query:
    should: list[tuple[str | None, str]] = field(default_factory=list)
    must: list[tuple[str | None, str]] = field(default_factory=list)
    never: list[tuple[str | None, str]] = field(default_factory=list)
    phrases: list[tuple[str | None, list[str], bool]] = field(default_factory=list)  # column, words, wanted

    @property
    def terms(self) -> list[tuple[str | None, str]]:
        return list(dict.fromkeys(self.should + self.must))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse_query(text: str) -> Query:
    out = Query()
    for sign, column, phrase, word in _PART.findall(text):
        if word.upper() in ("AND", "OR"):
            continue
        words = _words(phrase or word)
        if phrase and len(words) > 1:
            out.phrases.append((column or None, words, sign != "-"))
            if sign != "-":
                out.must += [(column or None, w) for w in words]
            continue
        target = out.must if sign == "+" else out.never if sign == "-" else out.should
        target += [(column or None, w) for w in words]
    return out


def _raw(df: DataFrame, column: str | None = None) -> Column:
    names = [column] if column else df.columns
    return F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in names])


def _joined(df: DataFrame, column: str | None = None) -> Column:
    return F.lower(_raw(df, column))


def text_of(df: DataFrame, column: str | None = None) -> Column:
    """The searched text of a row: words between single spaces, a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(_joined(df, column), _SPLIT, " ")), F.lit(" "))


def length_of(df: DataFrame) -> Column:
    """The words of a row; a row without words counts as one."""
    return F.greatest(F.regexp_count(_raw(df), F.lit(_WORD)), F.lit(1))


def _idf(rows: int, holding: int) -> float:
    return math.log(1 + (rows - holding + 0.5) / (holding + 0.5))


def _part(idf: float, tf: Column, length: Column, average: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _best(rows: DataFrame, names: list[str], top: int | None) -> DataFrame:
    """Rows by score, ties by the columns' values."""
    kinds = dict(rows.dtypes)
    ties = [F.md5(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`") if kinds[c] in _PLAIN else F.col(f"`{c}`").cast("string") for c in names]
    out = rows.orderBy(F.desc("_score"), *ties)
    return (out if top is None else out.limit(top)).select(*[F.col(f"`{c}`") for c in names], "_score")


_PLAIN = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "boolean"}


def search(df: DataFrame, query: str, top: int | None = TOP) -> DataFrame:
    """Rows that match, with ``_score``, best first.

    Only rows that hold a word of the query as a string anywhere are split into words at all.  One scan
    gives the corpus figures, one the matches, which are sorted by score and short keys."""
    q = parse_query(query)
    terms = q.terms
    if not terms:
        return df.withColumn("_score", F.lit(0.0)).limit(0)
    columns = {c for c, _ in terms + q.never} | {c for c, _, _ in q.phrases}
    asked = [*terms, *q.never]
    # Spaces are doubled so that neighbours that are the same word are both counted.  Bytes are counted, which
    # texts know without being read.
    double = lambda text: F.replace(text, F.lit(" "), F.lit("  "))
    count = lambda c, w: (F.octet_length(F.col(f"_text_{c or ''}")) - F.octet_length(F.replace(F.col(f"_text_{c or ''}"), F.lit(f" {w} "), F.lit("  ")))) / F.lit(len(w.encode()))
    held = [F.contains(F.col(f"_text_{c or ''}"), F.lit(" " + "  ".join(words) + " ")).cast("double") for c, words, _ in q.phrases]

    def counted(of: DataFrame, length: Column) -> DataFrame:
        """Rows that hold a word as a string, with an array of counts.

        The counts pass through a generator of one row: the optimiser would copy a plain expression, and
        the splitting of the text in it, into every use by a filter or a score."""
        any_word = F.lit(False)
        for _, w in terms:
            any_word = any_word | F.contains(F.col("_joined"), F.lit(w))
        texts = of.withColumn("_joined", _joined(df)).withColumn("_may", any_word)
        texts = texts.withColumns({f"_text_{c or ''}": F.when(F.col("_may"), double(text_of(df, c))) for c in columns}).withColumn("_len", length)
        counts = F.array(*[F.coalesce(count(c, w), F.lit(0.0)) for c, w in asked], *held)
        return texts.select(*[F.col(f"`{c}`") for c in of.columns], "_len", F.explode(F.array(counts)).alias("_tf"))

    # One scan for the figures of all rows, one for the matches.
    figures = counted(df, length_of(df)).agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    rows = holding = figures
    n, average = rows["n"], rows["avg"] or 1.0
    score, keep = F.lit(0.0), F.lit(True)
    for i, term in enumerate(asked):
        tf = F.col("_tf")[i]
        if i < len(terms):
            score = score + _part(_idf(n, holding[f"df{i}"] or 0), tf, F.col("_len"), average)
            keep = keep & (tf > 0) if term in q.must else keep
        else:
            keep = keep & (tf == 0)
    for i, (_, _, wanted) in enumerate(q.phrases, len(asked)):
        keep = keep & (F.col("_tf")[i] == (1.0 if wanted else 0.0))
    if not q.must:  # else a word that must be there is
        keep = keep & F.exists(F.slice("_tf", 1, len(terms)), lambda x: x > 0)
    # Rows without any word are left out before they are split into words.
    any_word = F.lit(False)
    for _, w in terms:
        any_word = any_word | F.contains(_joined(df), F.lit(w))
    matched = counted(df.filter(any_word), length_of(df)).filter(keep).withColumn("_score", score)
    return _best(matched, df.columns, top)


#: Folders of an index's postings; a query opens those of its own terms.
BUCKETS = 64
_SEGMENT = {"postings": "_row long, field string, term string, tf long, bucket int", "lengths": "_row long, length int"}


def write_segment(rows: DataFrame, path: str) -> None:
    """Postings and lengths of ``rows``, which have numbers ``_row`` that stay the same at every reading."""
    df = rows.drop("_row")
    # Terms are counted in their row's task, as runs of the sorted words: nothing is shuffled.  Each step is a
    # generator, which the optimiser doesn't copy into the uses of what it gives.
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.sort_array(F.split(F.trim(text_of(df, c)), " ")).alias("terms")) for c in df.columns])
    words = rows.select("_row", F.explode(fields).alias("f")).select("_row", F.col("f.field").alias("field"), F.col("f.terms").alias("_terms"))
    term = lambda i: F.get("_terms", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_terms") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
    runs = words.select("_row", "field", "_terms", F.explode(F.array(starts)).alias("_starts"))
    run = lambda i, k: F.struct(term(i).alias("term"), (F.coalesce(F.get("_starts", k + 1), F.size("_terms")) - i).cast("long").alias("tf"))
    counted = runs.select("_row", "field", F.explode(F.transform("_starts", run)).alias("p")).select("_row", "field", "p.term", "p.tf").filter("term <> ''")
    counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.select("_row", length_of(df).alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")


class SearchIndex:
    """A search over segments: ``segments`` are (folder, rows with ``_row``, which rows of it count).

    Rows are told apart by segment and number.  A query reads its own terms' postings only; phrases are
    checked on the rows that their words leave."""

    def __init__(self, spark: SparkSession, segments: list[tuple[str, DataFrame]]):
        self.spark, self.segments = spark, segments
        self.lengths = self._all("lengths")
        self.figures = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()

    def _all(self, kind: str) -> DataFrame:
        out = None
        for k, (path, _) in enumerate(self.segments):
            own = self.spark.read.schema(_SEGMENT[kind]).parquet(f"{path}/{kind}").withColumn("_segment", F.lit(k))
            out = own if out is None else out.unionByName(own)
        return out

    @staticmethod
    def build(df: DataFrame, path: str) -> SearchIndex:
        """An index of any DataFrame, with a copy of its rows."""
        spark = df.sparkSession
        df.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        write_segment(rows, path)
        return SearchIndex(spark, [(path, rows)])

    def search(self, query: str, top: int | None = TOP) -> DataFrame:
        q = parse_query(query)
        terms = q.terms
        names = [c for c in self.segments[0][1].columns if c != "_row"]
        rows = None
        for k, (_, own) in enumerate(self.segments):
            own = own.withColumn("_segment", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if not terms:
            return rows.select(*names, F.lit(0.0).alias("_score")).limit(0)
        asked = terms + q.never
        words = sorted({w for _, w in asked})
        buckets = self.spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).collect()
        own = self._all("postings").filter(F.col("bucket").isin(*[r[0] for r in buckets]) & F.col("term").isin(*words))
        held = lambda c, w: F.sum(F.when((F.col("term") == w) & (F.lit(True) if c is None else F.col("field") == c), F.col("tf")).otherwise(0))
        found = own.groupBy("_segment", "_row").agg(*[held(c, w).alias(f"_tf{i}") for i, (c, w) in enumerate(asked)])
        seen = found.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
        score, keep = F.lit(0.0), F.lit(True)
        for i, term in enumerate(asked):
            tf = F.col(f"_tf{i}")
            if i < len(terms):
                score = score + _part(_idf(self.figures["n"], seen[f"df{i}"] or 0), tf, F.col("length"), self.figures["avg"] or 1.0)
                keep = keep & (tf > 0) if term in q.must else keep
            else:
                keep = keep & (tf == 0)
        scored = found.filter(keep).join(self.lengths, ["_segment", "_row"]).select("_segment", "_row", score.alias("_score")).filter("_score > 0")
        out = rows.join(scored, ["_segment", "_row"])
        for c, phrase, good in q.phrases:
            has = F.contains(text_of(rows.drop("_row", "_segment"), c), F.lit(" " + " ".join(phrase) + " "))
            out = out.filter(has if good else ~has)
        return _best(out, names, top)


def table_index(spark: SparkSession, files: list[tuple[str, DataFrame]], segments: dict[str, str], place: Callable[[str], str]) -> SearchIndex:
    """The index of a table's files: segments that are missing are made.  A row's number is its file's in
    the folder and its place in it."""
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long") * (1 << 40) + F.col("_metadata.row_index")
    out = []
    for path, rows in files:
        numbered = rows.select("*", number.alias("_row"))
        if path not in segments:
            segments[path] = place(path)
            write_segment(numbered, segments[path])
        out.append((segments[path], numbered))
    return SearchIndex(spark, out)
