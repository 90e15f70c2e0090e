"""Joins on order: as-of and interval joins without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` of the same ``by`` keys whose
    ``on`` isn't later; null where there is none, and where ``on`` is null.

    Both sides are put in one order by a window; each row takes the last value seen, so the join is one
    sort by (``by``, ``on``).  Of right rows with one time the last by their values counts; keys that are
    null match each other.  Columns of ``left`` with the name of a value are refused."""
    by = by or []
    values = values or [c for c in right.columns if c not in (*by, on)]
    if clash := set(values) & set(left.columns):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
    mine = left.select(*keys, F.col(f"`{on}`").alias("_t"), F.lit(1).alias("_side"), F.struct(*[f"`{c}`" for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    theirs = right.filter(F.col(f"`{on}`").isNotNull()).select(*keys, F.col(f"`{on}`").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    seen = mine.unionByName(theirs).withColumn("_last", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1")
    return seen.select("_row.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_last.`{v}`")).alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and a span that holds it (``start`` <= ``at`` < ``end``), numbers all three.

    Spans are put into every bin of ``width`` that they touch and points into their own, so it is an
    equality join that Spark can split; choose a width near the usual span.  Names must differ."""
    if clash := set(points.columns) & set(spans.columns):
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    bin_of = lambda c: F.floor(c / F.lit(float(width)))
    low, high = F.col(f"`{start}`"), F.col(f"`{end}`")
    binned = spans.filter(low < high).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    joined = points.withColumn("_bin", bin_of(F.col(f"`{at}`"))).join(binned, "_bin")
    return joined.filter((F.col(f"`{at}`") >= low) & (F.col(f"`{at}`") < high)).drop("_bin")
