"""Chat formatting: the dialogue from every participant's side; native Spark only.

For each participant of a conversation (a distinct role but ``system``) the whole dialogue is rendered:
the participant's own turns as ``assistant``, the others' as ``user`` with a name, system turns as they
are.  Only the participant's own text and its end mark bear loss.

A dialogue of at most ``PART`` turns is one row.  A longer one is the texts of its rows, its parts,
joined in order of ``first_turn`` (the turns before the part): parts are cut by the place of a turn in the
dialogue, whatever its number is, so no task ever holds more than ``PART`` turns of one.  Rows:
conversation, participant, first turn, turns, the rendered text, and the spans of its characters that
bear loss.

Turns are ordered by number, role and MD5 of the text; repeated rows are repeated turns.  A
null text is empty, a null role is the participant ``unknown``, a null turn counts as turn -1, and a
null conv_id is one conversation.  A conversation of system turns alone has no participant and no
rows.  In texts, the marks' first two characters are set apart by a space, so a turn can't forge
them.  Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, scratch

#: Turns of a part at most.
PART = 1024
BEGIN, END = "<|im_start|>", "<|im_end|>"


def placed(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with ``place``: the turns of the conversation before.

    Ranges of the order are sorted apart, so a conversation of any length is in many; a range's
    first number is the rows of the ranges before it, one row a range.  Equal rows are spread too."""
    with scratch(turns.sparkSession) as keep:
        # A digest bounds the keys that ranges are sampled by; equal rows differ by a number.
        keys = ["conv_id", "turn", "role", "_digest"]
        marked = turns.withColumns({"_digest": F.md5("text"), "_tie": F.monotonically_increasing_id()})
        ranged = marked.repartitionByRange(*keys, "_tie").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
        counted = ranged.select(*turns.columns, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("inside"))
        counted = keep(saved(counted, "turns"))
        ranges = counted.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("low"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = counted.join(F.broadcast(ranges.select("range", (before - F.col("low")).alias("base"))), "range").withColumn("number", F.col("base") + F.col("inside"))
        first = numbered.groupBy("conv_id").agg(F.min("number").alias("first")).withColumnRenamed("conv_id", "c")
        first = keep(saved(first, "dialogues"))
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(*turns.columns, (F.col("number") - F.col("first")).alias("place"))


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to conv_id, participant, first_turn, n_turns, rendered, mask
    (array of struct<start, end>), n_masked."""
    t = turns.select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    # A part is an ordered list of bounded length; its participants are joined to it, not to turns.
    first_turn = (F.col("place") - F.col("place") % part).alias("first_turn")
    long = saved(t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part).select(F.col("conv_id").alias("_c"), F.lit(True).alias("_long")), "long-dialogues")
    # A dialogue of one part is put in order where it is gathered; only longer ones are numbered first.
    marked = t if long.isEmpty() else t.join(long, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    short = marked if long.isEmpty() else marked.filter("_long is null").drop("_long")
    ordered = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("digest"), "text"))).alias("turns"))
    ordered = ordered.select("conv_id", F.lit(0).cast("long").alias("first_turn"), F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    roles = F.array_distinct(F.filter(F.transform("turns", lambda x: x["role"]), lambda r: r != "system"))
    each = ordered.select("conv_id", "first_turn", "turns", F.explode(roles).alias("participant"))
    if not long.isEmpty():
        many = marked.filter("_long").drop("_long")
        # Participants of a dialogue, one row each: repeated ones go before the exchange.
        people = many.filter("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
        parted = placed(many).groupBy("conv_id", first_turn).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
        parted = parted.select("conv_id", "first_turn", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
        each = each.unionByName(parted.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    own = lambda x: x["role"] == F.col("participant")
    head = lambda x: F.when(own(x), F.lit(f"{BEGIN}assistant\n")).when(x["role"] == "system", F.lit(f"{BEGIN}system\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), F.replace(F.regexp_replace(x["role"], r"\s", "_"), F.lit("<|"), F.lit("< |")), F.lit("\n")))
    parts = each.select("conv_id", "participant", "first_turn", F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), own(x).alias("own"))).alias("parts"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"),
        F.when(x["own"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(acc["mask"]).alias("mask"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    return parts.select(
        "conv_id",
        "participant",
        "first_turn",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"),
    ).withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
