"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_only, id_filter, remove, saved, scratch
from .decontam import clean_documents
from .neardup import row_components
from .packing import pack_documents
from .queries import TOKENIZER, table
from .suffixdedup import numbered, suffix_dedup
from .toxicity import accepted, held_out, learn_lexicon

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon rejects; it is learned from the labelled ones not held out."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), "toxic").filter(~held_out())
    return accepted(docs.select(*COLUMNS), learn_lexicon(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    docs = numbered(docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long")))
    with scratch(spark) as keep:
        gone = keep(saved(row_components(docs).filter("not kept").select(F.col("doc").alias("_gone")), "near-duplicates"))
    # Only documents that may have to go are shuffled.
    held = id_filter(gone, "_gone")
    unsure = held_only(docs, held, "doc").join(gone, F.col("doc") == F.col("_gone"), "left_anti")
    return held_only(docs, held, "doc", False).unionByName(unsure).select(*COLUMNS)


def suffix_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings of 100 that start earlier; a character cut in part goes whole."""
    kept = suffix_dedup(docs, keep=["lang", "source"], characters=True)
    return kept.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids: one row per piece."""
    return pack_documents(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_removal), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again as the next one's.  What a stage
    wrote besides goes when it is done, and its rows when the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(saved(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before:
            remove(spark, before)
        before = docs.quarry_path
    return docs
