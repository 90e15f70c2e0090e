"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import DataFrame, SparkSession


def edge_docs(spark: SparkSession) -> DataFrame:
    long = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
    rows = [
        (1, "a plain text of some words, said once", "en", "src", 5), (2, None, "en", "src", None), (3, "", None, None, 0), (None, "no id here " * 20, "en", None, 1), (None, None, None, None, None),
        (4, long, "en", "src", 9), (5, "same text " * 30, "de", "a", 1), (6, "same text " * 30, "de", "a", 1), (6, "same text " * 30, "de", "a", 1), (7, " \n\t  ", "xx", "src", 2), (8, "éß" * 200 + "\n" + "éß" * 200, "fr", "b", 3), (9, "same text " * 30 + "x", "de", "a", 1), (9, "another text under one id", "de", "a", 1),
    ]
    return spark.createDataFrame([(*r, "c", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, doc double")


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)
