"""Written tables in the folder that the driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only by local sessions that leave spark.checkpoint.dir unset, as tests do.
DEFAULT_SHARED = "file:///tmp/checkpoints/quarry"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


def stored(df: DataFrame, name: str, root: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to a new place and read it back: the new version of a table, with no lineage."""
    spark = df.sparkSession
    path = f"{root or shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


#: A table's files: folders, or single files of folders of which others are no longer its own, each
#: with its level.  Rows that are added are of level 0; ``FANOUT`` parts of a level become one of the next.
Parts = tuple[tuple[str, int], ...]
FANOUT = 8
#: The level of rewritten rows, which only a change of rows rewrites again.
SETTLED = 99


class Files:
    """The file system under the shared folder, with paths in one spelling."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._uri = spark._jvm.java.net.URI

    def _on(self, path: str):
        place = self._path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def spelled(self, path: str) -> str:
        """A path with its scheme and host, as the file system itself writes it."""
        place, fs = self._on(path)
        return fs.makeQualified(place).toString()

    def of_uri(self, uri: str) -> str:
        """The same of a path that is escaped, as a row's file name is."""
        return self.spelled(self._path(self._uri(uri)).toString())

    def inside(self, path: str) -> list[str]:
        """The data files of a folder, or the file itself."""
        place, fs = self._on(path)
        if fs.getFileStatus(place).isFile():
            return [self.spelled(path)]
        names = [f.getPath() for f in fs.listStatus(place) if f.isFile()]
        return sorted(self.spelled(p.toString()) for p in names if p.getName()[0] not in "._")

    def size(self, path: str) -> int:
        place, fs = self._on(path)
        return fs.getContentSummary(place).getLength()

    def delete(self, path: str) -> None:
        place, fs = self._on(path)
        fs.delete(place, True)


def read_parts(spark: SparkSession, parts: Parts, schema: StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[p for p, _ in parts])


def due(parts: Parts) -> list[str] | None:
    """Parts that are to be one: ``FANOUT`` of the lowest level that has so many."""
    for level in sorted({level for _, level in parts if level < SETTLED}):
        own = [p for p, at in parts if at == level]
        if len(own) >= FANOUT:
            return own
    return None


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options: object) -> DataFrame:
    """Any of Spark's file sources, by kind: parquet, orc, csv, json or text."""
    return spark.read.format(kind).options(**options).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: object) -> None:
    """Any of Spark's file sinks, by kind."""
    df.write.format(kind).mode(mode).options(**options).partitionBy(*(partition_by or [])).save(path)


def write_response(df: DataFrame, path: str) -> None:
    """One JSON object per row, as the query interface returns rows."""
    df.write.mode("overwrite").json(path)
