"""Training-data operators: scoring, deduplication, packing, sharding and archives.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and keeps its intermediate tables in the folder that the session
names in ``spark.checkpoint.dir``.
"""
