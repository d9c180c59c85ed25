"""New files as a stream: each trigger takes what arrived, state lives in the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from texloom.functions import catalog as C


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (filepath, file_hash, texture_type, material) of files that appear under a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    p = F.col("path")
    return files.select(p.alias("filepath"), F.sha2("content", 256).alias("file_hash"), C.texture_type(p).alias("texture_type"), C.material(F.regexp_extract(p, "[^/]*$", 0)).alias("material"))


def catalogue(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the arrivals to a table once and stop; a later call takes only newer files."""
    return arrivals(spark, root).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
