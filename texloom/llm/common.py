"""What the training-data operators share: staging tables, stable folds and word patterns."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Used only where the session names no shared folder, as in tests.
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``); a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = OWN_CHECKPOINT_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor repeats no earlier stage, and readers
    prune columns. The folder belongs to the cluster, which cleans it.
    """
    path = f"{shared_dir(df.sparkSession)}/texloom/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python at most so many a batch, from now on in this session: the JVM and the worker each hold a batch or two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def labelled_sample(labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """At most ``rows`` labelled ids outside fold 0, in the order of a hash of the id.

    Columns: __id, __label. Rows without an id or label are left out; of
    repeated ids the smallest label stays. The bound makes the result small
    enough to broadcast and to collect.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label"))
    known = known.where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & (fold_of(F.col("__id")) != 0))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"))
    return known.orderBy(F.xxhash64("__id"), "__id").limit(rows)


#: Called when memory is given back: what modules keep between batches, but not between tasks.
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on beside an executor's later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    for drop in KEPT:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library has no such call


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back at the end of its task, and first what other functions left in its worker."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
