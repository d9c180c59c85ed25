"""How runs go: which phases are asked for, running failure ratios, saves, counters, results as JSON, what is missing."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from texloom.functions import tables as T
from texloom.operators.rules import probable_path

VALID = tuple(p for p in T.ALL_PHASES if p != "scan")
SKIPPED_KEYS = ("error", "errors", "reason", "fallback")
OUT_OF_MEMORY = ("out of memory", "cuda error: out of memory", "cudaerrormemoryallocation", "cudnn_status_alloc_failed", "cublas_status_alloc_failed", "hip error: out of memory")


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def requested(phases: Column) -> Column:
    """struct(unknown, ordered, missing) of an array of phase names: names that are no phases, phases in the order in
    which they run, and what those need that was not asked for."""
    needs = F.flatten(F.filter(F.array(*[F.when(F.array_contains(phases, p), strings(n)) for p, n in T.PHASE_NEEDS.items()]), lambda x: x.isNotNull()))
    return F.struct(
        F.array_sort(F.array_except(phases, strings((*VALID, "scan")))).alias("unknown"), F.filter(strings(VALID), lambda p: F.array_contains(phases, p)).alias("ordered"), F.array_sort(F.array_except(needs, phases)).alias("missing")
    )


def running_failures(results: DataFrame, when: str = "ts", tie: str = "event_id", ratio: float = 0.5, least: int = 10, save_every: int = 25, spans: int = 64) -> DataFrame:
    """Per phase in order of time: processed, failures, ratio so far, stop and save.

    ``stop``: the phase would be given up here; ``save``: every so many completions the state is saved. Time is
    cut into spans of about equal numbers of rows; sums of earlier spans come from a small table, so a task sorts one span
    of one phase, not a phase.
    """
    at = F.col(when).cast("timestamp").cast("double") if "timestamp" in dict(results.dtypes)[when] else F.col(when).cast("double")
    cuts = results.select(at.alias("t")).approxQuantile("t", [k / spans for k in range(1, spans)], 0.001) if spans > 1 else []
    span = F.lit(0)
    for c in sorted(set(cuts)):
        span = span + (at >= c).cast("int")
    rows = results.withColumn("span", span)
    sums = rows.groupBy("phase", "span").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("f"))
    before = Window.partitionBy("phase").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("phase", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    w = Window.partitionBy("phase", "span").orderBy(when, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(sums), ["phase", "span"])  # spans times phases
    rows = rows.withColumns({"processed": F.col("n0") + F.count(F.lit(1)).over(w), "failures": F.col("f0") + F.sum(F.col("failed").cast("long")).over(w)})
    rows = rows.withColumn("ratio", F.col("failures") / F.col("processed"))
    return rows.withColumns({"stop": (F.col("processed") >= least) & (F.col("ratio") >= ratio), "save": F.col("processed") % save_every == 0}).drop("span", "n0", "f0")


def missing_paths(payloads: DataFrame, files: DataFrame, key: str = "asset_id", payload: str = "payload") -> DataFrame:
    """(key, at, path) of file paths in a map of results that are not among the files (path); notes on errors are not looked at."""
    rows = payloads.select(key, F.explode(payload).alias("at", "path")).where(~F.lower("at").isin(*SKIPPED_KEYS) & probable_path(F.col("path")))
    return rows.join(files.select("path").distinct(), "path", "left_anti").select(key, "at", "path")


def tail(text: Column, most: int, longest: int) -> Column:
    """struct(omitted, lines): the last lines of a text, each cut at a length with dots."""
    lines = F.split(text, r"\r\n|\n|\r")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    cut = F.transform(F.slice(lines, F.greatest(F.size(lines) - most, F.lit(0)) + 1, F.lit(most)), lambda x: F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest), F.lit("..."))).otherwise(x))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.struct(F.greatest(F.size(lines) - most, F.lit(0)).alias("omitted"), cut.alias("lines")))


def log_level(line: Column) -> Column:
    level = F.regexp_extract(line, r"\[(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]", 1)
    return F.when(level != "", level).otherwise(F.lit("OTHER"))


def log_shown(line: Column, levels: tuple[str, ...], needle: str = "") -> Column:
    found = log_level(line).isin(*levels)
    return found & F.lower(line).contains(needle.strip().lower()) if needle.strip() else found


def out_of_memory(message: Column) -> Column:
    """Whether a failure's text speaks of the accelerator's memory."""
    text, found = F.lower(F.coalesce(message, F.lit(""))), F.lit(False)
    for m in OUT_OF_MEMORY:
        found = found | text.contains(m)
    return found


def under(path: Column, root: str) -> Column:
    """Whether a canonical path is the root or below it."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")


class Cancelled(RuntimeError):
    """A run was cancelled or ran out of time."""


def guarded(spark: SparkSession, work: Callable[[], object], seconds: float | None = None, cancel: threading.Event | None = None) -> object:
    """``work()`` with all its Spark jobs stopped at a time limit or once ``cancel`` is set; then Cancelled is raised.

    Jobs carry a tag of their own, so others of the session run on.
    """
    tag = f"texloom-{uuid.uuid4().hex}"
    done, stopped = threading.Event(), threading.Event()
    ends = time.monotonic() + seconds if seconds is not None else None

    def watch() -> None:
        while not done.wait(0.05):
            if (cancel is not None and cancel.is_set()) or (ends is not None and time.monotonic() > ends):
                stopped.set()
                spark.interruptTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.addTag(tag)
    watcher.start()
    try:
        result = work()
    except Exception as e:
        if stopped.is_set():
            raise Cancelled(tag) from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.removeTag(tag)
    if stopped.is_set():
        raise Cancelled(tag)
    return result


def progress(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and all tasks of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for k in tracker.getActiveStageIds() if (s := tracker.getStageInfo(k)) is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


def tile_size(tile: Column, least: Column, free_mb: Column) -> Column:
    """A tile halved, down to ``least``, until 300 float copies of its three channels fit into the free memory."""
    floor = F.least(least, tile)
    halves = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.greatest(F.call_function("shiftright", tile.cast("int"), k), floor))
    fits = F.filter(halves, lambda t: (t * t * (3 * 4 * 300 / 1048576.0) <= free_mb) | (t <= floor))
    return F.get(fits, F.lit(0)).cast("int")


def device_index(device: Column) -> Column:
    """The number behind the colon of a device's name; 0 without one."""
    n = F.regexp_extract(F.coalesce(device, F.lit("")), r":(\d+)$", 1)
    return F.when(n == "", F.lit(0)).otherwise(n.cast("int"))
