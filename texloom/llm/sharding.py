"""Sharding by histogram sort: exact byte counts below probes, refined, then one exchange.

The sort key is (hash of the text, doc_id), so equal texts are neighbours and a
group is cut only where it outweighs the tolerance. A compact key table (no texts)
is staged once; each round counts bytes below candidate boundaries on it and refines
the cells that still hold an open splitter. Splitters between parts of a shard bound what
one task sorts. Built-in expressions only.
"""

from __future__ import annotations

import bisect
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from texloom.llm.common import stage

LEAST = -(1 << 63)
#: Cells that a cell with an open splitter is divided into, and rounds at most.
FANOUT, ROUNDS = 64, 30


def key_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes plus one), crc, h, d. A null text counts as empty; a null id sorts first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    i = F.col(id_col).cast("long")
    return docs.select(
        i.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.xxhash64(text).alias("h"), F.coalesce(i, F.lit(LEAST)).alias("d"),
    )


def _counted(keys: DataFrame, *by: Column) -> list:
    rows = keys.groupBy(*by).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1"),
    ).collect()
    return sorted(rows, key=lambda r: (r["h0"], r["h1"], r["d0"]))


def _inside(cell: dict) -> Column:
    same = F.col("h").between(cell["h0"], cell["h1"])
    return same & F.col("d").between(cell["d0"], cell["d1"]) if cell["h0"] == cell["h1"] else same


def _part_of(cell: dict) -> Column:
    """A monotone map of the cell's keys to FANOUT parts."""
    name, lo, hi = ("d", cell["d0"], cell["d1"]) if cell["h0"] == cell["h1"] else ("h", cell["h0"], cell["h1"])
    width = (float(hi) - float(lo)) / FANOUT
    return F.least(F.lit(FANOUT - 1), F.floor((F.col(name).cast("double") - F.lit(float(lo))) / F.lit(width))).cast("int")


def find_splitters(keys: DataFrame, shards: int, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Boundaries (h, d) of shards * parts ranges, and the rounds' numbers of open splitters.

    A row goes left of a boundary if (h, d) is less than it. Borders of shards are
    within ``tolerance`` of a shard's bytes, others within a quarter of a part, unless
    one key alone weighs more.
    """
    bits = max(6, math.ceil(math.log2(shards * parts * FANOUT)))
    found = _counted(keys, F.shiftright("h", 64 - bits))
    cells = [c.asDict() for c in found]
    total = sum(c["bytes"] for c in cells)
    ranges = shards * parts
    wanted = {k: total * k / ranges for k in range(1, ranges)}
    slack = {k: tolerance * total / shards if k % parts == 0 else total / ranges / 4 for k in wanted}
    opened, closed = [], {}
    for _ in range(ROUNDS):
        below = [0, *accumulate(c["bytes"] for c in cells)]
        starts = [(c["h0"], c["d0"] if c["h0"] == c["h1"] else LEAST) for c in cells]
        closed, to_split = {}, {}
        for k, t in wanted.items():
            i = min(len(cells) - 1, max(0, bisect.bisect_right(below, t) - 1))
            c = cells[i]
            near = i if t - below[i] <= below[i + 1] - t else i + 1
            closed[k] = starts[near] if near < len(cells) else ((1 << 63) - 1, (1 << 63) - 1)
            divisible = c["h0"] < c["h1"] or float(c["d1"]) > float(c["d0"])
            # A group of equal texts is cut only if it outweighs both its neighbours' slack.
            if abs(below[near] - t) > slack[k] and divisible and c["rows"] > 1:
                to_split[i] = c
        opened.append(len(to_split))
        if not to_split:
            break
        order = sorted(to_split)
        which = part = F
        for i in order:
            which = which.when(_inside(cells[i]), F.lit(i))
            part = part.when(_inside(cells[i]), _part_of(cells[i]))
        # A single text's cell is cut by id: its rows are all of that hash.
        finer = _counted(keys.select("*", which.alias("c"), part.alias("p")).where(F.col("c").isNotNull()), F.col("c"), F.col("p"))
        cells = sorted([c for i, c in enumerate(cells) if i not in to_split] + [{k: v for k, v in c.asDict().items()} for c in finer], key=lambda c: (c["h0"], c["h1"], c["d0"]))
    return [closed[k] for k in sorted(closed)], opened


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below a row's key, as a balanced tree of tests."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        h, d = bounds[mid]
        left = (F.col("h") < h) | ((F.col("h") == h) & (F.col("d") < d))
        return F.when(left, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 250_000) -> DataFrame:
    """Shard and slot of every row: shards near equal in bytes, slots gapless from 0.

    Columns: doc_id, size, text_crc32, shard, slot. Null texts count as empty, null ids
    sort first, repeated rows each get a slot of their own; equal texts share a shard unless
    a border has to cut a group heavier than the tolerance. Rows alike in text and id stay together,
    however heavy. A range holds about ``rows_a_part`` rows up to 64 ranges a shard, and more beyond; its
    sort is of 40 bytes a row and spills. An empty table gives no rows. Other columns are not read.
    """
    keys = stage(key_table(docs, id_col, text_col), "shard_keys")
    n = keys.count()
    parts = min(64, max(4, n // (shards * rows_a_part)))
    if n:
        bounds, _ = find_splitters(keys, shards, parts, tolerance)
    else:
        bounds = [(0, 0)] * (shards * parts - 1)
    placed = keys.withColumn("r", _range_of(bounds))
    held = {r["r"]: r["n"] for r in placed.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = []
    for s in range(shards):
        first += [0, *accumulate(held.get(s * parts + k, 0) for k in range(parts - 1))]
    rank = F.row_number().over(Window.partitionBy("r").orderBy("h", "d"))
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.floor(F.col("r") / parts).cast("int").alias("shard"),
        (rank - 1 + F.get(F.array(*[F.lit(int(x)).cast("long") for x in first]), F.col("r"))).cast("long").alias("slot"),
    )
