"""Connected components of a link table: alternating large-star and small-star steps.

Every step is an aggregation and a join on node ids, so a hub with many links is never gathered
in one row. Steps end when the links stop changing; then each node points to the least of
its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v to new links (larger, least)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _signature(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root) for every node of a link table; root is the least node of its component."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = stage(pairs, "links")
    seen = _signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = stage(_star(_star(now, large=True), large=False), "links")
        after = _signature(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
