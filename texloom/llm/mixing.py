"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w (u from a hash of seed, id and text,
w its quality weight); the smallest keys win. A source first takes its complete
epochs, then a fraction: its documents in key order, prefix-summed to what is left of the
budget. Keys are binned and bins are summed per source; the bin in which a budget ends is cut again
and again until few rows are left in it, and only those are sorted, so no task sorts a whole
source however its weights are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from texloom.llm.common import WORD, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_EPOCHS = 1.5, 2
SEED = 17
#: Tables with a row per source are broadcast up to so many rows, and joined by a shuffle beyond.
MOST_BROADCAST = 10_000
#: Sources whose sizes the driver holds; more are refused.
MOST_SOURCES = 2_000_000
#: A bin in which a budget ends is cut until it has so few rows, or one key.
EDGE_ROWS = 50_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MOST_EPOCHS) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; the excess is shared again."""
    caps = [most * s for s in sizes]
    targets, full, left = [0.0] * len(sizes), set(), min(total, sum(caps))
    open_ = [i for i, c in enumerate(caps) if c > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level >= caps[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * level
            break
        for i in over:
            targets[i] = float(caps[i])
            left -= caps[i]
            full.add(i)
        open_ = [i for i in open_ if i not in full]
        if left <= 0:
            break
    return targets


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of characters that are neither symbols nor digits, to the fourth power."""
    n = F.length(text)
    odd = F.length(F.regexp_replace(text, r"[^#*$%&|<>!0-9]+", ""))
    return F.when(n > 0, F.greatest(F.lit(0.1), F.pow(1 - odd / n, F.lit(4)))).otherwise(F.lit(0.1))


def sample_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, bins: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, key, bin: no texts, so it is small enough to stage."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), quality_weight(text).alias("w"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("hash"), *keep)
    u = (F.shiftrightunsigned("hash", 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.withColumn("key", -F.log(u) / F.col("w"))
    # 1 - exp(-key) rises with the key, from 0 to 1, almost evenly.
    return rows.select("doc_id", "source", "size", "key", "hash", *keep, F.least(F.lit(bins - 1), F.floor((1 - F.exp(-F.col("key"))) * bins)).cast("int").alias("bin"))


def _cells(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of bins: bytes, rows n, least and largest key."""
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("k0"), F.max("key").alias("k1"))


def _edge(cells: DataFrame) -> DataFrame:
    """Of each source the first cell that brings the sum above the rest of the budget: source, rest, before, n, k0, k1."""
    run = F.col("base") + F.sum("bytes").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    over = cells.withColumn("upto", run).where((F.col("upto") > F.col("rest")) & (F.col("rest") > 0))
    first = F.min(F.struct("cell", "rest", (F.col("upto") - F.col("bytes")).alias("before"), "n", "k0", "k1"))
    return over.groupBy("source").agg(first.alias("e")).select("source", *[f"e.{c}" for c in ("rest", "before", "n", "k0", "k1")])


def sources_plan(keys: DataFrame, weights: tuple[float, ...], share: float, bins: int, edge_rows: int) -> tuple[DataFrame, bool]:
    """Per source: source_size, target, epochs, rest (what is left after them), and the keys (k0 to k1) of the bin in
    which the rest ends with the size before it; and whether the sources are few enough to broadcast."""
    sums = stage(_cells(keys, "source", "bin"), "mix_bins")
    sizes = sums.groupBy("source").agg(F.sum("bytes").alias("size"))
    found = sizes.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in found]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(found))], share * sum(sizes))
    goals = []
    for r, size, target in zip(found, sizes, targets, strict=True):
        epochs = int(target // size) if size else 0
        goals.append((r["source"], size, float(target), epochs, float(target - epochs * size)))
    goal = keys.sparkSession.createDataFrame(goals, "source string, source_size long, target double, epochs int, rest double")
    few = len(goals) <= MOST_BROADCAST
    edge = stage(_edge(by_source(sums, goal, few).withColumnsRenamed({"bin": "cell"}).withColumn("base", F.lit(0).cast("long"))), "mix_edges")
    while True:
        wide = (F.col("n") > edge_rows) & (F.col("k0") < F.col("k1"))
        if not edge.where(wide).head(1):
            break
        # The least and the largest key fall into different cells, so each round takes rows out.
        inside = by_source(keys, edge.where(wide).drop("n"), few).where(F.col("key").between(F.col("k0"), F.col("k1")))
        cell = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.col("k0")) / (F.col("k1") - F.col("k0")) * bins)).cast("int")
        inside = inside.select("source", "size", "key", "rest", F.col("before").alias("base"), cell.alias("cell"))
        edge = stage(edge.where(~wide).unionByName(_edge(_cells(inside, "source", "rest", "base", "cell"))), "mix_edges")
    return by_source(goal, edge.drop("rest", "n"), few), few


def by_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Left join on the source, null included."""
    t = table.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _decided(docs: DataFrame, weights: tuple[float, ...], share: float, id_col: str, text_col: str, source_col: str, seed: int, bins: int, edge_rows: int) -> tuple[DataFrame, DataFrame, bool]:
    keys = stage(sample_keys(docs, id_col, text_col, source_col, seed, bins), "mix_keys")
    plan, few = sources_plan(keys, weights, share, bins, edge_rows)
    plan = stage(plan, "mix_plan")
    rows = by_source(keys, plan, few)
    edge = F.coalesce((F.col("rest") > 0) & F.col("key").between(F.col("k0"), F.col("k1")), F.lit(False))
    own = Window.partitionBy("source").orderBy("key", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("before") + F.sum("size").over(own) - F.col("rest")
    at_edge = rows.where(edge).withColumn("over", over).withColumn("more", ((F.col("over") <= 0) | (2 * F.col("over") < F.col("size"))).cast("int")).drop("over").withColumn("edge", F.lit(True))
    others = rows.where(~edge).withColumns({"more": ((F.col("rest") > 0) & (F.col("k0").isNull() | (F.col("key") < F.col("k0")))).cast("int"), "edge": F.lit(False)})
    return others.unionByName(at_edge), plan, few


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, bins: int = 1024, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """What a mix takes of every document.

    Columns: doc_id, source, size, source_size, target, epochs (whole copies taken), taken.
    Sources by code point, null last, weigh ``weights`` in turn. A null text has size 0. The last
    document of a source is taken whole if that ends nearer its target. Ties of keys go by hash and
    id; repeated rows are documents of their own. One row per source (not per document)
    is gathered on the driver; more than MOST_SOURCES are refused. An empty table gives no rows.
    """
    rows, _, _ = _decided(docs, weights, share, id_col, text_col, source_col, seed, bins, edge_rows)
    rows = rows.withColumn("epochs", F.col("epochs") + F.col("more"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, bins: int = 1024, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns.

    A document's key is computed again and set against its source's last key taken, so texts are not
    shuffled. Rows alike in id, text and source share a key; at the cut all of them go in.
    """
    decided, plan, few = _decided(docs, weights, share, id_col, text_col, source_col, seed, bins, edge_rows)
    cut = decided.where(F.col("edge") & (F.col("more") == 1)).groupBy("source").agg(F.max(F.struct("key", "hash")).alias("cut"))
    plan = stage(by_source(plan, cut, few), "mix_cuts")
    whole = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).alias("__source"))
    rows = by_source(sample_keys(whole, "__id", "__text", "__source", seed, bins, keep=("__row",)), plan, few)
    inside = F.col("k0").isNull() | (F.col("key") < F.col("k0")) | ((F.col("key") <= F.col("k1")) & F.coalesce(F.struct("key", "hash") <= F.col("cut"), F.lit(False)))
    times = F.col("epochs") + ((F.col("rest") > 0) & inside).cast("int")
    return rows.withColumn("__times", times).where(F.col("__times") > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
