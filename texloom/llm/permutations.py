"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each segment of the index (a bounded number of
vectors) has pivot inverted files: a pivot's file says of every vector of the segment at which rank it names
the pivot, if it does. The files of a query's pivots add up the footrule distance to every vector; a
line fitted on the segment's own vectors turns footrule into cosine, and cosine times length ranks the
vectors, as the answers are those of the largest inner product. The first of them are reranked exactly, and
a last step keeps the best of all segments.

Equal vectors of a segment are indexed once with all their ids. Segments and blocks of the query set
form a grid of cells; a vector goes to the cells of its segment, a query to those of its block, so
each cell is one task and no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from texloom.llm.common import frugal, stage

PIVOTS, LENGTH = 256, 128
#: Vectors of a segment at most, and at least where there are tasks to spare.
SEGMENT, SMALL_SEGMENT = 1 << 16, 4096
#: Distinct vectors of a segment that are reranked: LEAST or this share of them, and those tied with the last.
LEAST, SHARE = 400, 0.1
#: Vectors of a segment on which the line from footrule to cosine is fitted, and vectors that each meets.
FITTED, MET = 16, 512
#: Unit vectors equal to so many decimals are one direction.
DECIMALS = 9
#: So many times the wanted pivots are looked at for different directions.
LOOKED_AT = 8


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id whose vector has components, all finite and not all zero. Floats stay floats: they are exact in double."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if exact else "array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, by cosine, nearest first."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ pivots.T
    k = min(length, pivots.shape[0])
    first = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct direction the first row; of each row the number of its direction."""
    unit = np.round(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), DECIMALS) + 0.0
    whole = unit.view(np.dtype((np.void, unit.itemsize * unit.shape[1]))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number.ravel()


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct vector the first row; of each row the number of its vector."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number.ravel()


class Segment:
    """Vectors with pivot inverted files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> None:
        first, number = distinct(x)
        order = np.lexsort((ids, number))
        self.ids = ids[order]
        self.sizes = np.bincount(number, minlength=len(first))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.least, self.largest = self.ids[self.begins], self.ids[self.begins + self.sizes - 1]
        self.x, self.pivots, self.length = np.ascontiguousarray(x[first], dtype=np.float64), pivots, min(length, len(pivots))
        self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        perm = permutations(self.x, pivots, self.length)
        self.files = np.zeros((len(pivots), len(first)), np.uint16)
        every = np.arange(len(first))
        for r in range(self.length):
            self.files[perm[:, r], every] = self.length - r
        self.line = self._fitted(perm)

    def saved(self, perm: np.ndarray) -> np.ndarray:
        """By how much shared pivots lower the footrule: with missing pivots at rank m, twice the smaller of m - rank and m - rank' each."""
        total = np.zeros(len(self.sizes), np.uint16)
        one = np.empty_like(total)
        for r, p in enumerate(perm.tolist()):
            np.minimum(self.files[p], np.uint16(self.length - r), out=one)
            np.add(total, one, out=total)
        return total

    def _fitted(self, perm: np.ndarray) -> tuple[float, float]:
        """Intercept and slope of cosine on footrule savings, by least squares; (0, 1) where they do not rise together."""
        n = len(self.sizes)
        rows = np.unique(np.linspace(0, n - 1, min(n, FITTED)).astype(int))
        met = np.unique(np.linspace(0, n - 1, min(n, MET)).astype(int))
        unit = self.x / self.norms[:, None]
        saved = np.concatenate([self.saved(perm[r])[met][met != r] for r in rows]).astype(np.float64)
        cosine = np.concatenate([(unit[met] @ unit[r])[met != r] for r in rows])
        spread = saved - saved.mean() if len(saved) else saved
        if not (spread * spread).sum():
            return 0.0, 1.0
        slope = float((spread * cosine).sum() / (spread * spread).sum())
        return (float(cosine.mean() - slope * saved.mean()), slope) if slope > 0 else (0.0, 1.0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the k best reranked candidates of each query, its own rows left out."""
        n = len(self.sizes)
        most = min(n, max(LEAST, int(SHARE * n)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qid, q, perm in zip(query_ids.tolist(), queries, permutations(queries, self.pivots, self.length), strict=True):
            if most < n:
                likely = (self.line[0] + self.line[1] * self.saved(perm)) * self.norms
                held = np.flatnonzero(likely >= np.partition(likely, n - most)[n - most])
            else:
                held = np.arange(n)
            held = held[(self.least[held] != qid) | (self.largest[held] != qid)]
            if not len(held):
                continue
            # Summed in order of components, so that a score is the same on any machine.
            exact = np.zeros(len(held))
            for column, value in zip(np.ascontiguousarray(self.x[held].T), q.tolist(), strict=True):
                exact += column * value
            best, score = held, exact
            if len(held) > k:  # each gives a row at least
                near = np.flatnonzero(exact >= np.partition(exact, len(held) - k)[len(held) - k])
                best, score = held[near], exact[near]
            # Of equal vectors the k smallest ids other than the query's.
            rows, scores = [], []
            for b, v in zip(best.tolist(), score.tolist(), strict=True):
                ids = self.ids[self.begins[b] : self.begins[b] + self.sizes[b]]
                lo, hi = np.searchsorted(ids, qid, "left"), np.searchsorted(ids, qid, "right")
                own = np.concatenate((ids[: min(lo, k)], ids[hi : hi + k]))[:k]
                rows.append(own)
                scores.append(np.full(len(own), v))
            ids, score = np.concatenate(rows), np.concatenate(scores)
            first = np.lexsort((ids, -score))[:k]
            found.append((np.full(len(first), qid), ids[first], score[first]))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return tuple(np.concatenate([f[c] for f in found]) for c in range(3)) if found else empty


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors of different directions, the first by a hash of the id (a bounded, documented sample), at unit length."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(LOOKED_AT * n).collect()
    x = np.array([r["v"] for r in found], np.float64).reshape(len(found), -1)
    if not len(found):
        return x
    first = np.sort(directions(x)[0])[:n]
    x = x[sorted(first.tolist(), key=lambda i: found[i]["id"])]
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grid(n: int, m: int, slots: int) -> tuple[int, int]:
    """Numbers of segments and of query blocks: enough cells for the slots, as few copies of rows as that allows."""
    blocks = max(1, min(-(-m // 256), int((slots * m / n) ** 0.5)))
    return max(-(-n // SEGMENT), min(-(-slots // blocks), -(-n // SMALL_SEGMENT))), blocks


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), id, score (inner product in double).

    Vectors that are null, all zero, or hold null or non-finite components take no part, nor do null ids. All
    vectors must have one length. Ties go to the smaller id; with fewer than k candidates all come back. Rows
    with equal ids are candidates of their own, but a query never finds its own id. Of repeated queries
    one is answered. Other columns are not read, whatever their names. No vectors, no rows.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    asked = stage(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, m = rows.count(), asked.count()
    schema = "query_id long, rank int, id long, score double"
    if not n or not m:
        return spark.createDataFrame([], schema)
    segments, blocks = grid(n, m, max(8, spark.sparkContext.defaultParallelism))
    shared = spark.sparkContext.broadcast(choose_pivots(rows, pivots))
    # Rows are dealt by their place in the staged table, which a repeated task finds unchanged: even, however rows repeat.
    dealt = lambda df, parts: df.withColumn("__own", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    cells = lambda own, other, count, cell: other.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(cell.cast("int").alias("cell"), F.lit(own).alias("role"), "id", "v")
    held = cells(0, dealt(rows, segments), blocks, F.col("__own") * blocks + F.col("__other"))
    wanted = cells(1, dealt(asked, blocks), segments, F.col("__other") * blocks + F.col("__own"))
    met = held.unionByName(wanted).repartitionById(segments * blocks, F.col("cell")).sortWithinPartitions("cell", "role", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment = None, None
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for batch in batches:
            cell, role, number = (batch.column(c).to_numpy() for c in range(3))
            v = batch.column(3)
            x = v.flatten().to_numpy().reshape(len(v), -1)
            # A batch may hold the ends of some cells' vectors and queries.
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(v)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if cell[a] != now:
                    now, segment, ids, held = cell[a], None, [], []
                if role[a] == 0:
                    ids.append(number[a:b].copy())
                    held.append(x[a:b].copy())
                    continue
                if not ids:
                    continue  # a segment that got no rows
                if segment is None:
                    segment = Segment(np.concatenate(ids), np.concatenate(held), shared.value)
                    held = []
                for i in range(a, b, 256):
                    found = segment.search(number[i : min(b, i + 256)], x[i : min(b, i + 256)].astype(np.float64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    found = met.mapInArrow(frugal(search), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
