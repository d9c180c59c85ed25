"""Quality by nearest neighbours: cosine votes of labelled documents in a latent-semantic space.

Terms of a text are pairs of neighbouring bytes (hashed) and bins of its form (repetition, lines,
word lengths). Latent semantic analysis of a bounded labelled sample gives a projection;
the sample's vectors (a few MB at most) go to every executor, and each document's exact
cosines with all of them come from one matrix product per block of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import fold_of, frugal, labelled_sample

PAIRS, BINS = 2048, 12
FORM = ("distinct_words", "distinct_lines", "word_length", "words", "commonest")
TERMS = PAIRS + BINS * len(FORM)
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 25, 6
#: Weight of form terms against byte pairs, whose vector has length 1.
FORM_WEIGHT = 0.7
THRESHOLD = 0.3
BLOCK = 512


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of term weights: logarithms of pair counts at unit length, then form bins; zero for a text without words."""
    out = np.zeros((len(texts), TERMS), np.float32)
    if not texts:
        return out
    whole = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    code = whole[:-1].astype(np.uint32) << 8 | whole[1:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    at = 0
    for i, t in enumerate(texts):
        n = len(t)
        words = t.split()
        if words:
            pairs = np.log1p(np.bincount(slot[at : at + n - 1], minlength=PAIRS)) if n > 1 else np.zeros(PAIRS)
            out[i, :PAIRS] = pairs / max(1e-9, np.sqrt((pairs * pairs).sum()))
            lines = [x for x in t.split(b"\n") if x.strip()]
            kinds = Counter(words)
            form = (
                # In a long text words recur more, so distinct words are set against a root of all.
                min(1.0, len(kinds) / len(words) ** 0.75 / 1.6), len(set(lines)) / len(lines), min(1.0, sum(map(len, words)) / len(words) / 16), min(1.0, np.log2(len(words)) / 15),
                min(1.0, 4 * max(kinds.values()) / (len(words) + 16)),
            )
            for f, v in enumerate(form):
                x = v * (BINS - 1)
                lo = int(x)
                base = PAIRS + f * BINS
                out[i, base + lo] = (1 - (x - lo)) * FORM_WEIGHT
                if lo + 1 < BINS:
                    out[i, base + lo + 1] = (x - lo) * FORM_WEIGHT
        at += n + 1
    return out


@dataclass(frozen=True)
class Space:
    """A latent space: term weights, projection, labelled unit vectors, their labels, and the share of good labels."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, texts: list[bytes]) -> np.ndarray:
        v = (term_counts(texts) * self.weight) @ self.projection
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Votes of the nearest labelled vectors, weighted by cosine; the prior where there is none."""
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        v = self.place(texts)
        cosine = v @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = w.sum(axis=1)
        votes = (w * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-9, np.clip(votes / np.maximum(total, 1e-9), 0, 1), self.prior)


def learn(texts: list[str | None], labels: list[int]) -> Space:
    """Latent semantic analysis by a seeded randomised decomposition of the sample's term matrix."""
    return learn_terms(term_counts([(t or "").encode("utf-8", "replace") for t in texts]), labels)


def learn_terms(x: np.ndarray, labels: list[int]) -> Space:
    """The same from rows of term weights."""
    y = np.array(labels, np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    df = (x > 0).sum(axis=0)
    weight = (1 + np.log((1 + len(x)) / (1 + df))).astype(np.float32)
    x = x * weight
    k = min(DIMENSIONS, *x.shape) if len(x) else 0
    if not k:
        return Space(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    basis = np.random.default_rng(5).standard_normal((TERMS, k + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ basis)
        basis, _ = np.linalg.qr(x.T @ q)
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ vt.T[:, :k]).astype(np.float32)
    v = x @ projection
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    known = norm[:, 0] > 1e-9
    return Space(weight, projection, (v / np.maximum(norm, 1e-12))[known].astype(np.float32), y[known], prior)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000) -> Space:
    """A space from at most ``max_labelled`` labelled rows outside fold 0 (a documented bound), in order of id.

    Of an id's texts the first by code point counts. The driver gets term weights, at most TERMS numbers a row, no texts.
    """
    sample = labelled_sample(labels, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__raw")).join(F.broadcast(sample), "__id")
    rows = rows.groupBy("__id", "__label").agg(F.min("__raw").alias("__raw"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = term_counts([(t or "").encode("utf-8", "replace") for t in part.column(2).to_pylist()])
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(x, at, strict=True)], pa.binary())],
                    names=["id", "label", "at", "weights"],
                )

    found = sorted(rows.mapInArrow(frugal(weigh), "id long, label int, at binary, weights binary").collect(), key=lambda r: r["id"])
    x = np.zeros((len(found), TERMS), np.float32)
    for row, r in zip(x, found, strict=True):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["weights"], "<f4")
    return learn_terms(x, [r["label"] for r in found])


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text gets the sample's share of good labels. Repeated rows get equal scores. A null id
    is not held out. Only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(frugal(vote), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
