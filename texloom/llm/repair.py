"""Token-id files compressed by Re-Pair grammars, for random access.

A block holds whole documents. Frequent pairs of neighbouring ids are replaced by new symbols
(nonterminals), again and again; the block stores the rules, the length each rule expands to, the
final symbols and the documents' ids and lengths. Sums of expansion lengths say which symbols
cover a document, so one document is decoded without the others.

In Spark: texts are ranged by doc_id, each task encodes and compresses its range block by block, and
blocks go as rows of a Parquet table to shared storage (executors have no common disk to open() on).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import frugal, stage
from texloom.llm.tokens import encoder, runs_of_rows

MAGIC = b"TXRP0001"
#: Nonterminals are numbered from here; ids of terminals are smaller.
BASE = 1 << 16
#: Two symbols make one 64-bit code.
SYMBOL_BITS = 31
TABLE_BITS = 20


def compress(ids: np.ndarray, most_rules: int = 4096, least_count: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (n x 2). Each round replaces up to ``most_rules`` of the most frequent pairs, left to right.

    Ends when no pair occurs ``least_count`` times, after however many rounds. Ties of frequency go to the smaller pair.
    Ids of BASE or more are refused, as they would be taken for rules.
    """
    if len(ids) and int(ids.max()) >= BASE:
        raise ValueError(f"id {int(ids.max())} is not below {BASE}")
    seq, rules, top = ids.astype(np.int64), [], BASE
    # A pair's place in tables by hash.
    spread = lambda c: ((c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).view(np.int64)
    place = np.zeros(1 << TABLE_BITS, np.int32)
    # Where pairs begin that may be frequent, in order, and their codes.
    where = np.arange(len(seq) - 1)
    code = (seq[:-1] << SYMBOL_BITS) | seq[1:]
    # Each round shortens the sequence, so there are fewer rules than ids.
    while len(where):
        ordered = np.sort(code)
        edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(edges, append=len(ordered))
        often = np.flatnonzero(counts >= least_count)
        if not len(often):
            break
        spot, spots = spread(code), spread(ordered[edges[often]])
        often = often[np.argsort(-counts[often], kind="stable")[:most_rules]]
        chosen = ordered[edges[often]]
        # The table holds 0 for no pair that is frequent, the number of a rule, or one more for a pair without a rule.
        # Where two chosen pairs meet in the table, the later is left for another round.
        place[spots] = len(chosen) + 1
        place[spread(chosen)[::-1]] = np.arange(len(chosen), 0, -1, dtype=np.int32)
        rule = place.take(spot).astype(np.int64)
        hit = np.flatnonzero(np.concatenate(([-1], chosen, [-1])).take(rule) == code)
        frequent = rule != 0
        at, rule = where.take(hit), rule.take(hit) - 1
        # Overlapping candidates: every second one of a run.
        start = np.concatenate(([True], np.diff(at) > 1))
        order = np.arange(len(at))
        kept = np.flatnonzero((order - np.maximum.accumulate(order * start)) & 1 == 0)
        at, rule = at.take(kept), rule.take(kept)
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        pairs = chosen[used]
        rules.append(np.stack([pairs >> SYMBOL_BITS, pairs & ((1 << SYMBOL_BITS) - 1)], axis=1))
        seq[at] = top + number[rule]
        top += len(used)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # A pair without a new symbol occurs no more often than before: only those that were frequent can be.
        again = np.zeros(len(seq), bool)
        again[where] = frequent
        again[at] = True
        before = at[at > 0] - 1
        again[before - ~keep[before]] = True
        place[spots] = 0
        keep = np.flatnonzero(keep)
        seq = seq.take(keep)
        where = np.flatnonzero(again.take(keep[:-1]))
        code = (seq.take(where) << SYMBOL_BITS) | seq.take(where + 1)
    return seq.astype("<u4"), (np.concatenate(rules) if rules else np.zeros((0, 2))).astype("<u4")


def _opened(seq: np.ndarray, many: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Symbols with those marked replaced by the two of their rules."""
    size = 1 + many
    to = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    out[to] = np.where(many, 0, seq)
    pair = rules[seq[many] - BASE]
    out[to[many]], out[to[many] + 1] = pair[:, 0], pair[:, 1]
    return out


def _expanded(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    seq = seq.astype(np.int64)
    while (many := seq >= BASE).any():
        seq = _opened(seq, many, rules)
    return seq


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Expansion length of each rule; a rule uses earlier rules only."""
    lengths = np.zeros(len(rules), np.int64)
    open_ = np.arange(len(rules))
    while len(open_):
        part = rules[open_].astype(np.int64)
        size = np.where(part < BASE, 1, lengths[np.maximum(part - BASE, 0)])
        done = (size > 0).all(axis=1)
        lengths[open_[done]] = size[done].sum(axis=1)
        open_ = open_[~done]
    return lengths


def write_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block: header, documents (id, is-null, tokens), rules, expansion lengths, symbols."""
    whole = np.frombuffer(b"".join(ids), "<u4")
    seq, rules = compress(whole)
    head = np.array([len(doc_ids), len(whole), len(rules), len(seq)], "<u8")
    null = np.array([d is None for d in doc_ids], "u1")
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    sizes = np.array([len(b) // 4 for b in ids], "<u4")
    return b"".join([MAGIC, head.tobytes(), numbers.tobytes(), sizes.tobytes(), rules.tobytes(), rule_lengths(rules).astype("<u4").tobytes(), seq.tobytes(), null.tobytes()])


class Block:
    """A block read from its bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, self.n_tokens, n_rules, n_symbols = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 40
        fields = []
        for kind, n in (("<i8", docs), ("<u4", docs), ("<u4", 2 * n_rules), ("<u4", n_rules), ("<u4", n_symbols), ("u1", docs)):
            fields.append(np.frombuffer(data, kind, n, at))
            at += n * int(kind[-1])
        numbers, sizes, rules, self.lengths, self.seq, null = fields
        self.doc_ids = [None if z else int(i) for i, z in zip(numbers, null, strict=True)]
        self.rules = rules.reshape(-1, 2)
        self.starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.ends: np.ndarray | None = None

    def tokens(self) -> np.ndarray:
        """All ids of the block."""
        # One table: terminals stand for themselves, rules among the symbols for their expansions (no more ids than the block's).
        used = np.unique(self.seq[self.seq >= BASE]).astype(np.int64)
        table = np.concatenate((np.arange(BASE), _expanded(used, self.rules))).astype("<u4")
        sizes = np.zeros(BASE + len(self.rules), np.int32)
        sizes[:BASE] = 1
        sizes[used] = self.lengths[used - BASE]
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        size = sizes[self.seq]
        to = (np.cumsum(size) - size).astype(np.int32)
        return table[np.repeat(begin[self.seq] - to, size) + np.arange(self.n_tokens, dtype=np.int32)]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from the symbols that cover it."""
        lo, hi = int(self.starts[k]), int(self.starts[k + 1])
        if self.ends is None:
            self.ends = np.cumsum(self._sizes(self.seq.astype(np.int64)), dtype=np.int64)
        if lo == hi:
            return np.zeros(0, "<u4")
        seq, ends = self.seq.astype(np.int64), self.ends
        # A symbol may expand to far more than the document; parts outside it are not opened.
        while True:
            a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
            before = int(ends[a - 1]) if a else 0
            seq, lo, hi = seq[a : b + 1], lo - before, hi - before
            if not (many := seq >= BASE).any():
                return seq.astype("<u4")
            seq = _opened(seq, many, self.rules)
            ends = np.cumsum(self._sizes(seq), dtype=np.int64)

    def _sizes(self, seq: np.ndarray) -> np.ndarray:
        return np.where(seq < BASE, 1, self.lengths[np.maximum(seq - BASE, 0)] if len(self.lengths) else 1)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and store blocks in ascending order of doc_id; returns the stored table.

    Columns: part, block, start (ids before the block within its part), n_docs, n_tokens, data. Parts are
    ranges of (doc_id, hash of the text), so parts then blocks are in ascending order, null ids
    first. Null texts count as empty and hold the end id alone; repeated rows are all kept. A text
    longer than a block makes a block of its own size.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, False, end_id)
        block, start, size = 0, 0, 0
        numbers: list[int | None] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "start": [start], "n_docs": [len(held)], "n_tokens": [size], "data": [write_block(numbers, held)]}, schema)

        for batch in batches:
            for piece in runs_of_rows(batch):
                ids = enc.encode(piece.column(1))
                for d, b in zip(piece.column(0).to_pylist(), ids, strict=True):
                    numbers.append(d)
                    held.append(b)
                    size += len(b) // 4
                    if size >= block_tokens:
                        yield flush()
                        block, start, size, numbers, held = block + 1, start + size, 0, [], []
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    return stage(rows.mapInArrow(frugal(encode), "part int, block int, start long, n_docs long, n_tokens long, data binary"), "token_blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """Every document of stored blocks: doc_id, start (ids before it, over all), n_tokens, ids_crc32."""
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"]] = at
        at += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["data"])
                ids = memoryview(block.tokens().tobytes())
                starts = block.starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64()), pa.array(starts[:-1] + (before[r["part"]] + r["start"])), pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("part", "start", "data").mapInArrow(frugal(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")
