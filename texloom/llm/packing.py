"""Packing by balanced cost: linear plus quadratic attention cost, descending documents to the cheapest sequence.

Each task packs its own documents in blocks of bounded size, so nothing is shuffled. A block of T
tokens gets T div 4096 full sequences. Whole chunks of long documents fill sequences of their own;
the other pieces, longest first, each go to the sequence of lowest cost that still has room. Pieces
that fit nowhere whole are cut into what room is left, and the T mod 4096 tokens
that remain fill sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import frugal
from texloom.llm.tokens import MOST_CHUNKS, encoder

CAPACITY = 4096
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n^2 (a feed-forward width against attention).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

Piece = tuple[int, int, int, int, int]


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[Piece]:
    """Pieces (document, start, length, sequence, offset) that hold every token once."""
    total = sum(sizes)
    n = total // capacity
    pieces: list[Piece] = []
    whole = 0
    rest: list[tuple[int, int, int]] = []  # document, start, length
    for d, size in enumerate(sizes):
        k = size // capacity
        for i in range(k):
            pieces.append((d, i * capacity, capacity, whole, 0))
            whole += 1
        if size % capacity:
            rest.append((d, k * capacity, size % capacity))
    rest.sort(key=lambda p: (-p[2], p[0]))
    open_ = n - whole
    cost, used = np.zeros(open_), np.zeros(open_, np.int64)

    def put(d: int, start: int, length: int, s: int) -> None:
        pieces.append((d, start, length, whole + s, int(used[s])))
        used[s] += length
        cost[s] += LINEAR * length + QUADRATIC * length * length

    left: list[tuple[int, int, int]] = []
    for d, start, length in rest:
        if open_:
            s = int(np.where(used + length <= capacity, cost, np.inf).argmin())
            if used[s] + length <= capacity:
                put(d, start, length, s)
                continue
        left.append((d, start, length))
    tail: list[tuple[int, int, int]] = []
    for d, start, length in left:
        while length and open_:
            s = int(np.where(used < capacity, cost, np.inf).argmin())
            room = capacity - int(used[s])
            if not room:
                break
            take = min(room, length)
            put(d, start, take, s)
            start, length = start + take, length - take
        if length:
            tail.append((d, start, length))
    # What remains fills sequences of a power of two each, largest first.
    remain, sequence = sum(x[2] for x in tail), n
    room = offset = 0
    for d, start, length in tail:
        while length:
            if not room:
                room, offset = 1 << (remain.bit_length() - 1), 0
                remain -= room
                sequence += 1
            take = min(room, length)
            pieces.append((d, start, take, sequence - 1, offset))
            start, length, room, offset = start + take, length - take, room - take, offset + take
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 21, with_ids: bool = False, most_chunks: int = MOST_CHUNKS, keep_encoder: bool = True) -> DataFrame:
    """Pieces of packed sequences.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if asked for. A null text is the end id alone; null ids stay null; repeated rows are
    packed as documents of their own. A sequence id holds its task, block and number. An
    empty table gives no pieces. ``keep_encoder``: a worker keeps its tokenizer and table of chunks for its next task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    kinds += [("ids", pa.binary())] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, first = encoder(tokenizer, True, end_id, most_chunks), TaskContext.get().partitionId() << 40
        numbers: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            sizes = [len(b) // 4 for b in held]
            pieces = pack_block(sizes)
            cuts = [held[d][4 * a : 4 * (a + n)] for d, a, n, _, _ in pieces]
            columns = [
                [numbers[p[0]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(c) for c in cuts],
                [sizes[p[0]] for p in pieces], [first + p[3] for p in pieces], [p[4] for p in pieces],
            ]
            columns += [cuts] * with_ids
            first += 1 + max(p[3] for p in pieces)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids = enc.encode(part.column(1).to_pylist())
                for d, b in zip(part.column(0).to_pylist(), ids, strict=True):
                    numbers.append(d)
                    held.append(b)
                    size += len(b) // 4
                    if size >= block_tokens:
                        yield flush()
                        numbers, held, size = [], [], 0
        if held:
            yield flush()
        if not keep_encoder:
            del enc
            encoder.cache_clear()

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(frugal(pack), out)
