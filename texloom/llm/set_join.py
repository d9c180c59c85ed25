"""N-gram Jaccard join with set-relation skipping, exact, over shingles of five words.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets form a class (by a fingerprint), which
   stands in the index once however many copies it has.
2. Shingles are ordered, rare ones first: those that many texts hold are counted exactly in the part of
   the hash space that prefixes use, and go last. The order only steers the work; any would give the
   same result. A prefix of n - ceil(0.8 n) + 1 shingles per set is posted to inverted
   lists with size and position.
3. Lists are cut into blocks by size, and blocks whose positions rule out a link are skipped
   (index-level skipping). Lists of the same members are kept once.
4. Before any text is sent for a pair, parity bitmaps of the two sets (2n to 4n bits each) bound
   their intersection from above; pairs that cannot be links go, without a false dismissal.
5. Round one verifies each list's members against one pivot only and keeps the overlaps. A set whose
   pivot's answer is known takes it over: sets found linked are one component, and no pair inside a component is
   verified again (answer-level skipping). The next rounds take, for each component in a list, the few
   pairs with other components whose bitmaps agree most; the last takes all pairs that still
   lie in different components, in bounded chunks. A pair's answer is first derived from its pivot's:
   what both share with the pivot, and what each has beside it, bound their intersection from above and
   below, so a pair that cannot be a link goes and one that must be is taken, both without reading a text.
   Only what bitmaps and bounds leave open is verified.
   A pair that many lists hold is made by the first of them: each set knows its FIRST lists of least
   signature, and where two sets have one of these in common, no later list makes their pair.

Postings travel as packed arrays, so neither the JVM nor Python handles a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import KEPT, frugal, stage
from texloom.llm.components import components

WORDS = 5
#: Part of the hash space whose shingles are counted; more than a prefix's share of it.
COUNTED = 0.3
#: A shingle of more texts than this is frequent; at most MOST_FREQUENT such (8 MB) are broadcast.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Rounds in which each component of a list tries its BEST pairs only, before the round that tries all.
BEST, BEST_ROUNDS = 3, 1
#: Lists of least signature that each set knows, by which a pair of many lists is made once.
FIRST = 8
#: Members of a list that one task compares; pairs of one pivot that one group verifies.
CHUNK, PIVOT_GROUP = 512, 512
FLUSH = 1 << 19
#: Bytes of text for each bucket of postings: what a task holds at once does not grow with the table.
BUCKET_BYTES = 1 << 26

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.drop()

    def drop(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n, 1 << 20)
            inverse = np.uint64(pow(int(_R), -1, 1 << 64))
            for name, base in (("up", _R), ("down", inverse)):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))


_POWERS = Powers()
KEPT.append(_POWERS.drop)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (bytes, any case); empty without words.

    A text of fewer than five words has one shingle, the whole sequence.
    """
    whole = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    blank = _SPACE[whole]
    word = ~blank
    start = np.flatnonzero(word & np.concatenate(([True], blank[:-1])))
    stop = np.flatnonzero(blank & np.concatenate(([False], word[:-1])))
    _POWERS.grow(len(whole))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(whole)])))
    words = _mix((sums[stop] - sums[start]) * _POWERS.down[start] + (stop - start).astype(np.uint64))
    k = [_K ** np.uint64(j) for j in range(WORDS)]
    n = len(words)
    five = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        five += words[j : j + len(five)] * k[j]
    five = _mix(five)
    bounds = np.searchsorted(start, np.concatenate(([0], ends_of)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(five[a : b - WORDS + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            short = np.array([b - a], np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            for j in range(b - a):
                short += words[a + j : a + j + 1] * k[j]
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that do not depend on its order, as signed 64-bit numbers."""
    a, b = _mix(s + np.uint64(0x51ED270B)), _mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def parity(s: np.ndarray) -> bytes:
    """One bit for each hash slot: whether an odd number of members fall in it. A power of two of slots, 2n to 4n."""
    width = 2 << max(6, (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def most_shared(n: int, x: bytes, m: int, y: bytes) -> int:
    """An upper bound of the intersection of sets of n and m members: slots that differ need members that differ."""
    a, b, la, lb = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    if la < lb:
        a, b, la, lb = b, a, lb, la
    while la > lb:  # the wider folds onto the narrower
        la //= 2
        a = (a >> la) ^ (a & ((1 << la) - 1))
    return (n + m - (a ^ b).bit_count()) // 2


def prefix_length(n: np.ndarray | int):
    return n - (4 * n + 4) // 5 + 1


def linked(inter: int, n: int, m: int) -> bool:
    return 100 * inter >= 80 * (n + m - inter)


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches, about ``most`` bytes of text each, with their sets."""
    for batch in batches:
        held, size, first = [], 0, 0
        for i, value in enumerate(batch.column(column)):
            t = (value.as_py() or "").encode("utf-8", "replace")
            held.append(t)
            size += len(t)
            if size >= most:
                yield batch.slice(first, len(held)), shingle_sets(held)
                held, size, first = [], 0, i + 1
        if held:
            yield batch.slice(first, len(held)), shingle_sets(held)


def _by_bucket(keys: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Arrays dealt to buckets by 32-bit key; rows of a bucket in order of key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    # Keys are even over the counted space and over the whole one, so a multiplicative hash deals them.
    place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    by = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[by], np.arange(buckets + 1))
    for b in range(buckets):
        rows = by[cut[b] : cut[b + 1]]
        if len(rows):
            yield b, [keys[rows].tobytes(), *[a[order[rows]].tobytes() for a in arrays]]


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by their first column, the others joined for each value."""
    now: int | None = None
    held: list[list[bytes]] = []
    for batch in batches:
        for r in range(batch.num_rows):
            key = batch.column(0)[r].as_py()
            if key != now:
                if now is not None:
                    yield now, [b"".join(h) for h in held]
                now, held = key, [[] for _ in range(n)]
            for c in range(n):
                held[c].append(batch.column(c + 1)[r].as_py())
    if now is not None:
        yield now, [b"".join(h) for h in held]


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


def describe(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts: rows of documents (doc_id, n, f1, f2) and packed keys to be counted (bucket, keys)."""
    limit = np.uint64(int(COUNTED * 2**64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary())])
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            dealt = list(_by_bucket(np.concatenate(held), buckets))
            k = len(dealt)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.binary()), pa.array([b for b, _ in dealt], pa.int32()), pa.array([x[0] for _, x in dealt], pa.binary())], schema=schema)

        for batch, sets in _texts(batches, 1):
            prints = [fingerprint(s) for s in sets]
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema=schema,
            )
            for s, p in zip(sets, prints, strict=True):
                if p[0] not in seen:  # copies met again in this task count once
                    if len(seen) < 200_000:
                        seen.add(p[0])
                    part = (s[: np.searchsorted(s, limit)] >> np.uint64(32)).astype(np.uint32)
                    held.append(part)
                    size += len(part)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(frugal(read), "doc_id long, n long, f1 long, f2 long, bits binary, bucket int, keys binary")


def frequent_keys(counted: DataFrame, buckets: int) -> np.ndarray:
    """Sorted 32-bit keys of frequent shingles, the most frequent of each bucket first if there are too many."""
    most = max(1, MOST_FREQUENT // buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (raw,) in _grouped(batches, 1):
            keys, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
            often = np.flatnonzero(n > FREQUENT)
            often = often[np.argsort(-n[often], kind="stable")[:most]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[often].tobytes()], pa.binary())], names=["keys"])

    rows = _dealt(counted, buckets).mapInArrow(frugal(count), "keys binary").collect()
    return np.sort(np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows])) if rows else np.zeros(0, np.uint32)


def postings(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packed prefix postings: bucket, keys (u4), handles (i8), sizes (u4), positions (u2, at most 65535)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    limit = np.uint64(int(COUNTED * 2**64))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(h[0]) for h in held]
            keys = np.concatenate([h[0] for h in held])
            handles = np.repeat(np.array([h[1] for h in held], np.int64), lengths)
            sizes = np.repeat(np.array([h[2] for h in held], np.uint32), lengths)
            places = np.concatenate([np.minimum(np.arange(n), 65535) for n in lengths]).astype(np.uint16)
            dealt = list(_by_bucket(keys, buckets, handles, sizes, places))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), *[pa.array([x[c] for _, x in dealt], pa.binary()) for c in range(4)]], names=["bucket", "keys", "handles", "sizes", "places"])

        for _, sets in _texts(batches, 0):
            for s in sets:
                n = len(s)
                if not n:
                    continue
                handle = fingerprint(s)[0]
                if handle in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(handle)
                p = prefix_length(n)
                low = int(np.searchsorted(s, limit))
                top = (s[:low] >> np.uint64(32)).astype(np.uint32)
                if len(often) and low:
                    at = np.minimum(np.searchsorted(often, top), len(often) - 1)
                    hit = often[at] == top
                    rest = (s[low : low + p] >> np.uint64(32)).astype(np.uint32)
                    # Rare counted shingles, then uncounted ones, then frequent ones.
                    order = np.concatenate((top[~hit], rest if low + p < n else (s[low:] >> np.uint64(32)).astype(np.uint32)))
                    if len(order) < p:
                        order = np.concatenate((top[~hit], (s[low:] >> np.uint64(32)).astype(np.uint32), top[hit]))
                    order = order[:p]
                else:
                    order = (s[:p] >> np.uint64(32)).astype(np.uint32)
                held.append((order, handle, n))
                size += p
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(frugal(post), "bucket int, keys binary, handles binary, sizes binary, places binary")


def inverted_lists(posted: DataFrame, buckets: int) -> DataFrame:
    """Distinct lists of two members or more that may hold a link: signature, handles, sizes (packed, by size)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in _grouped(batches, 4):
            key, handle, size, place = (np.frombuffer(x, t) for x, t in zip(raw, ("<u4", "<i8", "<u4", "<u2"), strict=True))
            order = np.lexsort((handle, size, key))
            key, handle, size, place = key[order], handle[order], size[order].astype(np.int64), place[order].astype(np.int64)
            new = np.ones(len(key), bool)  # copies posted by several tasks
            new[1:] = (key[1:] != key[:-1]) | (handle[1:] != handle[:-1])
            key, handle, size, place = key[new], handle[new], size[new], place[new]
            # A list ends with its key, and inside a key where the next size is out of reach.
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (5 * size[:-1] < 4 * size[1:])
            start = np.flatnonzero(first)
            length = np.diff(np.append(start, len(key)))
            # Block skipping: from these positions on, no two members can share enough.
            left = np.maximum.reduceat(np.where(place < 65535, size - place, size), start) if len(start) else length
            least = size[start] if len(start) else length
            keep = (length >= 2) & (9 * left >= 8 * least)
            two = np.flatnonzero(keep & (length == 2))
            a, b = start[two], start[two] + 1
            rest = np.minimum(size[a] - place[a], size[b] - place[b])
            keep[two] = (9 * rest >= 4 * (size[a] + size[b])) | (place[a] == 65535) | (place[b] == 65535)
            mixed = _mix(handle.astype(np.uint64))
            sums = np.add.reduceat(mixed, start) if len(start) else mixed
            chosen = np.flatnonzero(keep)
            _, once = np.unique(sums[chosen], return_index=True)
            chosen = chosen[once]
            for i in range(0, len(chosen), 4096):
                part = chosen[i : i + 4096].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sums[part].astype(np.int64)), pa.array(length[part]),
                        pa.array([handle[start[c] : start[c] + length[c]].tobytes() for c in part], pa.binary()),
                        pa.array([size[start[c] : start[c] + length[c]].astype("<u4").tobytes() for c in part], pa.binary()),
                    ],
                    names=["sig", "n", "handles", "sizes"],
                )

    rows = _dealt(posted, buckets).mapInArrow(frugal(merge), "sig long, n long, handles binary, sizes binary")
    return rows.groupBy("sig", "n").agg(F.first("handles").alias("handles"), F.first("sizes").alias("sizes"))


def pivots_of(handles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each member of a list (in order of size) the place of its pivot: the least handle of a run of sizes within reach."""
    place, lo = np.empty(len(handles), np.int64), 0
    while lo < len(handles):
        hi = int(np.searchsorted(4 * sizes, 5 * sizes[lo], "right"))
        place[lo:hi] = lo + int(np.argmin(handles[lo:hi]))
        lo = hi
    return place


def star_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of a pivot and the members within its reach of size; a is the pivot."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for h, s in zip(batch.column(0), batch.column(1), strict=True):
                handles, sizes = np.frombuffer(h.as_py(), "<i8"), np.frombuffer(s.as_py(), "<u4").astype(np.int64)
                seen.update((a, b) for a, b in zip(handles[pivots_of(handles, sizes)].tolist(), handles.tolist(), strict=True) if a != b)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in seen], pa.int64()), pa.array([p[1] for p in seen], pa.int64())], names=["a", "b"])

    return lists.select("handles", "sizes").mapInArrow(frugal(stars), "a long, b long").distinct()


def list_members(lists: DataFrame) -> DataFrame:
    """sig, h, n, pivot, pivot_n: a row for each member of a list."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            handles = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(1)]
            sizes = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(2)]
            if handles:
                at = [pivots_of(h, n) for h, n in zip(handles, sizes, strict=True)]
                columns = [
                    np.repeat(batch.column(0).to_numpy(), [len(h) for h in handles]), np.concatenate(handles), np.concatenate(sizes),
                    np.concatenate([h[i] for h, i in zip(handles, at, strict=True)]), np.concatenate([n[i] for n, i in zip(sizes, at, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "h", "n", "pivot", "pivot_n"])

    return lists.select("sig", "handles", "sizes").mapInArrow(frugal(members), "sig long, h long, n long, pivot long, pivot_n long")


def with_first_lists(heads: DataFrame, members: DataFrame) -> DataFrame:
    """h, bits, first: of each set in a list, its bitmap and the least signatures of its lists, in order."""
    first = members.groupBy("h").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FIRST).alias("first"))
    return first.join(heads.select(F.col("f1").alias("h"), "bits"), "h").select("h", "bits", "first")


def earlier_lists(sig: int, first: list[np.ndarray]) -> np.ndarray:
    """One bit for each list before ``sig`` that two rows or more know, as words of 64: rows that share one meet there too."""
    row, known = np.repeat(np.arange(len(first)), [len(f) for f in first]), np.concatenate(first)
    row, known = row[known < sig], known[known < sig]
    _, place, n = np.unique(known, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    row, number = row[n[place] > 1], number[place[n[place] > 1]]
    out = np.zeros((len(first), 1 + (int(number.max()) >> 6 if len(number) else 0)), np.uint64)
    np.bitwise_or.at(out, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    return out


def derived_bounds(n: int | np.ndarray, m: np.ndarray, with_n: int | np.ndarray, with_m: np.ndarray, pivot_n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that sets of n and m members can share, from what each shares with a pivot of ``pivot_n`` members."""
    most = np.minimum(with_m + (n - with_n), with_n + (m - with_m))
    return with_n + with_m - pivot_n, most


def cross_pairs(h: np.ndarray, n: np.ndarray, root: np.ndarray, bits: list[bytes], pivot: np.ndarray, pivot_n: np.ndarray, shared_with: np.ndarray, apart: np.ndarray | None, best: int | None, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (sorted by n) of different roots, sizes within reach, that bitmaps and the pivot's answer allow, and
    whether the latter makes them links; with ``best``, of the open ones the best few of each root only.
    ``shared_with``: what a row shares with its pivot, -1 if unknown. ``apart``: rows with equal numbers are compared elsewhere. ``earlier``: bits of
    earlier lists; a pair that shares one is made there (the best are chosen before, so that each list names the same)."""
    words = np.array([len(b) // 8 for b in bits])
    rows: dict[int, np.ndarray] = {}
    at: dict[int, np.ndarray] = {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero((words >= w) & (words <= 4 * w))
        m = np.zeros((len(own), w), np.uint64)
        for r, k in enumerate(own.tolist()):
            x = np.frombuffer(bits[k], "<u8")
            while len(x) > w:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            m[r] = x
        rows[w], at[w] = m, np.full(len(h), -1)
        at[w][own] = np.arange(len(own))
    reach = np.searchsorted(4 * n, 5 * n, "right")
    left, right, score, sure = [], [], [], []
    for k in range(len(h)):
        to = np.arange(k + 1, reach[k])
        keep = root[to] != root[k]
        if apart is not None:
            keep &= apart[to] != apart[k]
        if earlier is not None and best is None:
            keep &= ~(earlier[to] & earlier[k]).any(axis=1)
        to = to[keep]
        if not len(to):
            continue
        w = int(words[k])
        m, place = rows[w], at[w]
        differ = np.bitwise_count(m[place[to]] ^ m[place[k]]).sum(axis=1).astype(np.int64)
        shared = (n[to] + n[k] - differ) // 2
        least = np.full(len(to), -1)
        if shared_with[k] >= 0:
            known = (pivot[to] == pivot[k]) & (shared_with[to] >= 0)
            low, most = derived_bounds(n[k], n[to], shared_with[k], shared_with[to], pivot_n[k])
            shared, least = np.where(known, np.minimum(shared, most), shared), np.where(known, low, -1)
        could = 9 * shared >= 4 * (n[to] + n[k])
        to = to[could]
        if len(to):
            left.append(np.full(len(to), k))
            right.append(to)
            score.append(shared[could] / (n[to] + n[k]))
            sure.append(9 * least[could] >= 4 * (n[to] + n[k]))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, s, certain = np.concatenate(left), np.concatenate(right), np.concatenate(score), np.concatenate(sure)
    if best is not None:
        pair = np.tile(np.arange(len(a)), 2)
        of = np.concatenate((root[a], root[b]))
        order = np.lexsort((h[b][pair], h[a][pair], -s[pair], of))
        of, pair = of[order], pair[order]
        first = np.concatenate(([True], of[1:] != of[:-1]))
        rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        chosen = np.union1d(pair[rank < best], np.flatnonzero(certain))
        if earlier is not None:
            chosen = chosen[~(earlier[a[chosen]] & earlier[b[chosen]]).any(axis=1)]
        a, b, certain = a[chosen], b[chosen], certain[chosen]
    return h[a], h[b], certain


def open_pairs(members: DataFrame, roots: DataFrame, shown: DataFrame, overlaps: DataFrame, best: int | None) -> DataFrame:
    """Pairs (a < b) of a list's members in different components that may be links, and whether they are sure to be."""
    rows = members.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = rows.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("k")).where(F.col("r0") != F.col("r1"))
    rows = rows.join(mixed.select("sig", F.ceil(F.col("k") / CHUNK).cast("int").alias("c")), "sig")
    rows = rows.join(overlaps.select(F.col("a").alias("pivot"), F.col("b").alias("h"), "shared"), ["pivot", "h"], "left")
    rows = rows.withColumn("with", F.when(F.col("pivot") == F.col("h"), F.col("n")).otherwise(F.coalesce("shared", F.lit(-1))).cast("long"))
    rows = rows.join(shown, "h")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h", "n", "root", "bits", "pivot", "pivot_n", "with", "first")

    def cross(table: pa.Table) -> pa.Table:
        h, n, root, own, pivot, pivot_n, shared = (table.column(c).to_numpy() for c in ("h", "n", "root", "own", "pivot", "pivot_n", "with"))
        o = np.lexsort((h, n))
        bits = table.column("bits").to_pylist()
        first = table.column("first").combine_chunks()
        known, cut = first.flatten().to_numpy(), np.cumsum(first.value_lengths().to_numpy())
        earlier = earlier_lists(table.column("sig")[0].as_py(), np.split(known, cut[:-1]))
        split = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        x, y, sure = cross_pairs(h[o], n[o], root[o], [bits[k] for k in o.tolist()], pivot[o], pivot_n[o], shared[o], own[o] if split else None, best, earlier[o])
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": sure})

    return rows.groupBy("sig", "i", "j").applyInArrow(cross, "a long, b long, sure boolean").groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))


def possible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs whose bitmaps do not rule out a link."""
    for side in "ab":
        pairs = pairs.join(heads.select(F.col("f1").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(c).to_pylist() for c in range(2, 6))
            keep = [linked(most_shared(*p), p[0], p[2]) for p in zip(n, x, m, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(frugal(bound), "a long, b long")


def overlaps_of(pairs: DataFrame, docs: DataFrame, orphans: DataFrame | None, heads: DataFrame, most_broadcast: int = 400_000) -> DataFrame:
    """a, b, shared and link of pairs whose sizes are within reach, by exact intersection of their whole texts' sets.

    Pairs of one pivot are dealt to groups of bounded size; a group streams the pivot first, then
    its members. ``orphans``: texts (set, text) of classes that have no id to be found by.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_GROUP).alias("groups"))
    salted = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("salt"), "b")
    roles = salted.select("a", "salt", F.lit(1).alias("role"), "b").unionByName(salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b")).distinct())
    wanted = stage(roles.join(heads.select(F.col("f1").alias("b"), F.col("head").alias("doc_id")), "b"), "wanted")
    # Few rows (40 bytes each) go to the texts; many are joined by a shuffle. Either way a text is then sent once for each.
    small = wanted.count() <= most_broadcast
    found = wanted.where(F.col("doc_id").isNotNull())
    rows = docs.join(F.broadcast(found) if small else found, "doc_id").select("a", "salt", "role", "b", "text")
    if orphans is not None:
        lost = wanted.where(F.col("doc_id").isNull()).drop("doc_id")
        rows = rows.unionByName(orphans.join(F.broadcast(lost) if small else lost, F.col("set") == F.col("b")).select("a", "salt", "role", "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, np.zeros(0, np.uint64)
        for batch, sets in _texts(batches, 4):
            a, role, b = (batch.column(c).to_pylist() for c in (0, 2, 3))
            found = []
            for x, r, y, s in zip(a, role, b, sets, strict=True):
                if not len(s) or fingerprint(s)[0] != y:
                    continue  # another text under the same id
                if r == 0:
                    pivot, held = x, s
                elif x == pivot and 5 * min(len(s), len(held)) >= 4 * max(len(s), len(held)):
                    shared = len(np.intersect1d(s, held, assume_unique=True))
                    found.append((x, y, shared, linked(shared, len(s), len(held))))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "shared", "link"])

    return rows.mapInArrow(frugal(compare), "a long, b long, shared long, link boolean")


def set_of(text: Column) -> Column:
    """The handle of a text's set."""

    @F.pandas_udf("long")
    def handle(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_sets([(t or "").encode("utf-8", "replace")])[0])[0] for t in texts], dtype="int64")

    return handle(text.cast("string"))


def join_sets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``with_sets`` adds set, the handle of the row's set.

    Texts without words are linked with nothing and are their own component. A null text is empty.
    Repeated rows share a set. Rows without an id link like others; a component is null only if none of its rows
    has an id. Only id and text are read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    described = stage(describe(docs, buckets), "described")
    rows = described.where(F.col("keys").isNull()).select("doc_id", "n", "f1", "bits")
    frequent = frequent_keys(described.where(F.col("keys").isNotNull()).select("bucket", "keys"), buckets)
    lists = stage(inverted_lists(postings(docs, buckets, frequent), buckets), "lists")
    # A class's head: the document whose text stands for it.
    heads = stage(rows.where(F.col("n") > 0).groupBy("f1").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("bits").alias("bits")), "heads")
    orphans = None
    if heads.where(F.col("head").isNull()).head(1):
        lone = docs.where(F.col("doc_id").isNull()).select(set_of(F.col("text")).alias("set"), "text")
        orphans = stage(lone.join(heads.where(F.col("head").isNull()).select(F.col("f1").alias("set")), "set", "left_semi").dropDuplicates(["set"]), "orphans")
    tried = stage(star_pairs(lists), "star_pairs")
    overlaps = stage(overlaps_of(stage(possible(tried, heads), "star_possible"), docs, orphans, heads), "star_overlaps")
    links = overlaps.where("link").select("a", "b")
    roots = components(links)
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = stage(list_members(lists), "list_members")
    shown = stage(with_first_lists(heads, members), "shown")
    for best in (*[BEST] * BEST_ROUNDS, None):
        rest = stage(open_pairs(members, roots, shown, overlaps, best).join(known, ["a", "b"], "left_anti"), "open_pairs")
        if not rest.head(1):
            continue
        known = known.unionByName(rest.select("a", "b"))
        more = overlaps_of(rest.where(~F.col("sure")).select("a", "b"), docs, orphans, heads).where("link").select("a", "b")
        more = stage(more.unionByName(rest.where("sure").select("a", "b")), "open_links")
        if more.head(1):
            links = links.unionByName(more)
            roots = components(links)
    found = _labelled(rows, heads, roots)
    return found if with_sets else found.drop("set")


def _labelled(rows: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = heads.join(roots.select(F.col("node").alias("f1"), "root"), "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    rooted = stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("head").alias("component"))
    by_class = rooted.join(least, "root").select("f1", "component")
    out = rows.where(F.col("n") > 0).join(by_class, "f1", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("f1").alias("set"))
    alone: Column = F.col("doc_id")
    return out.unionByName(rows.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.col("f1").alias("set")))
