"""Token ids of whole texts, fast: the tokenizers library runs once for each distinct chunk.

A text is cut only where its tokenizer must start a new token, such as at a space between two
characters that are not white space. The patterns never match across such a place, so the ids of
the chunks in order are those of the whole text. Chunks repeat, so a bounded table of their ids
spares most of the work. For the byte-level tokenizer a whole column of texts is cut at once by the
classes of its bytes, and each chunk is looked up once for all its places in the column.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks in each of a worker's tables, about 200 bytes each (twice that with those set aside).
MOST_CHUNKS = 600_000
#: Latin letters, all composed and all with a one-letter lower case. With punctuation other than the apostrophe
#: after them they are two tokenizer words at most, whatever stands around them.
LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+")
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Texts are cut together in columns of about so many bytes.
COLUMN_BYTES = 1 << 21
#: Classes of bytes: white space, control characters and what may be either; Latin letters; MARKS; other characters that are surely not white space.
UNKNOWN, LETTER, MARK, OTHER = range(4)
CLASSES = np.array([LETTER if chr(b).isalpha() else MARK if chr(b) in MARKS else OTHER if 0x21 <= b < 0x7F else UNKNOWN for b in range(0x80)] + [UNKNOWN] * 0x80, "u1")


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of some UTF-8 belongs to."""
    classes = CLASSES[data]
    at = np.flatnonzero(data >= 0xC2)
    if not len(at):
        return classes
    lead, second, third = (np.concatenate((data, np.zeros(2, "u1")))[at + k] for k in range(3))
    # 0xC3 to 0xC9 begin U+00C0 to U+027F, of which two are signs.
    kind = np.where((lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7))), LETTER, OTHER).astype("u1")
    # White space is among U+0080 to U+00BF, U+1680 to U+16BF, U+2000 to U+202F, U+2040 to U+207F and U+3000 to U+303F.
    kind[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (lead == 0xE1) & (second == 0x9A) | (lead == 0xE2) & ((second == 0x80) & ((third < 0x90) | (third >= 0xA8)) | (second == 0x81)) | (lead == 0xE3) & (second == 0x80)] = UNKNOWN
    for k, least in enumerate((0xC2, 0xC2, 0xE0, 0xF0)):
        long = lead >= least
        classes[at[long] + k] = kind[long]
    return classes


def places_to_cut(data: np.ndarray) -> np.ndarray:
    """For each byte of some UTF-8, whether the byte-level tokenizer must start a new token there.

    At a space or a newline between two characters that are not white space, after such a newline, at a
    mark after a letter (not the reverse after an apostrophe, as in 's), and at a letter after another mark.
    """
    cut, classes = np.zeros(len(data), bool), byte_classes(data)
    solid, letter, mark = classes != UNKNOWN, classes == LETTER, classes == MARK
    between = solid[:-2] & solid[2:]
    newline = between & (data[1:-1] == 0x0A)
    cut[1:-1] = newline | between & (data[1:-1] == 0x20)
    cut[2:] |= newline
    cut[1:] |= letter[:-1] & (mark[1:] | (data[1:] == 0x27)) | mark[:-1] & letter[1:]
    return cut


def runs_of_rows(batch: pa.RecordBatch, column: int = 1, most: int = COLUMN_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have ``most`` bytes or little more, a row at least."""
    sizes = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(sizes.buffers()[1], "<i8")[sizes.offset :][: batch.num_rows + 1] if batch.num_rows else np.zeros(1, "<i8")
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Chunks(dict):
    """Ids of chunks, found when first asked for.

    When more than ``most`` are held, trim() sets them aside; those asked for again come
    back, the rest go at the next trim.
    """

    def __init__(self, find, most: int) -> None:
        self.find, self.most = find, most
        self.aside: dict = {}

    def __missing__(self, chunk: str) -> bytes | None:
        aside = self.aside
        ids = self[chunk] = aside[chunk] if chunk in aside else self.find(chunk)
        return ids

    def trim(self) -> None:
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, ``end_id`` appended. Added tokens that stand in a text get their own ids.

    ``drops_space``: the tokenizer lowers letters and ignores all white space (word_bpe);
    otherwise a chunk keeps the space before it (byte-level). Null counts as empty.
    """

    def __init__(self, path: str, drops_space: bool, end_id: int = 2, most_chunks: int = MOST_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library takes added tokens out of the raw text first; here encode() does, so chunks need not look for them.
        self.added = {t.content: i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokenizer.encode_special_tokens = True
        self.split_words = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.shown = np.array([ord(self.alphabet[b]) for b in range(256)], "<u4")
        self.drops_space = drops_space
        self.end = end_id.to_bytes(4, "little")
        self.words = Chunks(self._word, most_chunks)
        self.first = Chunks(self._chunk, most_chunks)
        # Of byte-level chunks, in dicts that the garbage collector need not walk through.
        self.most, self.table, self.aside = most_chunks, {}, {}

    def whole(self, text: str) -> bytes:
        """Ids by one plain call."""
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the tokenizer's own splitting."""
        shown = word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.split_words(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        letters = chunk.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or LETTERS.fullmatch(letters)):
            ids = self.words[letters.lower()]
            return ids if len(letters) == len(chunk) else ids + self.words[chunk[len(letters) :]]
        return self.whole(chunk)

    def _odd(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        return self.added.get(text) or self.whole(text)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """One bytes object for each text, in order."""
        if not self.drops_space:
            return self._keeping(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        out = []
        for t in texts:
            for known in (self.words, self.first):
                known.trim()
            if t and any(x in t for x in self.added):
                out.append(b"".join([self.added[x] if k % 2 else self._dropping(x) for k, x in enumerate(self.marks.split(t)) if x]) + self.end)
            else:
                out.append(self._dropping(t or "") + self.end)
        return out

    def _dropping(self, text: str) -> bytes:
        return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))

    def _keeping(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return []
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset :][: len(texts) + 1]
        bounds, held = bounds - bounds[0], (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        data = np.frombuffer(held, "u1")
        cut = np.append(places_to_cut(data) if len(data) > 2 else np.zeros(len(data), bool), True)
        self._mark_added(data, bounds, cut)
        cut[bounds] = True
        # Chunks, each named by its number among the distinct ones, and where its bytes begin.
        begins = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), held]).dictionary_encode()
        known = self._known(chunks.dictionary)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, which = np.cumsum(sizes) - sizes, chunks.indices.to_numpy().astype(np.int64)
        size = sizes.take(which)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = np.frombuffer(b"".join(known), "<u4").take(np.repeat(starts.take(which) - ends[:-1], size) + np.arange(ends[-1])).tobytes()
        at = (4 * ends[np.searchsorted(begins, bounds)]).tolist()
        return [ids[a:b] + self.end for a, b in zip(at, at[1:], strict=False)]

    def _known(self, chunks: pa.Array) -> list[bytes]:
        """Ids of distinct chunks, from the table or else found together."""
        if len(self.table) > self.most:
            self.table, self.aside = {}, self.table
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.table.get, names))
        fresh = [k for k, b in enumerate(known) if b is None]
        for k in fresh if self.aside else ():
            known[k] = self.aside.get(names[k])
        lacking = [k for k in fresh if known[k] is None]
        if lacking:
            chunks = chunks.take(pa.array(lacking))
            bounds = np.frombuffer(chunks.buffers()[1], "<i8")[chunks.offset :][: len(lacking) + 1]
            data = np.frombuffer(chunks.buffers()[2], "u1")[: bounds[-1]]
            # One tokenizer word: Latin letters, perhaps after a space.
            fits = byte_classes(data) == LETTER
            fits[bounds[:-1]] |= (data[bounds[:-1]] == 0x20) & (np.diff(bounds) > 1)
            fits = np.logical_and.reduceat(fits, bounds[:-1]).tolist()
            shown, bounds, model = self.shown[data].tobytes().decode("utf-32-le"), bounds.tolist(), self.split_words
            for k, a, b, fit in zip(lacking, bounds, bounds[1:], fits, strict=False):
                known[k] = array("I", [t.id for t in model(shown[a:b])]).tobytes() if fit else self._odd(names[k])
        self.table.update((names[k], known[k]) for k in fresh)
        return known

    def _mark_added(self, data: np.ndarray, bounds: np.ndarray, cut: np.ndarray) -> None:
        """Cut out the added tokens that stand in texts."""
        whole = data.tobytes()
        if not any(x.encode() in whole for x in self.added):
            return
        pattern = re.compile(self.marks.pattern.encode())
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            for m in pattern.finditer(whole[a:b]):
                cut[a + m.start() : a + m.end()] = False
                cut[[a + m.start(), a + m.end()]] = True


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool, end_id: int = 2, most_chunks: int = MOST_CHUNKS) -> ChunkEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path, drops_space, end_id, most_chunks)
