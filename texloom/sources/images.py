"""Image files in and out: PNG, TGA, BMP, TIFF and DDS in numpy; JPEG pixels by Spark's own image source.

probe() reads sizes from headers; decode() gives values in [0, 1], height x width x channels, gray replicated to three
channels. What a format's rarer variants hold (interlacing, compressed TIFF, block codecs 6 and 7) is refused by name.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.sources import png

#: Rows of whole files in one Arrow batch.
FILES_A_BATCH = 16
#: What a decoder raises on a broken file.
BROKEN = (ValueError, KeyError, IndexError, OSError, OverflowError, struct.error, __import__("zlib").error)


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    mode: str
    bits: int

    @property
    def bands(self) -> int:
        return {"L": 1, "I;16": 1, "F": 1, "P": 1, "LA": 2, "RGB": 3, "RGBA": 4, "CMYK": 4}[self.mode]


def kind_of(data: bytes, path: str = "") -> str:
    """The format by its first bytes; TGA has none and goes by its name."""
    for kind, magic in (("png", png.SIGNATURE), ("jpg", b"\xff\xd8\xff"), ("bmp", b"BM"), ("dds", b"DDS "), ("tif", b"II*\0"), ("tif", b"MM\0*")):
        if data.startswith(magic):
            return kind
    if path.lower().endswith(".tga"):
        return "tga"
    raise ValueError("unknown format")


def probe(data: bytes, path: str = "") -> Header:
    """Size and mode from the header alone."""
    return {"png": _probe_png, "jpg": _probe_jpeg, "bmp": lambda d: _bmp(d)[0], "tga": lambda d: _tga(d)[0], "tif": lambda d: _tiff(d)[0], "dds": _probe_dds}[kind_of(data, path)](data)


def decode(data: bytes, path: str = "") -> np.ndarray:
    """Values in [0, 1] (floats as they are), with three or four channels."""
    kind = kind_of(data, path)
    if kind == "jpg":
        raise ValueError("JPEG pixels are read by Spark's image source")
    a = {"png": png.decode, "bmp": _decode_bmp, "tga": _decode_tga, "tif": _decode_tiff, "dds": _decode_dds}[kind](data)
    if a.shape[2] == 1:
        return np.repeat(a, 3, axis=2)
    return np.concatenate([np.repeat(a[..., :1], 3, axis=2), a[..., 1:]], axis=2) if a.shape[2] == 2 else a


def encode(a: np.ndarray, extension: str, bits: int = 8) -> bytes:
    """A file's bytes: clipped to [0, 1], rounded half to even; 16 bits in PNG only. JPEG is not written."""
    ext = extension.lower().lstrip(".")
    if ext == "png":
        return png.encode(a, bits)
    if bits != 8:
        raise ValueError("only PNG holds 16 bits")
    a = a[..., None] if a.ndim == 2 else a
    cells = np.rint(np.clip(np.nan_to_num(a), 0, 1) * 255).astype(np.uint8)
    h, w, n = cells.shape
    if ext in ("tga", "bmp", "dds") and n == 2:
        raise ValueError("gray with alpha has no place in this format")
    if ext == "tga":
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * n, 0x20 | (8 if n == 4 else 0)) + _bgr(cells).tobytes()
    if ext == "bmp":
        cells = _bgr(np.repeat(cells, 3, axis=2) if n == 1 else cells)[::-1]
        lines = cells.reshape(h, -1)
        lines = np.pad(lines, ((0, 0), (0, -lines.shape[1] % 4)))
        return struct.pack("<2sIHHI", b"BM", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * cells.shape[2], 0, lines.size, 0, 0, 0, 0) + lines.tobytes()
    if ext in ("tif", "tiff"):
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 2 if n >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, cells.size), (339, 3, 1, 1)]
        at = 8 + cells.size + cells.size % 2
        return struct.pack("<2sHI", b"II", 42, at) + cells.tobytes() + b"\0" * (cells.size % 2) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    if ext == "dds":
        rgba = np.concatenate([np.repeat(cells, 3, axis=2) if n == 1 else cells[..., :3], cells[..., 3:] if n == 4 else np.full((h, w, 1), 255, np.uint8)], axis=2)
        head = struct.pack("<4s7I44x2I4s5I5I", b"DDS ", 124, 0x100F, h, w, 4 * w, 0, 1, 32, 0x41, b"\0" * 4, 32, 0xFF0000, 0xFF00, 0xFF, 0xFF000000, 0x1000, 0, 0, 0, 0)
        return head + _bgr(rgba).tobytes()
    raise ValueError(f"no writer for {extension}")


def _bgr(cells: np.ndarray) -> np.ndarray:
    return cells if cells.shape[2] < 3 else np.concatenate([cells[..., 2::-1], cells[..., 3:]], axis=2)


def _probe_png(data: bytes) -> Header:
    w, h, n, depth = png.probe(data)
    mode = "P" if data[25] == 3 else {1: "I;16" if depth == 16 else "L", 2: "LA", 3: "RGB", 4: "RGBA"}[n]
    return Header(w, h, mode, depth)


def _probe_jpeg(data: bytes) -> Header:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark in (1, *range(0xD0, 0xD9)):
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            bits, h, w, n = struct.unpack_from(">BHHB", data, at + 4)
            return Header(w, h, {1: "L", 3: "RGB", 4: "CMYK"}[n], bits)
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("JPEG without a frame")


def _bmp(data: bytes) -> tuple[Header, int, bool, int, int]:
    start, size = struct.unpack_from("<II", data, 10)
    w, h, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("compressed BMP")
    return Header(w, abs(h), {8: "P", 24: "RGB", 32: "RGBA"}[depth], 8), start, h > 0, depth, size


def _decode_bmp(data: bytes) -> np.ndarray:
    head, start, upward, depth, size = _bmp(data)
    step = (head.width * depth // 8 + 3) // 4 * 4
    lines = np.frombuffer(data, np.uint8, step * head.height, start).reshape(head.height, step)[:, : head.width * depth // 8]
    cells = lines.reshape(head.height, head.width, depth // 8)[:: -1 if upward else 1]
    if depth == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return palette[cells[..., 0]][..., 2::-1] / 255.0
    return _bgr(cells) / 255.0


def _tga(data: bytes) -> tuple[Header, int, int, bool]:
    skip, mapped, kind = data[0], data[1], data[2]
    w, h, depth, flags = struct.unpack_from("<HHBB", data, 12)
    if mapped or kind not in (2, 3, 10, 11) or depth not in (8, 24, 32) or not w or not h:
        raise ValueError("TGA with a palette or of unknown depth")
    return Header(w, h, {8: "L", 24: "RGB", 32: "RGBA"}[depth], 8), 18 + skip, kind, bool(flags & 0x20)


def _decode_tga(data: bytes) -> np.ndarray:
    head, at, kind, downward = _tga(data)
    n, total = head.bands, head.width * head.height
    if kind < 8:
        cells = np.frombuffer(data, np.uint8, total * n, at)
    else:
        parts, have = [], 0
        while have < total:
            count = (data[at] & 127) + 1
            if data[at] & 128:
                parts.append(data[at + 1 : at + 1 + n] * count)
                at += 1 + n
            else:
                parts.append(data[at + 1 : at + 1 + n * count])
                at += 1 + n * count
            have += count
        cells = np.frombuffer(b"".join(parts), np.uint8)[: total * n]
    return _bgr(cells.reshape(head.height, head.width, n)[:: 1 if downward else -1]) / 255.0


def _tiff(data: bytes) -> tuple[Header, dict[int, tuple[int, ...]], str]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size = count * struct.calcsize(code)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0])
    n, bits, sample = tags.get(277, (1,))[0], tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if tags.get(259, (1,))[0] != 1 or tags.get(284, (1,))[0] != 1 or (sample, bits) not in ((1, 8), (1, 16), (1, 32), (3, 32)):
        raise ValueError("TIFF that is compressed, planar or of another depth")
    mode = "F" if sample == 3 else {1: "I;16" if bits > 8 else "L", 2: "LA", 3: "RGB", 4: "RGBA"}[n]
    return Header(tags[256][0], tags[257][0], mode, bits), tags, order


def _decode_tiff(data: bytes) -> np.ndarray:
    head, tags, order = _tiff(data)
    n = tags.get(277, (1,))[0]
    body = b"".join(data[a : a + k] for a, k in zip(tags[273], tags[279], strict=True))
    cells = np.frombuffer(body, order + ("f4" if head.mode == "F" else f"u{head.bits // 8}"), head.width * head.height * n).reshape(head.height, head.width, n).astype(np.float64)
    return cells if head.mode == "F" else cells / float((1 << head.bits) - 1)


def _probe_dds(data: bytes) -> Header:
    h, w = struct.unpack_from("<II", data, 12)
    if not w or not h or len(data) < 128:
        raise ValueError("broken DDS")
    alpha = struct.unpack_from("<I", data, 80)[0] & 1 or data[84:88] in (b"DXT3", b"DXT5", b"DX10")
    return Header(w, h, "RGBA" if alpha else "L" if data[84:88] in (b"ATI1", b"BC4U") else "RGB", 8)


def _decode_dds(data: bytes) -> np.ndarray:
    head = _probe_dds(data)
    h, w, code = head.height, head.width, data[84:88]
    if code == b"DX10":
        code = {71: b"DXT1", 72: b"DXT1", 77: b"DXT5", 78: b"DXT5", 80: b"ATI1", 83: b"ATI2"}.get(struct.unpack_from("<I", data, 128)[0], b"")
        at = 148
    else:
        at = 128
    flags, _, bits, *masks = struct.unpack_from("<I4sI4I", data, 80)
    if flags & 4:
        return _blocks(data[at:], code, h, w)
    if not flags & 0x40 or bits not in (24, 32):
        raise ValueError("DDS of an unknown pixel format")
    cells = np.frombuffer(data, np.uint8, h * w * bits // 8, at).reshape(h, w, bits // 8)
    wide = np.zeros((h, w, 4), np.uint8)
    wide[..., : bits // 8] = cells
    number = wide.view("<u4")[..., 0]
    picked = [((number & m) >> ((m & -m).bit_length() - 1)) / (m >> ((m & -m).bit_length() - 1)) for m in (masks if flags & 1 and masks[3] else masks[:3])]
    return np.stack(picked, axis=-1)


def _blocks(data: bytes, code: bytes, h: int, w: int) -> np.ndarray:
    """Block codecs 1, 3, 4 and 5: 4 x 4 pixels by interpolated end points."""
    size = {b"DXT1": 8, b"ATI1": 8, b"BC4U": 8, b"DXT5": 16, b"ATI2": 16, b"BC5U": 16}.get(code)
    if size is None:
        raise ValueError(f"no decoder for {code!r}")
    by, bx = (h + 3) // 4, (w + 3) // 4
    raw = np.frombuffer(data, np.uint8, by * bx * size).reshape(by * bx, size)

    def ramp(part: np.ndarray) -> np.ndarray:
        """One channel: two end points, 16 indexes of three bits."""
        a, b = (part[:, k].astype(np.float64) for k in (0, 1))
        steps = np.stack([a, b, *[((7 - k) * a + k * b) / 7 for k in range(1, 7)]], axis=1)
        low = np.stack([a, b, *[((5 - k) * a + k * b) / 5 for k in range(1, 5)], np.zeros_like(a), np.full_like(a, 255)], axis=1)
        steps = np.where((a > b)[:, None], steps, low)
        number = part[:, 2:8].astype(np.uint64) @ (np.uint64(1) << (np.arange(6, dtype=np.uint64) * np.uint64(8)))
        index = (number[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(3))).astype(np.int64) & 7
        return np.take_along_axis(steps, index, axis=1) / 255

    def colours(part: np.ndarray, punched: bool) -> np.ndarray:
        ends = part[:, :4].copy().view("<u2").astype(np.int64)
        rgb = np.stack([(ends >> 11 & 31) / 31, (ends >> 5 & 63) / 63, (ends & 31) / 31], axis=-1)
        a, b = rgb[:, 0], rgb[:, 1]
        four = (ends[:, 0] > ends[:, 1])[:, None] | (not punched)
        table = np.stack([a, b, np.where(four, (2 * a + b) / 3, (a + b) / 2), np.where(four, (a + 2 * b) / 3, 0)], axis=1)
        index = (part[:, 4:8].copy().view("<u4").astype(np.int64) >> (2 * np.arange(16))) & 3
        return np.take_along_axis(table, index[..., None], axis=1)

    if size == 8:
        cells = colours(raw, True) if code == b"DXT1" else ramp(raw)[..., None]
    elif code == b"DXT5":
        cells = np.concatenate([colours(raw[:, 8:], False), ramp(raw[:, :8])[..., None]], axis=2)
    else:
        x, y = ramp(raw[:, :8]), ramp(raw[:, 8:])
        z = np.sqrt(np.maximum(0, 1 - (2 * x - 1) ** 2 - (2 * y - 1) ** 2)) * 0.5 + 0.5
        cells = np.stack([x, y, z], axis=-1)
    return cells.reshape(by, bx, 4, 4, -1).transpose(0, 2, 1, 3, 4).reshape(by * 4, bx * 4, -1)[:h, :w]


RASTER = "filepath string, height int, width int, channels int, v array<double>, error string"


def decoded(files: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """filepath, height, width, channels, v and error of every file; a file that cannot be read keeps its row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, FILES_A_BATCH):
                rows = []
                for p, data in zip(*(batch.column(c).slice(i, FILES_A_BATCH).to_pylist() for c in (0, 1)), strict=True):
                    try:
                        a = decode(data or b"", p or "")
                        rows.append((p, *a.shape, a.ravel(), None))
                    except BROKEN as e:
                        rows.append((p, None, None, None, None, str(e) or type(e).__name__))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["filepath", "height", "width", "channels", "v", "error"])

    return files.select(F.col(path), F.col(content)).mapInArrow(run, RASTER)


def read_rasters(spark: SparkSession, root: str) -> DataFrame:
    """Pixels of every supported file under a folder; JPEG by the image source in the JVM, the others in numpy."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    others = decoded(files.where(~C.extension(F.col("path")).isin(".jpg", ".jpeg") & C.extension(F.col("path")).isin(".png", ".tga", ".bmp", ".tif", ".tiff", ".dds")).select(F.col("path").alias("filepath"), "content"))
    image = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").option("dropInvalid", "true").load(root)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                cells = _bgr(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n"])) / 255.0
                cells = np.repeat(cells, 3, axis=2) if r["n"] == 1 else cells
                rows.append((r["origin"], *cells.shape, cells.ravel(), None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["filepath", "height", "width", "channels", "v", "error"])

    jpegs = image.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n"), "image.data").mapInArrow(unpack, RASTER)
    return others.unionByName(jpegs)


def encoded(rasters: DataFrame, extension: str, bits: int = 8, keep: tuple[str, ...] = ("filepath",)) -> DataFrame:
    """``keep`` columns and content: the file of each raster (height, width, channels, v)."""

    @F.udf("binary", useArrow=True)
    def pack(h: int, w: int, n: int, v: list) -> bytes:
        return encode(np.asarray(v, np.float64).reshape(h, w, n), extension, bits)

    return rasters.select(*keep, pack("height", "width", "channels", "v").alias("content"))


def write_files(files: DataFrame, root: str) -> None:
    """Write (filepath, content) under a folder that all executors share; each file appears whole or not at all, and a repeated task writes the same."""

    def put(rows: Iterator) -> None:
        for r in rows:
            target = os.path.join(root, r["filepath"])
            os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, target)

    files.select("filepath", "content").foreachPartition(put)


def rgb(v: Column, channels: Column) -> Column:
    """Three channels: gray replicated, alpha dropped."""
    n = (F.size(v) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), n * 3 - 1), lambda i: F.get(v, F.floor(i / 3).cast("int") * channels + F.least(i % 3, channels - 1).cast("int")))


def alpha(v: Column, channels: Column) -> Column:
    """The fourth channel; null without one."""
    return F.when(channels == 4, F.filter(v, lambda x, i: i % 4 == 3))


def with_alpha(colours: Column, opacity: Column) -> Column:
    """Three channels and an alpha channel as four; sizes that do not fit are an error."""
    n = F.size(opacity)
    merged = F.transform(F.sequence(F.lit(0), n * 4 - 1), lambda i: F.when(i % 4 == 3, F.get(opacity, F.floor(i / 4).cast("int"))).otherwise(F.get(colours, F.floor(i / 4).cast("int") * 3 + i % 4)))
    return F.when(F.size(colours) == 3 * n, merged).otherwise(F.raise_error(F.lit("alpha of another size")).cast("array<double>"))
