"""DDS and KTX2 containers: headers read, checked and mended with binary column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.functions import tables as T
from texloom.functions.rasters import let

DDS, KTX2 = b"DDS ", b"\xabKTX 20\xbb\r\n\x1a\n"
MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "bmp": b"BM", "dds": DDS, "ktx2": KTX2}


def little(raw: Column, offset: int, size: int = 4) -> Column:
    """An unsigned little-endian number; 0 beyond the end. Bytes are joined one by one, as reverse() works on text."""
    parts = [F.substring(raw, offset + k + 1, 1) for k in reversed(range(size))]
    value = F.conv(F.hex(F.concat(*parts)), 16, 10).cast("decimal(20,0)" if size == 8 else "long")
    return F.when(F.length(raw) >= offset + size, value).otherwise(F.lit(0).cast("decimal(20,0)" if size == 8 else "long"))


def little_at(raw: Column, offset: Column, size: int) -> Column:
    """The same at an offset that is a column; the caller knows that it lies within."""
    parts = [F.substr(raw, offset + k + 1, F.lit(1)) for k in reversed(range(size))]
    return F.conv(F.hex(F.concat(*parts)), 16, 10).cast("decimal(20,0)")


def bytes_of(value: Column, size: int = 4) -> Column:
    """A number as little-endian bytes."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]))


def put(raw: Column, values: dict[int, Column]) -> Column:
    """The bytes with 32-bit numbers written at offsets, as one concatenation of slices."""
    parts, at = [], 0
    for offset in sorted(values):
        parts += [F.substring(raw, at + 1, offset - at), bytes_of(values[offset])]
        at = offset + 4
    return F.concat(*parts, F.substring(raw, at + 1, 1 << 30))


def has_magic(raw: Column, kind: str) -> Column:
    m = MAGIC[kind]
    return F.substring(raw, 1, len(m)) == F.lit(m)


def dds_header(raw: Column) -> Column:
    """struct(height, width, mips, fourcc, dxgi, codec); null for other files."""
    fourcc = F.substring(raw, 85, 4).cast("string")
    dxgi = F.when(fourcc == "DX10", little(raw, 128)).otherwise(F.lit(0).cast("long"))
    codec = F.when(fourcc == "DX10", F.when(F.length(raw) >= 148, C.lookup(dxgi, T.DXGI_CODECS))).otherwise(C.lookup(fourcc, T.FOURCC_CODECS))
    fields = {"height": little(raw, 12), "width": little(raw, 16), "mips": little(raw, 28), "fourcc": fourcc, "dxgi": dxgi, "codec": codec}
    return F.when(has_magic(raw, "dds"), F.struct(*[v.alias(k) for k, v in fields.items()]))


def _found(tests: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())


def dds_issues(raw: Column, require_mips: bool = False, expected_codec: Column | None = None) -> Column:
    """Names of failed checks, in order; empty for a sound file. An empty, foreign or truncated file has no further ones.

    With ``expected_codec``, another codec or none is an issue too.
    """
    return let(raw, lambda r: _dds_issues(r, require_mips, expected_codec))


def _dds_issues(raw: Column, require_mips: bool, expected_codec: Column | None) -> Column:
    flags, caps, mips = little(raw, 8), little(raw, 108), little(raw, 28)
    side = F.greatest(little(raw, 12), little(raw, 16))
    has = lambda number, bits: number.bitwiseAND(F.lit(bits)) == bits
    tests = [
        ("dds_header", little(raw, 4) != 124),
        ("dds_pixel_format", little(raw, 76) != 32),
        ("dds_flags", ~has(flags, 0x1007)),
        ("dds_caps_texture", ~has(caps, 0x1000)),
        ("dds_dimensions", (little(raw, 12) == 0) | (little(raw, 16) == 0)),
        ("dds_mip_count", has(flags, 0x20000) & (mips == 0)),
        ("dds_mip_count", (mips > 0) & (side > 0) & (mips > C.floor_log2(F.greatest(side, F.lit(1))) + 1)),
        ("dds_mipchain", F.lit(require_mips) & (side > 1) & (mips <= 1)),
        ("dds_caps_mipmap", has(caps, 0x400000) & (mips <= 1)),
        ("dds_dx10_header", (F.substring(raw, 85, 4).cast("string") == "DX10") & (F.length(raw) < 148)),
    ]
    if expected_codec is not None:
        tests.append(("dds_codec", F.coalesce(dds_header(raw)["codec"], F.lit("")) != expected_codec))
    return _stopping(raw, "dds", 128, "dds_header", _found(tests))


def _stopping(raw: Column, kind: str, least: int, truncated: str, rest: Column) -> Column:
    return (
        F.when(F.length(raw) == 0, F.array(F.lit("non_zero_size")))
        .when(~has_magic(raw, kind), F.array(F.lit("magic_bytes")))
        .when(F.length(raw) < least, F.array(F.lit(truncated)))
        .otherwise(rest)
    )


def srgb_mismatch(raw: Column, kind: Column) -> Column:
    """Whether a DX10 file's format is sRGB though its texture type is linear, or the other way round; null for other files."""
    code = dds_header(raw)["dxgi"]
    return F.when(code > 0, code.isin(*T.DXGI_SRGB.values()) != kind.isin(*T.SRGB_TYPES))


def ktx2_levels(raw: Column) -> Column:
    """The level index: array of struct(level, offset, length, raw_length); null if it does not lie within the file."""
    return let(raw, _levels)


def _levels(raw: Column) -> Column:
    count = little(raw, 40)
    at = lambda k, place: little_at(raw, F.lit(80) + 24 * k + place, 8)
    whole = (count > 0) & (F.length(raw) >= 80 + 24 * count)
    numbers = F.sequence(F.lit(0), F.when(whole, count - 1).otherwise(0).cast("int"))
    return F.when(whole & has_magic(raw, "ktx2"), F.transform(numbers, lambda k: F.struct(k.alias("level"), at(k, 0).alias("offset"), at(k, 8).alias("length"), at(k, 16).alias("raw_length"))))


def ktx2_issues(raw: Column, require_mips: bool = False) -> Column:
    """Names of failed checks, in order; one for each bad level. What needs a sound header is left out without one."""
    return let(raw, lambda r: _ktx2_issues(r, require_mips))


def _ktx2_issues(raw: Column, require_mips: bool) -> Column:
    width, height, faces, levels = (little(raw, k) for k in (20, 24, 36, 40))
    head = [("ktx2_dimensions", width == 0), ("ktx2_dimensions", height == 0), ("ktx2_face_count", ~faces.isin(1, 6)), ("ktx2_level_count", levels == 0)]
    chain = [("ktx2_mipchain", F.lit(require_mips) & (F.greatest(width, height) > 1) & (levels == 1)), ("ktx2_level_index", F.length(raw) < 80 + 24 * levels)]
    bad = F.filter(F.coalesce(ktx2_levels(raw), F.array()), lambda m: (m["length"] == 0) | (m["offset"] + m["length"] > F.length(raw)))
    rest = F.when(levels == 0, _found(head)).otherwise(F.concat(_found(head), _found(chain), F.transform(bad, lambda m: F.lit("ktx2_level_index"))))
    return _stopping(raw, "ktx2", 80, "ktx2_header", rest)


def mended_dds(raw: Column) -> Column:
    """The header with its fixed sizes, at least one mip, required flags, linear size and caps; other files as they are."""
    read = F.struct(raw.alias("raw"), dds_header(raw).alias("h"), little(raw, 8).alias("flags"), little(raw, 108).alias("caps"), little(raw, 20).alias("size"))
    return let(read, _mended)


def _mended(s: Column) -> Column:
    header = s["h"]
    mips = F.greatest(header["mips"], F.lit(1).cast("long"))
    block = C.lookup(header["codec"], T.BLOCK_BYTES)
    known = block.isNotNull() & (header["width"] > 0) & (header["height"] > 0)
    flags = s["flags"].bitwiseOR(F.lit(0x1007)).bitwiseOR(F.when(mips > 1, 0x20000).otherwise(0).cast("long"))
    flags = F.when(known, flags.bitwiseOR(F.lit(0x80000)).bitwiseAND(F.lit(0xFFFFFFF7))).otherwise(flags)
    caps = s["caps"].bitwiseOR(F.lit(0x1000)).bitwiseOR(F.when(mips > 1, 0x400008).otherwise(0).cast("long"))
    size = F.when(known, C.linear_size(header["width"], header["height"], block)).otherwise(s["size"])
    out = put(s["raw"], {4: F.lit(124), 8: flags, 20: size, 28: mips, 76: F.lit(32), 108: caps})
    return F.when(header.isNotNull() & (F.length(s["raw"]) >= 128), out).otherwise(s["raw"])


def srgb_dds(raw: Column) -> Column:
    """DXGI codes of linear formats made sRGB."""
    new = C.lookup(little(raw, 128), T.DXGI_SRGB)
    return F.when(has_magic(raw, "dds") & (F.substring(raw, 85, 4).cast("string") == "DX10") & new.isNotNull(), put(raw, {128: new})).otherwise(raw)


def mip_chain(levels: Column) -> Column:
    """One file of an array of struct(level, raw), each a single-level file: the first header with the count, then all data."""
    return let(F.array_sort(levels), _chained)


def _chained(ordered: Column) -> Column:
    first = F.get(ordered, F.lit(0))["raw"]
    head = F.when(F.substring(first, 85, 4).cast("string") == "DX10", 148).otherwise(128)
    data = F.aggregate(ordered, F.lit(b""), lambda acc, m: F.concat(acc, F.substr(m["raw"], head + 1)))
    body = F.concat(F.substr(first, F.lit(1), head), data)
    return let(put(body, {28: F.size(ordered)}), mended_dds)


def ktx2_header(raw: Column) -> Column:
    """struct(width, height, faces, levels, complete): complete if the level index fits in the file."""
    levels = F.greatest(little(raw, 40), F.lit(1).cast("long"))
    fields = {"width": little(raw, 20), "height": little(raw, 24), "faces": little(raw, 36), "levels": little(raw, 40), "complete": F.length(raw) >= 80 + 24 * levels}
    return F.when(has_magic(raw, "ktx2"), F.struct(*[v.alias(k) for k, v in fields.items()]))
