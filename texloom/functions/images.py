"""Rules for reading pixels: bit depths, scales and channels by mode and metadata, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texloom.functions.rasters import clip, let

SIXTEEN = ("I;16", "I;16B", "I;16L", "I;16N")
EIGHT = ("1", "L", "LA", "P", "RGB", "RGBA", "CMYK")


def _positive(n: Column) -> Column:
    return F.when(n > 0, n)


def integer_depth(bits: Column, tag: Column, extension: Column) -> Column:
    """Bits of an integer image of unnamed depth: its metadata, its TIFF tag, else 16 for TIFF and 32 for others."""
    return F.coalesce(_positive(bits), _positive(tag), F.when(F.lower(extension).isin(".tif", ".tiff"), 16).otherwise(32))


def content_depth(mode: Column, bits: Column, tag: Column) -> Column:
    """Bits for looking at content: by mode, else by metadata; null if unknown."""
    return F.when(mode.isin(*EIGHT), 8).when(mode.isin(*SIXTEEN), 16).otherwise(F.coalesce(_positive(bits), _positive(tag)))


def _most(depth: Column) -> Column:
    """The greatest number of so many bits, up to 32."""
    return (F.pow(F.lit(2.0), F.least(depth, F.lit(32))) - 1).cast("double")


def divisor(mode: Column, bits: Column, tag: Column, extension: Column, lo: Column, hi: Column) -> Column:
    """What values are divided by. Floats keep theirs unless 8 or 16 bits are named, none is negative and some exceed 1."""
    named = F.coalesce(bits, tag)
    floats = F.when(named.isin(8, 16) & (lo >= 0) & (hi > 1), _most(named)).otherwise(F.lit(1.0))
    return F.when(mode.isin(*SIXTEEN), F.lit(65535.0)).when(mode == "I", _most(integer_depth(bits, tag, extension))).when(mode == "F", floats).otherwise(F.lit(255.0))


def channels(mode: Column) -> Column:
    """Channels after reading: gray becomes three, gray with alpha and palettes four."""
    return F.when(mode.isin("LA", "P", "RGBA"), 4).otherwise(3)


def content_scaled(a: Column, whole: Column, depth: Column, type_most: Column) -> Column:
    """Values for content rules in [0, 1]: whole numbers by their depth, else their type's greatest; floats above 1 by
    their depth, else by 255 or 65535."""

    def scaled(hi: Column) -> Column:
        by_type = F.when(depth.between(1, 32), _most(depth)).otherwise(type_most)
        floats = F.when(hi <= 1, F.lit(1.0)).when(depth.isin(8, 16), _most(depth)).when(hi <= 255, F.lit(255.0)).otherwise(F.lit(65535.0))
        k = F.when(whole, by_type).otherwise(floats)
        return F.transform(a, lambda x: clip(x / F.when(k > 0, k).otherwise(1.0)))

    return let(F.array_max(a), scaled)


def content_kind(mode: Column, red: Column, green: Column, blue: Column) -> Column:
    """Type by content where the name says nothing: gray is height, mostly blue and steady is normal, else diffuse; null pixels: unknown."""
    from texloom.functions.rasters import deviation, mean

    normal = (mean(blue) > 0.7) & (F.abs(mean(red) - 0.5) < 0.15) & (F.abs(mean(green) - 0.5) < 0.15) & (deviation(blue) < 0.15)
    return F.when(mode.isin("L", "LA", "I", "F", *SIXTEEN), F.lit("height")).when(red.isNull(), F.lit("unknown")).when(normal, F.lit("normal")).otherwise(F.lit("diffuse"))
