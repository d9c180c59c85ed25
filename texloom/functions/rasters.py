"""Column functions on rasters held as arrays of doubles, row by row, channels last.

Everything stays within one row: no explosion of pixels and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return let(a, lambda a: let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))))


def percentile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        return F.get(s, low) + (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low)) * (place - low)

    return let(F.sort_array(a), at)


def share(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test)) / F.size(a)


def to_linear(v: Column) -> Column:
    """sRGB to linear; NaN and null count as 0."""
    v = clip(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    v = clip(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def bt709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def pixels(n: int, body: Callable[[Column], Column]) -> Column:
    """An array of body(pixel number) for n pixels."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), body)


def luminance(a: Column, n: int, channels: int, linear: bool) -> Column:
    """Luminance of each of n pixels; sRGB values are made linear first if asked."""
    f = to_linear if linear else (lambda v: v)
    return pixels(n, lambda i: bt709(*[f(F.get(a, i * channels + c)) for c in range(3)]))


def robust(a: Column, sigma: float = 3.0) -> Column:
    """Divided by mean + sigma deviations and clipped; zero where that is tiny."""
    return let(mean(a) + sigma * deviation(a), lambda d: F.transform(a, lambda x: F.when(d > 1e-8, clip(x / d)).otherwise(F.lit(0.0))))


def min_max(a: Column) -> Column:
    return let(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), lambda r: F.transform(a, lambda x: F.when(r["hi"] - r["lo"] > 1e-8, (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(F.lit(0.5))))


def contrast(a: Column, factor: float) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: (x - m) * factor + m))


def mirror(i: Column, n: int, about_edge: bool) -> Column:
    """An index reflected into 0..n-1: with the edge pixel repeated, or (about_edge) not."""
    shift = 0 if about_edge else 1
    return F.when(i < 0, -i - shift).when(i >= n, 2 * n - 2 - i + shift).otherwise(i)


def stencil(a: Column, h: int, w: int, weights: dict[tuple[int, int], float], about_edge: bool = True) -> Column:
    """Weighted sum of neighbours (dy, dx) at each pixel of one channel."""

    def at(i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), i % w
        out = F.lit(0.0)
        for (dy, dx), k in weights.items():
            out = out + F.get(a, mirror(y + dy, h, about_edge) * w + mirror(x + dx, w, about_edge)) * k
        return out

    return pixels(h * w, at)


SOBEL_X = {(dy, dx): float(dx * (2 - abs(dy))) for dy in (-1, 0, 1) for dx in (-1, 1)}
SOBEL_Y = {(dx, dy): v for (dy, dx), v in SOBEL_X.items()}
BOX_3 = {(dy, dx): 1 / 9 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def seam_score(a: Column, h: int, w: int, channels: int, border: int) -> Column:
    """0.4 x border difference + 0.6 x excess of the wrap gradient over the mean inner one. Columns are paired in order, not mirrored."""
    b = min(border, h, w)
    at = lambda y, x, c: F.get(a, (y * w + x) * channels + c)
    diff_lr = total(pixels(h * b * channels, lambda i: F.abs(at(F.floor(i / (b * channels)).cast("int"), F.floor(i / channels).cast("int") % b, i % channels) - at(F.floor(i / (b * channels)).cast("int"), w - b + F.floor(i / channels).cast("int") % b, i % channels)))) / (h * b * channels)
    diff_tb = total(pixels(b * w * channels, lambda i: F.abs(F.get(a, i) - F.get(a, i + (h - b) * w * channels)))) / (b * w * channels)

    def gradients(g: Column) -> Column:
        inner_x = lambda y: total(F.transform(F.sequence(F.lit(0), F.lit(w - 2)), lambda x: F.abs(F.get(g, y * w + x + 1) - F.get(g, y * w + x)))) / (w - 1)
        inner_y = lambda x: total(F.transform(F.sequence(F.lit(0), F.lit(h - 2)), lambda y: F.abs(F.get(g, (y + 1) * w + x) - F.get(g, y * w + x)))) / (h - 1)
        lr = total(pixels(h, lambda y: F.greatest(F.abs(F.get(g, y * w) - F.get(g, y * w + w - 1)) - inner_x(y), F.lit(0.0)))) / h
        tb = total(pixels(w, lambda x: F.greatest(F.abs(F.get(g, x) - F.get(g, (h - 1) * w + x)) - inner_y(x), F.lit(0.0)))) / w
        return (lr + tb) / 2

    grad = let(luminance(a, h * w, channels, linear=False), gradients)
    return 0.4 * (diff_lr + diff_tb) / 2 + 0.6 * grad


def unit_normals(a: Column, n: int, channels: int = 3, fix: bool = True) -> Column:
    """Decoded normals at unit length: array of struct(x, y, z); non-finite parts become 0, empty ones point up, z is positive."""

    def one(i: Column) -> Column:
        part = [F.get(a, i * channels + c) * 2.0 - 1.0 for c in range(3)]
        part = [F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), F.lit(0.0)).otherwise(p) for p in part]
        return F.struct(*[p.alias(k) for k, p in zip("xyz", part, strict=True)])

    def scaled(v: Column) -> Column:
        z = F.when((v["x"] == 0) & (v["y"] == 0) & (v["z"] == 0), F.lit(1.0)).otherwise(v["z"])
        size = F.greatest(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + z * z), F.lit(1e-8))
        return F.struct((v["x"] / size).alias("x"), (v["y"] / size).alias("y"), (F.abs(z / size) if fix else z / size).alias("z"))

    return F.transform(pixels(n, one), scaled)


def whiteout(p: Column, q: Column) -> Column:
    """Whiteout blend of two unit normals, at unit length."""
    x, y, z = p["x"] * q["z"] + q["x"] * p["z"], p["y"] * q["z"] + q["y"] * p["z"], p["z"] * q["z"]
    size = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-8))
    return F.struct((x / size).alias("x"), (y / size).alias("y"), (z / size).alias("z"))
