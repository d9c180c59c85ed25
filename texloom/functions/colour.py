"""Colour as column functions: Lab on the scale of 8-bit images, grading, packing layouts, upscaling without a model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from texloom.functions import tables as T
from texloom.functions.rasters import bt709, clip, let, pixels, to_linear, to_srgb


def _xyz(rows: tuple[tuple[float, ...], ...], parts: list[Column]) -> list[Column]:
    return [sum((k * p for k, p in zip(row[1:], parts[1:], strict=True)), row[0] * parts[0]) for row in rows]


def to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of sRGB values, each on the scale 0 to 255 (not rounded). Each step is bound once, as it is used several times."""
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    white = lambda v: F.array(*[x / w for x, w in zip(_xyz(T.RGB_TO_XYZ, [v[k] for k in range(3)]), T.WHITE, strict=True)])
    lab = lambda t: F.struct(((116 * t[1] - 16) * 2.55).alias("l"), (500 * (t[0] - t[1]) + 128).alias("a"), (200 * (t[1] - t[2]) + 128).alias("b"))
    return let(F.transform(let(F.transform(F.array(r, g, b), to_linear), white), f), lab)


def from_lab(lab: Column) -> Column:
    """array of sRGB values in [0, 1]."""
    back = lambda t: F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)
    third = lambda v: F.array((v["l"] / 2.55 + 16) / 116 + (v["a"] - 128) / 500, (v["l"] / 2.55 + 16) / 116, (v["l"] / 2.55 + 16) / 116 - (v["b"] - 128) / 200)
    rgb = lambda t: F.array(*_xyz(T.XYZ_TO_RGB, [t[k] * w for k, w in enumerate(T.WHITE)]))
    return F.transform(let(F.transform(let(lab, third), back), rgb), to_srgb)


def transferred(lab: Column, mean: Column, std: Column, ref_mean: Column, ref_std: Column, strength: float = 0.35) -> Column:
    """A Lab pixel moved towards a group's statistics (structs l, a, b); a channel without spread stays."""
    parts = []
    for c in ("l", "a", "b"):
        ratio = clip(ref_std[c] / F.greatest(std[c], F.lit(1e-6)), 0.5, 1.5)
        moved = F.when(std[c] > 1e-6, (lab[c] - mean[c]) * ratio + ref_mean[c]).otherwise(lab[c])
        parts.append(clip(moved * strength + lab[c] * (1 - strength), 0.0, 255.0).alias(c))
    return F.struct(*parts)


def material_value(table: Mapping[str, float], category: Column) -> Column:
    """The category's own value, else the default's, else null."""
    c = F.lower(F.trim(F.coalesce(category, F.lit("default"))))
    c = F.when(c == "", F.lit("default")).otherwise(c)
    case = F.when(F.lit(False), F.lit(0.0))
    for k, v in table.items():
        case = case.when(c == k, F.lit(float(v)))
    return case.otherwise(F.lit(float(table["default"])) if "default" in table else F.lit(None).cast("double"))


@dataclass(frozen=True)
class Grading:
    """Settings of the grading pass; tables hold values by material."""

    white_balance: float = 0.0
    exposure: float = 0.0
    gamma: float = 1.0
    saturation: float = 1.0
    lut_strength: float = 0.0
    denoise: float = 0.0
    sharpen: float = 0.0
    sharpen_radius: float = 1.0
    clamp: tuple[float, float] | None = (0.02, 0.9)
    white_balance_by: Mapping[str, float] = field(default_factory=dict)
    exposure_by: Mapping[str, float] = field(default_factory=dict)
    gamma_by: Mapping[str, float] = field(default_factory=dict)
    saturation_by: Mapping[str, float] = field(default_factory=dict)


def graded(r: Column, g: Column, b: Column, category: Column, s: Grading) -> Column:
    """array of three sRGB values: white balance, exposure, gamma, saturation and clamp in linear light. Tables of colour,
    denoising and sharpening look at neighbours or files and are in operators.phases.graded."""
    wb = clip(F.lit(s.white_balance) + F.coalesce(material_value(s.white_balance_by, category), F.lit(0.0)), -1.0, 1.0)
    gain = F.pow(F.lit(2.0), F.lit(s.exposure) + F.coalesce(material_value(s.exposure_by, category), F.lit(0.0)))
    gamma = F.greatest(F.coalesce(material_value(s.gamma_by, category), F.lit(s.gamma)), F.lit(1e-3))
    sat = F.lit(s.saturation) * F.coalesce(material_value(s.saturation_by, category), F.lit(1.0))
    scale = (1 + 0.18 * wb, 1 - 0.06 * F.abs(wb), 1 - 0.18 * wb)
    light = F.transform(F.array(r, g, b), to_linear)

    def finish(parts: Column) -> Column:
        luma = bt709(parts[0], parts[1], parts[2])
        out = [clip(luma + (parts[k] - luma) * sat) for k in range(3)]
        if s.clamp and s.clamp[0] < s.clamp[1]:
            out = [clip(x, *s.clamp) for x in out]
        return F.transform(F.array(*out), to_srgb)

    return let(let(light, lambda v: F.array(*[F.pow(clip(v[j] * k * gain), gamma) for j, k in enumerate(scale)])), finish)


def layout_of(preset: str, custom: Mapping[str, str] | None = None, channels: tuple[str, str, str, str] = ("ao", "roughness", "metalness", "none")) -> tuple[str, ...]:
    """What each of red, green, blue and alpha holds: a preset (or ``channels``), with single channels replaced."""
    chosen = dict(zip("rgba", T.LAYOUTS.get((preset or "unreal_orm").strip().lower(), channels), strict=True))
    chosen |= {k.strip().lower(): v.strip().lower() for k, v in (custom or {}).items() if k.strip().lower() in "rgba"}
    if wrong := set(chosen.values()) - T.PACK_SOURCES:
        raise ValueError(f"no such channel: {sorted(wrong)}")
    return tuple(chosen[k] for k in "rgba")


def packed(layout: tuple[str, ...], roughness: Column, metalness: Column, ao: Column, gloss: Column) -> Column:
    """struct(r, g, b, a) of one pixel. No roughness, nothing; no gloss: 1 - roughness; no occlusion: 1; no metalness: 0;
    alpha only where the layout has a source for it."""
    rough = clip(roughness)
    shine = clip(F.coalesce(gloss, 1 - rough))
    value = {"roughness": rough, "metalness": clip(F.coalesce(metalness, F.lit(0.0))), "ao": clip(F.coalesce(ao, F.lit(1.0))), "gloss": shine, "smoothness": shine, "one": F.lit(1.0), "zero": F.lit(0.0), "none": F.lit(0.0)}
    parts = [value[k].alias(c) for k, c in zip(layout[:3], "rgb", strict=True)]
    alpha = F.lit(None).cast("double") if layout[3] in ("none", "zero") else value[layout[3]]
    return F.when(roughness.isNotNull(), F.struct(*parts, alpha.alias("a")))


def upscale_action(kind: Column, skip: tuple[str, ...] = ("ui", "mask"), nearest: tuple[str, ...] = ("mask", "opacity")) -> Column:
    """What upscaling does with a type: skipped before nearest, normal maps apart, all others by a model."""
    return F.when(kind.isin(*skip), F.lit("skip")).when(kind.isin(*nearest), F.lit("nearest")).when(kind == "normal", F.lit("normal")).otherwise(F.lit("model"))


def nearest_upscaled(a: Column, h: int, w: int, channels: int, th: int, tw: int) -> Column:
    """The pixel whose area holds the target's corner; values clipped."""

    def at(i: Column) -> Column:
        y, x, c = F.floor(i / (tw * channels)).cast("int"), (F.floor(i / channels) % tw).cast("int"), i % channels
        return clip(F.get(a, (F.floor(y * h / th).cast("int") * w + F.floor(x * w / tw).cast("int")) * channels + c))

    return pixels(th * tw * channels, at)


def linear_upscaled(a: Column, h: int, w: int, channels: int, th: int, tw: int) -> Column:
    """Bilinear between pixel centres, edges repeated."""

    def place(t: Column, n: int, m: int) -> tuple[Column, Column, Column]:
        p = (t + 0.5) * (n / m) - 0.5
        low = F.floor(p)
        inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v.cast("int")))
        return inside(low), inside(low + 1), p - low

    def at(i: Column) -> Column:
        c = i % channels
        y0, y1, fy = place(F.floor(i / (tw * channels)), h, th)
        x0, x1, fx = place(F.floor(i / channels) % tw, w, tw)
        get = lambda y, x: clip(F.get(a, (y * w + x) * channels + c))
        return (get(y0, x0) * (1 - fx) + get(y0, x1) * fx) * (1 - fy) + (get(y1, x0) * (1 - fx) + get(y1, x1) * fx) * fy

    return pixels(th * tw * channels, at)


def encoded_unit(x: Column, y: Column, z: Column) -> Column:
    """array of an encoded normal at unit length, its sign of z kept."""
    return let(F.array(x * 2 - 1, y * 2 - 1, z * 2 - 1), lambda d: F.transform(d, lambda v: v / F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(1e-8)) * 0.5 + 0.5))
