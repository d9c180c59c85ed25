"""Derivation of maps: one row per raster, numpy kernels on Arrow batches, phases fused in one pass.

Rasters are arrays of doubles with height, width and channels; nothing is shuffled, and a
batch holds few rows, so memory is bounded by the rasters of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from texloom.functions import kernels as K
from texloom.functions import tables as T
from texloom.functions.colour import Grading


def scale_of(h: int, w: int, base: int = 1024) -> float:
    return max(max(h, w) / base, 0.25)


def odd_window(v: float) -> int:
    n = max(int(round(v)), 3)
    return n + (n % 2 == 0)


def delighted(rgb: np.ndarray, low_sigma: float = 48.0, mid_sigma: float = 12.0, lift: float = 0.12, suppress: float = 0.25, strength: float = 1.0) -> np.ndarray:
    """Albedo without slow lighting: luminance is corrected by blurred illumination, ratios of channels stay."""
    lin = K.to_linear(rgb)
    lum, k = K.bt709(lin), scale_of(*rgb.shape[:2])
    light = 0.7 * K.gaussian(lum, max(low_sigma * k, 1.0)) + 0.3 * K.gaussian(lum, max(mid_sigma * k, 0.75))
    light /= light.mean() + 1e-6
    fix = np.clip((1 + lift * np.clip(1 / np.maximum(light, 1e-3) - 1, 0, 2)) * (1 - suppress * np.clip(light - 1, 0, 1)), 0.6, 1.6)
    gain = np.clip(lum * fix, 0, 1) / np.maximum(lum, 1e-5)
    return np.clip(K.to_srgb(np.clip(lin * gain[..., None], 0, 1) * strength + lin * (1 - strength)), 0, 1)


def delighted_lab(rgb: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Albedo by correcting lightness alone: three wide blurs of it, weighted, as the illumination; gain from a half to two."""
    lab = K.lab(rgb)
    light = lab[..., 0] * 2.55
    side = max(rgb.shape[:2])
    shade = sum(w * K.gaussian(light, max(side // k / 3.0, 1.0)) for w, k in ((0.2, 8), (0.5, 4), (0.3, 2)))
    fixed = np.clip(light * np.clip(shade.mean() / np.maximum(shade, 1.0), 0.5, 2.0), 0, 255) if shade.mean() > 1 else light
    lab[..., 0] = (fixed * strength + light * (1 - strength)) / 2.55
    return K.from_lab(lab)


def graded(rgb: np.ndarray, material: str, s: Grading, cube: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The whole grading pass: white balance, exposure, gamma, saturation, colour table, denoising, sharpening, clamp."""
    of = lambda table, other: table.get((material or "default").strip().lower() or "default", table.get("default", other))
    wb = float(np.clip(s.white_balance + of(s.white_balance_by, 0.0), -1, 1))
    work = K.to_linear(np.clip(rgb, 0, 1)) * np.array([1 + 0.18 * wb, 1 - 0.06 * abs(wb), 1 - 0.18 * wb]) * 2.0 ** (s.exposure + of(s.exposure_by, 0.0))
    work = np.clip(work, 0, 1) ** max(of(s.gamma_by, s.gamma), 1e-3)
    luma = K.bt709(work)[..., None]
    work = np.clip(luma + (work - luma) * s.saturation * of(s.saturation_by, 1.0), 0, 1)
    if s.lut_strength > 0 and cube is not None:
        k, shown = min(s.lut_strength, 1.0), K.to_srgb(work)
        work = K.to_linear(shown * (1 - k) + np.clip(K.lut_trilinear(shown, *cube), 0, 1) * k)
    if s.denoise > 0:
        work = K.to_linear(K.non_local_means(K.to_srgb(work), max(round(6 + s.denoise * 12), 1) / 255))
    if s.sharpen > 0:
        blur = np.stack([K.gaussian(work[..., c], max(s.sharpen_radius, 0.5)) for c in range(3)], axis=-1)
        work = np.clip(work + s.sharpen * (work - blur), 0, 1)
    if s.clamp and s.clamp[0] < s.clamp[1]:
        work = np.clip(work, *s.clamp)
    return np.clip(K.to_srgb(work), 0, 1)


def zones(rgb: np.ndarray, material: str, blur: int = 5) -> dict[str, np.ndarray]:
    """Soft masks of metal, cloth, leather and skin by hue, saturation, value and local variation."""
    h, s, v = np.moveaxis(K.hsv(rgb), -1, 0)
    lum = K.bt709(K.to_linear(rgb))
    var = K.local_std(lum, 7)
    r, g, b = np.moveaxis(rgb[..., :3], -1, 0)
    found = {
        "metal": (s < 0.22) & (v > 0.22) & (lum > 0.16) & (var < 0.11),
        "cloth": (s > 0.12) & (v > 0.10) & (v < 0.85) & (var > 0.04),
        "leather": (h > 0.03) & (h < 0.15) & (s > 0.18) & (s < 0.75) & (v > 0.12) & (v < 0.80),
        "skin": (h > 0.02) & (h < 0.14) & (s > 0.16) & (s < 0.65) & (v > 0.30) & (r > g) & (g > 0.8 * b),
    }
    floors = {**{m: ("metal", 0.65) for m in T.METALS}, "leather": ("leather", 0.6), "skin": ("skin", 0.6), "fabric": ("cloth", 0.6), "cloth": ("cloth", 0.6)}
    out = {}
    for name, mask in found.items():
        m = mask.astype(np.float64)
        if floors.get(material, ("", 0))[0] == name:
            m = np.maximum(m, floors[material][1])
        out[name] = np.clip(K.gaussian(m, max(blur / 2, 0.5), "reflect") if blur else m, 0, 1)
    return out


def roughness(linear: np.ndarray, material: str) -> np.ndarray:
    """Local variation at three sizes, edges and fine detail around the material's base value."""
    gray, k = np.clip(K.bt709(linear), 0, 1) ** (1 / 2.2), scale_of(*linear.shape[:2])
    var = K.robust(sum(w * K.local_std(gray, odd_window(n * k)) for w, n in ((0.4, 5), (0.35, 9), (0.25, 15))))
    edge = K.robust(np.hypot(K.sobel(gray, 1), K.sobel(gray, 0)))
    fine = K.robust(K.box(np.abs(K.laplacian(gray)), odd_window(11 * k)))
    mixed = K.robust(0.5 * var + 0.3 * edge + 0.2 * fine, 2.5)
    base = T.ROUGHNESS.get(material, T.ROUGHNESS["default"])
    return K.gaussian(np.clip(base + (mixed - 0.5) * 0.8, 0.04, 1), max(0.5, 1.5 * k))


def metalness(rgb: np.ndarray, material: str, threshold: float = 0.5) -> np.ndarray:
    """Base value of the material, changed where colour contradicts or suggests metal; smoothed and made binary."""
    base = T.METALNESS.get(material, T.METALNESS["default"])
    h, s, v = np.moveaxis(K.hsv(rgb), -1, 0)
    lum = K.bt709(rgb)
    calm = K.local_std(lum, 7) < 0.08
    m = np.full(lum.shape, base)
    if base > 0.5:
        m[lum < 0.08] *= 0.1
        m[(lum > 0.85) & (s < 0.05)] *= 0.5
        m[s > 0.7] *= 0.4
    elif material in ("default", *T.METALS, "glass", "ceramic", "cobblestone", "concrete"):
        warm = (h > 0.06) & (h < 0.18) & (s > 0.25) & (s < 0.7) & (v > 0.55) & (lum > 0.5) & (rgb[..., 0] - rgb[..., 2] > 0.2) & calm
        bright = (s < 0.1) & (v > 0.55) & (lum > 0.45) & calm
        dull = (s < 0.1) & (v > 0.35) & (v < 0.65) & (lum > 0.18) & (lum < 0.55) & calm
        for mask, least in ((warm, 0.8), (bright, 0.7), (dull, 0.55)):
            m[mask] = np.maximum(m[mask], least)
    m = np.clip(K.bilateral(m, 9, 0.2, 50), 0, 1)
    return (np.where(m > 0.5, 1 - 0.5 * (2 * (1 - m)) ** 2, 0.5 * (2 * m) ** 2) > threshold).astype(np.float64)


def occlusion(linear: np.ndarray, radius: int = 8, strength: float = 1.0) -> np.ndarray:
    """One minus cavities, which are darker than their blurred surroundings in proportion, at four sizes."""
    gray, k = K.bt709(linear), scale_of(*linear.shape[:2])
    total = np.zeros_like(gray)
    for w, size in zip((0.35, 0.30, 0.20, 0.15), (max(3, radius // 2), max(5, radius), max(7, 2 * radius), max(9, 3 * radius)), strict=True):
        sigma = max(min(odd_window(size * k) / 2, 32 * k), 0.5)
        total += w * K.robust(np.maximum(1 - gray / np.maximum(K.gaussian(gray, sigma), 1e-6), 0), 2.5)
    return K.gaussian(np.clip(1 - K.robust(total, 2.0) * strength, 0, 1), max(0.5, 1.5 * k))


def height(rgb: np.ndarray, radius: float = 10.0, contrast: float = 1.2) -> np.ndarray:
    """Mostly luminance, some high-pass, more contrast, scaled to [0, 1]."""
    gray = K.bt709(K.to_linear(rgb))
    h = 0.7 * gray + 0.3 * (gray - K.gaussian(gray, radius) + 0.5)
    return K.min_max((h - h.mean()) * contrast + h.mean())


def encoded(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    n = np.stack([x, y, z], axis=-1)
    return n / np.maximum(np.sqrt((n * n).sum(-1, keepdims=True)), 1e-8) * 0.5 + 0.5


def sobel_size(h: int, w: int) -> int:
    return 7 if max(h, w) >= 2048 else 5 if max(h, w) >= 1024 else 3


def normals(height_map: np.ndarray, flatness: float = 2.0, invert_y: bool = False, blur: float = 0.0) -> np.ndarray:
    a = K.gaussian(height_map, blur) if blur > 0 else height_map
    size = sobel_size(*a.shape[:2])
    dx, dy = K.sobel(a, 1, size), K.sobel(a, 0, size) * (-1 if invert_y else 1)
    return encoded(-dx, -dy, np.full_like(dx, max(flatness, 0.01)))


def detail_normals(rgb: np.ndarray, flatness: float = 2.0) -> np.ndarray:
    """From the mean of the channels' gradients."""
    size = sobel_size(*rgb.shape[:2])
    dx, dy = (np.mean([K.sobel(rgb[..., c], axis, size) for c in range(3)], axis=0) for axis in (1, 0))
    return encoded(-dx, -dy, np.full_like(dx, flatness))


def blended(base: np.ndarray, detail: np.ndarray, base_weight: float = 1.0, detail_weight: float = 1.0) -> np.ndarray:
    """Whiteout blend; weights pull a normal towards flat first."""

    def unit(n: np.ndarray, w: float) -> np.ndarray:
        d = (n * 2 - 1) * w + np.array([0, 0, 1.0]) * (1 - w)
        return d / np.maximum(np.sqrt((d * d).sum(-1, keepdims=True)), 1e-8) if w < 1 else d

    p, q = unit(base, base_weight), unit(detail, detail_weight)
    return encoded(p[..., 0] * q[..., 2] + q[..., 0] * p[..., 2], p[..., 1] * q[..., 2] + q[..., 1] * p[..., 2], p[..., 2] * q[..., 2])


def strengthened(n: np.ndarray, strength: float) -> np.ndarray:
    d = n * 2 - 1
    x, y = d[..., 0] * strength, d[..., 1] * strength
    over = x * x + y * y
    k = np.where(over > 1 - 1e-4, np.sqrt((1 - 1e-4) / np.maximum(over, 1e-8)), 1)
    x, y = x * k, y * k
    return encoded(x, y, np.sqrt(np.maximum(1 - x * x - y * y, 1e-6)))


def repaired(n: np.ndarray) -> np.ndarray:
    """Finite, unit length, facing up."""
    d = n * 2 - 1
    bad = ~np.isfinite(d)
    d = np.where(bad, 0, d)
    empty = bad.any() & (d == 0).all(-1)
    d[..., 2] = np.where(empty, 1, d[..., 2])
    d = d / np.maximum(np.sqrt((d * d).sum(-1, keepdims=True)), 1e-8)
    d[..., 2] = np.abs(d[..., 2])
    return d * 0.5 + 0.5


def parallax(height_map: np.ndarray, tileable: bool, boost: float = 1.3) -> np.ndarray:
    """Detail boosted, then smoothed along edges; wrapped first if the texture tiles."""
    h, w = height_map.shape
    a = height_map if height_map.max() - height_map.min() > 1e-8 else np.full_like(height_map, 0.5)
    a, pad = K.wrap_pad(np.clip(a, 0, 1)) if tileable else (np.clip(a, 0, 1), None)
    low = K.gaussian(a, max(1.0, 5.0 * max(a.shape) / 1024))
    a = np.clip(K.bilateral(np.clip(low + (a - low) * boost, 0, 1), 5, 0.3, 10.0), 0, 1)
    return K.cropped(a, pad, h, w) if pad else a


def seam_repaired(rgb: np.ndarray, border: int = 12, strength: float = 0.85) -> np.ndarray:
    """Opposite borders blended towards each other, outermost most, columns before rows."""
    out = rgb.copy()
    for axis in (1, 0):
        n = out.shape[axis]
        for i in range(min(border, n // 2)):
            a, b = (np.take(out, j, axis=axis) for j in (i, n - 1 - i))
            k, mid = strength * (1 - i / border), (a + b) / 2
            for j, line in ((i, a), (n - 1 - i, b)):
                index = [slice(None)] * out.ndim
                index[axis] = j
                out[tuple(index)] = line * (1 - k) + mid * k
    return out


def emissive(rgb: np.ndarray, lum_least: float = 0.8, sat_least: float = 0.5, val_least: float = 0.9, region: float = 0.0005) -> np.ndarray:
    """Mask of bright or vivid areas, cleaned and without tiny ones."""
    _, s, v = np.moveaxis(K.hsv(rgb), -1, 0)
    mask = ((K.bt709(rgb) > lum_least) & (s > sat_least)) | ((v > val_least) & (s > 0.6 * sat_least))
    return K.large_areas(K.opened_closed(mask.astype(np.float64)), max(int(region * mask.size), 1))


def env_mask(rough: np.ndarray, metal: np.ndarray, gloss_weight: float = 0.35, metal_weight: float = 0.65, bias: float = 0.0) -> np.ndarray:
    return np.clip(K.gaussian(np.clip(gloss_weight * (1 - rough) + metal_weight * metal + bias, 0, 1), 1.0, "reflect"), 0, 1)


def antialiased(rough: np.ndarray, n: np.ndarray, size: int = 3, threshold: float = 0.001, most: float = 0.15) -> np.ndarray:
    """Roughness raised where normals vary within a pixel's surroundings."""
    d = n[..., :2] * 2 - 1
    var = np.maximum(K.box(d * d, size) - K.box(d, size) ** 2, 0).sum(-1)
    return np.clip(np.sqrt(rough * rough + np.where(var > threshold, np.minimum(var, most), 0)), 0, 1)


def overlaid(n: np.ndarray, detail: np.ndarray, repeat: float = 8.0, strength: float = 0.3) -> np.ndarray:
    """A detail normal map tiled over a base one."""
    y, x = np.meshgrid(*(np.arange(k) * repeat / k * m for k, m in zip(n.shape[:2], detail.shape[:2], strict=True)), indexing="ij")
    return blended(n, strengthened(K.remap(detail, y, x), strength))


def mip(a: np.ndarray, h: int, w: int, kind: str, level: int) -> np.ndarray:
    """One level: vectors for normals, nearest for masks, linear light for colour, wider roughness."""
    if kind in ("mask", "opacity"):
        return K.resize(a, h, w, "nearest")
    if kind == "normal":
        d = K.resize(a[..., :3] * 2 - 1, h, w, "area")
        return d / np.maximum(np.sqrt((d * d).sum(-1, keepdims=True)), 1e-8) * 0.5 + 0.5
    colour = kind in T.SRGB_TYPES and a.ndim == 3
    out = K.resize(K.to_linear(a) if colour else a, h, w, "lanczos")
    out = np.clip(K.to_srgb(np.clip(out, 0, 1)) if colour else out, 0, 1)
    return np.sqrt(np.clip(out**2 + 0.04 * (2.0**level - 1), 0, 1)) if kind == "roughness" else out


def curvature(n: np.ndarray, radius: int = 1) -> np.ndarray:
    """Divergence of a normal map, wrapped, scaled to [0, 1]."""
    d = n * 2 - 1
    out = (np.roll(d[..., 0], -1, 1) - np.roll(d[..., 0], 1, 1)) - (np.roll(d[..., 1], -1, 0) - np.roll(d[..., 1], 1, 0))
    return K.min_max(K.gaussian(out, radius, "wrap"))


def derive(df: DataFrame, make: Callable[[np.ndarray, str], dict[str, np.ndarray]], h: int, w: int, channels: int, names: tuple[str, ...], value: str = "v", key: str = "vec_id", material: str = "material", rows_a_batch: int = 256, tasks: int | None = None) -> DataFrame:
    """(key, map, h, w, data) for every map that ``make`` derives from a raster and its material.

    Rasters are spread over tasks first, as a source of few large files would leave most of them idle. A raster
    of another size is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(i, rows_a_batch)
                v = part.column(1)
                sizes = np.diff(v.offsets.to_numpy())
                if (sizes != h * w * channels).any():
                    raise ValueError(f"a raster of {sizes.max()} values where {h * w * channels} were named")
                cells = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape((len(v), h, w, channels) if channels > 1 else (len(v), h, w))
                keys, maps, heights, widths, data, ends = [], [], [], [], [], [0]
                for k, a, m in zip(part.column(0).to_pylist(), cells, part.column(2).to_pylist(), strict=True):
                    made = make(a, m)
                    for n in names:
                        if n in made:
                            keys.append(k)
                            maps.append(n)
                            heights.append(made[n].shape[0])
                            widths.append(made[n].shape[1])
                            data.append(made[n].ravel())
                            ends.append(ends[-1] + data[-1].size)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(data) if data else np.zeros(0)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(maps, pa.string()), pa.array(heights, pa.int32()), pa.array(widths, pa.int32()), lists], names=[key, "map", "h", "w", "data"])

    rows = df.select(key, value, material).repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)
    return rows.mapInArrow(run, f"{key} long, map string, h int, w int, data array<double>")
