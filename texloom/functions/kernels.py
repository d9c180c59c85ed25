"""Neighbourhood kernels on single rasters in numpy (float64, height x width [x channels]).

Edge rules are explicit: ``symmetric`` repeats the edge pixel, ``reflect`` does not, ``wrap`` goes round.
"""

from __future__ import annotations

import numpy as np


def _padded(a: np.ndarray, ry: int, rx: int, mode: str) -> np.ndarray:
    return np.pad(a, ((ry, ry), (rx, rx)) + ((0, 0),) * (a.ndim - 2), mode=mode)


def convolve_lines(a: np.ndarray, k: np.ndarray, axis: int, mode: str) -> np.ndarray:
    r = len(k) // 2
    p = _padded(a, r, 0, mode) if axis == 0 else _padded(a, 0, r, mode)
    n = a.shape[axis]
    return sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(k))


def gaussian(a: np.ndarray, sigma: float, mode: str = "symmetric", cut: float = 4.0) -> np.ndarray:
    """Separable Gaussian blur of each channel, kernel cut at ``cut`` deviations."""
    r = max(1, int(cut * sigma + 0.5))
    x = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    k /= k.sum()
    return convolve_lines(convolve_lines(a.astype(np.float64), k, 0, mode), k, 1, mode)


def box(a: np.ndarray, size: int, mode: str = "symmetric") -> np.ndarray:
    """Mean over an odd window by running sums."""
    r = size // 2
    p = _padded(a.astype(np.float64), r, r, mode)
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1) + p.shape[2:])
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)


def local_std(a: np.ndarray, size: int) -> np.ndarray:
    return np.sqrt(np.maximum(box(a * a, size) - box(a, size) ** 2, 0))


def sobel(a: np.ndarray, axis: int, size: int = 3) -> np.ndarray:
    """Derivative along an axis: binomial smoothing across, derivative of it along; reflected about edge pixels."""
    smooth, step = np.ones(1), np.array([-1.0, 1.0])
    for _ in range(size - 1):
        smooth = np.convolve(smooth, [1.0, 1.0])
    for _ in range(size - 2):
        step = np.convolve(step, [1.0, 1.0])
    return convolve_lines(convolve_lines(a.astype(np.float64), step, axis, "reflect"), smooth, 1 - axis, "reflect")


def laplacian(a: np.ndarray) -> np.ndarray:
    """Sum of second derivatives with the kernel 2 0 2 / 0 -8 0 / 2 0 2."""
    p = _padded(a.astype(np.float64), 1, 1, "reflect")
    return 2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * a


def bilateral(a: np.ndarray, diameter: int, sigma_colour: float, sigma_space: float) -> np.ndarray:
    r = diameter // 2
    p = _padded(a.astype(np.float64), r, r, "reflect")
    num, den = np.zeros_like(a, dtype=np.float64), np.zeros_like(a, dtype=np.float64)
    h, w = a.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            q = p[r + dy : r + dy + h, r + dx : r + dx + w]
            k = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (q - a) ** 2 / (2 * sigma_colour**2))
            num += k * q
            den += k
    return num / den


def dilate(a: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    p = np.pad(a, r, mode="edge")
    h, w = a.shape
    return np.max([p[y : y + h, x : x + w] for y in range(size) for x in range(size)], axis=0)


def erode(a: np.ndarray, size: int = 3) -> np.ndarray:
    return -dilate(-a.astype(np.float64), size)


def opened_closed(mask: np.ndarray, size: int = 3) -> np.ndarray:
    m = dilate(erode(mask, size), size)
    return erode(dilate(m, size), size)


def labels(mask: np.ndarray) -> np.ndarray:
    """8-neighbour components by label spreading; 0 is background."""
    out = np.where(mask > 0, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = np.where(mask > 0, dilate(out), 0)
        if (new == out).all():
            return out
        out = new


def large_areas(mask: np.ndarray, least: int) -> np.ndarray:
    l = labels(mask)
    ids, n = np.unique(l, return_counts=True)
    return np.isin(l, ids[(n >= least) & (ids > 0)]).astype(np.float64)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 4) * (np.abs(x) < 4)


def _cubic(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))


def _weights(n: int, m: int, method: str) -> np.ndarray:
    """m x n matrix that resamples a line of n to m pixels, pixel centres aligned, edges repeated."""
    scale = n / m
    out = np.zeros((m, n))
    if method == "nearest":
        out[np.arange(m), np.minimum((np.arange(m) * scale).astype(int), n - 1)] = 1
        return out
    if method == "area" and m < n:
        for i in range(m):
            lo, hi = i * scale, (i + 1) * scale
            for j in range(int(lo), min(n, int(np.ceil(hi)))):
                out[i, j] = min(hi, j + 1) - max(lo, j)
        return out / out.sum(1, keepdims=True)
    reach, f = {"lanczos": (4, _lanczos), "cubic": (2, _cubic)}.get(method, (1, lambda x: np.maximum(1 - np.abs(x), 0)))
    centre = (np.arange(m) + 0.5) * scale - 0.5
    first = np.floor(centre).astype(int) - reach + 1
    for k in range(2 * reach):
        w = f(centre - (first + k))
        np.add.at(out, (np.arange(m), np.clip(first + k, 0, n - 1)), w)
    return out / out.sum(1, keepdims=True)


def resize(a: np.ndarray, h: int, w: int, method: str = "linear") -> np.ndarray:
    """nearest, linear, area, cubic or lanczos."""
    y, x = _weights(a.shape[0], h, method), _weights(a.shape[1], w, method)
    return np.einsum("yi,ij...,xj->yx...", y, a.astype(np.float64), x)


def remap(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples at real places, wrapped."""
    h, w = a.shape[:2]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    at = lambda j, i: a[j % h, i % w]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue in [0, 1), saturation, value."""
    hi, lo = rgb.max(-1), rgb.min(-1)
    d = hi - lo
    safe = np.where(d > 0, d, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.select([hi == r, hi == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) / 6 % 1
    return np.stack([np.where(d > 0, hue, 0), np.where(hi > 0, d / np.where(hi > 0, hi, 1), 0), hi], axis=-1)


def to_linear(v: np.ndarray) -> np.ndarray:
    v = np.clip(np.nan_to_num(v, nan=0.0), 0, 1)
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def to_srgb(v: np.ndarray) -> np.ndarray:
    v = np.clip(np.nan_to_num(v, nan=0.0), 0, 1)
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* under D65 of sRGB values."""
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = to_linear(rgb) @ m.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab_: np.ndarray) -> np.ndarray:
    """sRGB values of CIE L*a*b*, clipped."""
    f1 = (lab_[..., 0] + 16) / 116
    f = np.stack([f1 + lab_[..., 1] / 500, f1, f1 - lab_[..., 2] / 200], axis=-1)
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * np.array([0.950456, 1.0, 1.088754])
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    return to_srgb(np.clip(xyz @ np.linalg.inv(m).T, 0, 1))


def non_local_means(rgb: np.ndarray, strength: float, patch: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel as the mean of those whose surroundings resemble its own, weighted by exp(-distance / strength^2)."""
    h, w = rgb.shape[:2]
    r = search // 2
    wide = np.pad(rgb, ((r, r), (r, r), (0, 0)), mode="symmetric" if min(h, w) >= r else "edge")
    total, out = np.zeros((h, w)), np.zeros_like(rgb, dtype=np.float64)
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h, dx : dx + w]
            k = np.exp(-box(((rgb - other) ** 2).mean(-1), patch) / strength**2)
            total += k
            out += k[..., None] * other
    return out / total[..., None]


def bt709(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3] @ np.array([0.2126, 0.7152, 0.0722])


def robust(a: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    d = a.mean() + sigma * a.std()
    return np.clip(a / d, 0, 1) if d > 1e-8 else np.zeros_like(a)


def min_max(a: np.ndarray) -> np.ndarray:
    lo, hi = a.min(), a.max()
    return (a - lo) / (hi - lo) if hi - lo > 1e-8 else np.full_like(a, 0.5)


def wrap_pad(a: np.ndarray, fraction: float = 0.25) -> tuple[np.ndarray, tuple[int, int]]:
    py, px = max(1, int(a.shape[0] * fraction)), max(1, int(a.shape[1] * fraction))
    return _padded(a, py, px, "wrap"), (py, px)


def cropped(a: np.ndarray, pad: tuple[int, int], h: int, w: int, scale: int = 1) -> np.ndarray:
    y, x = pad[0] * scale, pad[1] * scale
    return a[y : y + h * scale, x : x + w * scale]


def height_from_normals(n: np.ndarray) -> np.ndarray:
    """Least-squares surface of a seamless normal map in the frequency domain, scaled to [0, 1]."""
    d = n * 2 - 1
    z = np.maximum(np.abs(d[..., 2]), 1e-3)
    p, q = np.fft.fft2(-d[..., 0] / z), np.fft.fft2(-d[..., 1] / z)
    v, u = np.meshgrid(*(2 * np.pi * np.fft.fftfreq(k) for k in n.shape[:2]), indexing="ij")
    power = u * u + v * v
    power[0, 0] = 1
    s = (-1j * u * p - 1j * v * q) / power
    s[0, 0] = 0
    return min_max(np.real(np.fft.ifft2(s)))


def tiles(a: np.ndarray, size: int, stride: int) -> list[tuple[int, int, np.ndarray]]:
    """Overlapping tiles that cover a raster."""
    starts = lambda n: sorted({*range(0, max(1, n - size + 1), stride), max(0, n - size)})
    return [(y, x, a[y : y + size, x : x + size]) for y in starts(a.shape[0]) for x in starts(a.shape[1])]


def merged(parts: list[tuple[int, int, np.ndarray]], h: int, w: int) -> np.ndarray:
    """Tiles blended by pyramid weights."""
    out, den = np.zeros((h, w) + parts[0][2].shape[2:]), np.zeros((h, w))
    for y, x, t in parts:
        ramp = lambda n: np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(float)
        k = np.minimum.outer(ramp(t.shape[0]), ramp(t.shape[1]))
        out[y : y + t.shape[0], x : x + t.shape[1]] += t * (k[..., None] if t.ndim == 3 else k)
        den[y : y + t.shape[0], x : x + t.shape[1]] += k
    return out / (den[..., None] if out.ndim == 3 else den)


def lut_trilinear(rgb: np.ndarray, cube: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Colours through a cube indexed [blue, green, red], trilinear."""
    n = cube.shape[0]
    t = np.clip((rgb - lo) / np.maximum(hi - lo, 1e-8), 0, 1) * (n - 1)
    i = np.minimum(t.astype(int), n - 2) if n > 1 else np.zeros_like(t, int)
    f = t - i
    out = np.zeros_like(rgb, dtype=np.float64)
    for corner in range(8):
        d = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
        k = np.prod(np.where(d, f, 1 - f), axis=-1, keepdims=True)
        j = np.minimum(i + d, n - 1)
        out += k * cube[j[..., 2], j[..., 1], j[..., 0]]
    return out
