"""Pictures for review: a lit sphere, strips of before and after, maps of differences. Pure numpy on one raster."""

from __future__ import annotations

import numpy as np

from texloom.functions import kernels as K

#: Directions of the four lights, and the reflectance of what is no metal.
LIGHTS = np.array([[0.5, 0.5, 0.7], [-0.5, 0.3, 0.7], [0.0, -0.5, 0.8], [0.7, 0.0, 0.5]])
DIELECTRIC = 0.04


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-8)


def sphere(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which pixels show the sphere, its normals, and the longitude and latitude there, both from 0 to 1."""
    y, x = np.meshgrid(np.linspace(1, -1, side), np.linspace(-1, 1, side), indexing="ij")
    inside = x * x + y * y <= 1
    z = np.sqrt(np.maximum(1 - x * x - y * y, 0))
    return inside, _unit(np.stack([x, y, z], axis=-1)), np.arctan2(x, np.maximum(z, 1e-8)) / (2 * np.pi) + 0.5, np.arcsin(np.clip(y, -1, 1)) / np.pi + 0.5


def _sampled(a: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return K.remap(a, v * (a.shape[0] - 1), u * (a.shape[1] - 1))


def lit_sphere(albedo: np.ndarray, normal: np.ndarray | None = None, roughness: np.ndarray | None = None, metalness: np.ndarray | None = None, side: int = 64) -> np.ndarray:
    """Panels side by side, one for each light: microfacets by GGX, Fresnel by Schlick, geometry by Schlick and Smith; what
    is reflected is not scattered. Missing maps: smooth surface, roughness a half, no metal."""
    inside, n, u, v = sphere(side)
    colour = K.to_linear(_sampled(albedo, u, v))
    rough = _sampled(roughness, u, v) if roughness is not None else np.full((side, side), 0.5)
    metal = (_sampled(metalness, u, v) if metalness is not None else np.zeros((side, side)))[..., None]
    if normal is not None:
        t = np.cross(np.array([0.0, 1.0, 0.0]), n)
        pole = (t * t).sum(-1) < 1e-12
        t[pole] = np.cross(np.array([1.0, 0.0, 0.0]), n[pole])
        t = _unit(t)
        d = _sampled(normal, u, v) * 2 - 1
        n = _unit(t * d[..., :1] + np.cross(n, t) * d[..., 1:2] + n * d[..., 2:3])
    base = DIELECTRIC * (1 - metal) + colour * metal
    a2 = np.maximum(rough * rough, 0.001) ** 2
    k = (rough + 1) ** 2 / 8
    eye = np.array([0.0, 0.0, 1.0])
    facing = np.maximum(n @ eye, 1e-4)
    panels = []
    for light in _unit(LIGHTS):
        half = _unit(light + eye)
        shine, peak = np.maximum(n @ light, 0), np.maximum(n @ half, 0)
        spread = a2 / (np.pi * (peak * peak * (a2 - 1) + 1) ** 2)
        masked = facing / (facing * (1 - k) + k) * (shine / np.maximum(shine * (1 - k) + k, 1e-8))
        fresnel = base + (1 - base) * (1 - max(float(half @ eye), 0.0)) ** 5
        mirror = fresnel * (spread * masked / np.maximum(4 * facing * shine, 1e-4))[..., None]
        out = ((1 - fresnel) * (1 - metal) * colour / np.pi + mirror) * shine[..., None] * np.pi + 0.03 * colour
        panels.append(np.where(inside[..., None], K.to_srgb(out), 0))
    return np.concatenate(panels, axis=1)


def side_by_side(before: np.ndarray, after: np.ndarray, gap: int = 2) -> np.ndarray:
    """Before, enlarged to the size of after, a white gap, after."""
    h, w = after.shape[:2]
    return np.concatenate([K.resize(before, h, w, "nearest"), np.ones((h, gap, after.shape[2])), after], axis=1)


def heat(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mean absolute difference of each pixel, from black over red to white."""
    h, w = after.shape[:2]
    d = np.clip(np.abs((before if before.shape[:2] == (h, w) else K.resize(before, h, w, "linear")) - after).mean(-1) * 3, 0, 3)
    return np.stack([np.clip(d - k, 0, 1) for k in range(3)], axis=-1)
