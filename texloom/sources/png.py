"""PNG in numpy and zlib: 8 and 16 bits, gray, gray-alpha, RGB, RGBA and palette; no interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def probe(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, channels and bit depth from the first 33 bytes."""
    if data[:8] != SIGNATURE or len(data) < 26:
        raise ValueError("not a PNG file")
    w, h, depth, colour = struct.unpack_from(">IIBB", data, 16)
    return w, h, CHANNELS[colour], depth


def decode(data: bytes) -> np.ndarray:
    """Float64 in [0, 1], height x width x channels."""
    w, h, n, depth = probe(data)
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in chunks(data):
        parts.setdefault(kind, []).append(body)
    header = parts[b"IHDR"][0]
    if depth not in (8, 16) or header[12]:
        raise ValueError("only 8 and 16 bits without interlacing")
    step = n * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.int64)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 1:
            line = line.reshape(w, step).cumsum(0).ravel() % 256
        elif rule == 2:
            line = (line + above) % 256
        elif rule in (3, 4):
            cells, top = line.reshape(w, step), above.reshape(w, step)
            left = corner = np.zeros(step, np.int64)
            for x in range(w):
                if rule == 3:
                    guess = (left + top[x]) // 2
                else:
                    p = left + top[x] - corner
                    a, b, c = np.abs(p - left), np.abs(p - top[x]), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, top[x], corner))
                corner = top[x]
                left = cells[x] = (cells[x] + guess) % 256
            line = cells.ravel()
        out[y] = above = line
    cells = out.astype(np.uint8).reshape(h, w, step)
    if header[9] == 3:
        palette = np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)
        return palette[cells[..., 0]] / 255.0
    if depth == 16:
        return cells.reshape(h, w, n, 2).astype(np.int64) @ np.array([256, 1]) / 65535.0
    return cells / 255.0


def encode(a: np.ndarray, bits: int = 8) -> bytes:
    """Clipped to [0, 1] and rounded half to even."""
    a = a[..., None] if a.ndim == 2 else a
    h, w, n = a.shape
    top = (1 << bits) - 1
    cells = np.rint(np.clip(np.nan_to_num(a), 0, 1) * top).astype(">u2" if bits == 16 else "u1")
    lines = np.frombuffer(cells.tobytes(), np.uint8).reshape(h, -1)
    body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes(), 6)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
