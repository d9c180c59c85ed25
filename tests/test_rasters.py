"""Kernels, derived maps, PNG and containers: closed forms and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.functions import kernels as K
from texloom.operators import containers as B
from texloom.operators import phases as H
from texloom.operators import state
from texloom.sources import files, png

RNG = np.random.default_rng(3)


def test_colour_round_trip():
    v = np.linspace(0, 1, 101)
    assert np.allclose(K.to_srgb(K.to_linear(v)), v, atol=1e-6)
    assert K.to_linear(np.array([np.nan]))[0] == 0


def test_filters_against_brute_force():
    a = RNG.random((9, 11))
    p = np.pad(a, 1, mode="symmetric")
    box = np.array([[p[y : y + 3, x : x + 3].mean() for x in range(11)] for y in range(9)])
    assert np.allclose(K.box(a, 3), box)
    p = np.pad(a, 1, mode="reflect")
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    sx = np.array([[(p[y : y + 3, x : x + 3] * k).sum() for x in range(11)] for y in range(9)])
    assert np.allclose(K.sobel(a, 1), sx) and np.allclose(K.sobel(a.T, 0), sx.T)
    assert np.allclose(K.gaussian(np.full((6, 6), 0.3), 2.0), 0.3)
    assert np.allclose(K.bilateral(np.full((6, 6), 0.3), 5, 0.2, 9), 0.3)


def test_resize_keeps_constants_and_area_means():
    a = RNG.random((8, 8, 3))
    for m in ("nearest", "linear", "cubic", "lanczos", "area"):
        assert np.allclose(K.resize(np.full((8, 6), 0.4), 5, 9, m), 0.4)
    assert np.allclose(K.resize(a, 4, 4, "area"), a.reshape(4, 2, 4, 2, 3).mean((1, 3)))


def test_components_and_tiles():
    m = np.zeros((8, 8))
    m[0, 0] = m[1, 1] = m[6, 6] = 1
    assert K.large_areas(m, 2).sum() == 2
    a = RNG.random((13, 10))
    assert np.allclose(K.merged(K.tiles(a, 6, 4), 13, 10), a)


@pytest.mark.parametrize("h, w", [(64, 64), (128, 64), (100, 80)])
def test_wrap_pad_round_trip(h, w):
    a = RNG.random((h, w))
    p, pad = K.wrap_pad(a)
    big = np.repeat(np.repeat(p, 4, 0), 4, 1)
    assert np.array_equal(K.cropped(big, pad, h, w, 4)[::4, ::4], a)


def test_normals():
    assert np.allclose(H.normals(np.full((16, 16), 0.5))[4:-4, 4:-4], [0.5, 0.5, 1.0])
    n = RNG.random((8, 8, 3))
    n[2, 2] = np.nan
    d = H.repaired(n) * 2 - 1
    assert np.isfinite(d).all() and np.allclose(np.sqrt((d * d).sum(-1)), 1) and (d[..., 2] >= 0).all()
    flat = np.broadcast_to([0.5, 0.5, 1.0], (32, 32, 3))
    assert K.height_from_normals(flat).std() < 0.05
    assert np.allclose(H.blended(flat, flat), flat)


def test_pbr_orderings():
    noisy, flat = np.clip(0.5 + RNG.normal(0, 0.2, (64, 64, 3)), 0, 1), np.full((64, 64, 3), 0.5)
    assert H.roughness(noisy, "default").mean() > H.roughness(flat, "default").mean() + 0.03
    brown = np.broadcast_to([0.5, 0.35, 0.2], (48, 48, 3))
    assert H.metalness(brown, "metal").mean() > H.metalness(brown, "wood").mean() + 0.2
    cavity = np.full((96, 96, 3), 0.8)
    cavity[30:66, 30:66] = 0.2
    ao = H.occlusion(cavity)
    assert ao[30:66, 30:66].mean() < ao[:8].mean()
    seam = np.full((64, 64, 3), 0.5)
    seam[:, 0], seam[:, -1] = 0, 1
    fixed = H.seam_repaired(seam)
    assert np.abs(fixed[:, 0] - fixed[:, -1]).mean() < 0.3
    patch = np.zeros((64, 64, 3))
    patch[20:44, 20:44, :2] = (1.0, 0.9)
    assert H.emissive(patch).mean() > 0.02


def test_mips():
    check = np.zeros((2, 2, 3))
    check[0, 0] = check[1, 1] = 1
    assert np.allclose(H.mip(np.full((16, 16), 0.3), 1, 1, "roughness", 4), np.sqrt(0.09 + 0.04 * 15))
    assert abs(K.to_srgb(K.resize(K.to_linear(check), 1, 1, "area")).mean() - K.to_srgb(np.array([0.5]))[0]) < 0.02


@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(bits, channels):
    top = (1 << bits) - 1
    a = RNG.integers(0, top + 1, (7, 5, channels)) / top
    data = png.encode(a, bits)
    assert png.probe(data) == (5, 7, channels, bits)
    assert np.allclose(png.decode(data), a)


def test_png_filters():
    import struct
    import zlib

    a = RNG.integers(0, 256, (5, 4, 3))
    lines, above = b"", np.zeros(12, int)
    for y, rule in enumerate((0, 1, 2, 3, 4)):
        row = a[y].ravel()
        left, corner = np.r_[np.zeros(3, int), row[:-3]], np.r_[np.zeros(3, int), above[:-3]]
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        guess = (0 * row, left, above, (left + above) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner)))[rule]
        lines += bytes([rule]) + bytes(((row - guess) % 256).tolist())
        above = row
    data = png.encode(a / 255)
    at = data.index(b"IDAT") - 4
    body = zlib.compress(lines)
    data = data[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + data[-12:]
    assert np.allclose(png.decode(data) * 255, a)


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    opaque = np.ones((16, 16, 4))
    clear = opaque.copy()
    clear[0, 0, 3] = 0
    for name, a in (("brick_diff.png", RNG.random((64, 32, 3))), ("sub/metal_normal.png", opaque), ("wood_gloss.png", clear)):
        (tmp_path / name).write_bytes(png.encode(a))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    rows = {r["filepath"]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"brick_diff.png", "sub/metal_normal.png", "wood_gloss.png"}
    assert (rows["brick_diff.png"]["original_width"], rows["brick_diff.png"]["texture_type"], rows["brick_diff.png"]["material_category"]) == (32, "diffuse", "brick")
    assert not rows["sub/metal_normal.png"]["has_alpha"] and rows["wood_gloss.png"]["has_alpha"] and rows["wood_gloss.png"]["is_gloss"]
    assert files.scan(spark, str(tmp_path), max_pixels=10).count() == 0


def test_manifest(spark, tmp_path):
    head = "filepath,filename,texture_type,original_width,original_height,channels,has_alpha,is_tileable,is_hero,material_category,file_size_kb,file_hash,future_field"
    (tmp_path / "m.csv").write_text(head + "\na.png,a.png,diffuse,8,8,3,yes,1,off,brick,1.5,abc,zzz\n")
    r = files.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r["has_alpha"], r["is_tileable"], r["is_hero"], r["is_gloss"], r["status"], r["original_width"]) == (True, True, False, False, "pending", 8)
    (tmp_path / "bad.csv").write_text(head + "\na.png,a.png,diffuse,NOT_INT,8,3,yes,1,off,brick,1.5,abc,zzz\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_manifest(spark, str(tmp_path / "bad.csv")).collect()


def test_state(spark):
    assets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "asset_id long, hash string")
    done = spark.createDataFrame([(1, "a", "pbr", "f"), (2, "old", "pbr", "f"), (3, "c", "pbr", "other")], "asset_id long, hash string, phase string, fingerprint string")
    left = {(r["asset_id"], r["phase"]) for r in state.pending(assets, done, ("pbr", "pom"), "f").collect()}
    assert left == {(1, "pom"), (2, "pbr"), (2, "pom"), (3, "pbr"), (3, "pom")}
    assert len(state.fingerprint({"b": 1, "a": 2})) == 16 and state.fingerprint({"b": 1, "a": 2}) == state.fingerprint({"a": 2, "b": 1})


def test_checkpoint(spark, tmp_path):
    import json

    good = {"config_fingerprint": "f", "last_saved": "t", "completed": {"a.png": {"hash": "h", "phases": ["pbr", "pom"], "results": {}}}}
    (tmp_path / "c.json").write_text(json.dumps(good, indent=1))
    read = lambda mark: files.read_checkpoint(spark, str(tmp_path / "c.json"), mark).count()
    assert read("f") == 2 and read("g") == 0
    (tmp_path / "c.json").write_text("{broken")
    assert read("f") == 0


def test_cube():
    text = "TITLE x\nLUT_3D_SIZE 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    cube, lo, hi = files.parse_cube(text)
    rgb = RNG.random((4, 4, 3))
    assert np.allclose(K.lut_trilinear(rgb, cube, lo, hi), rgb)
    with pytest.raises(ValueError):
        files.parse_cube("LUT_3D_SIZE 2\n0 0 0")


def test_dds(spark):
    head = bytearray(128)
    head[:4] = b"DDS "
    for at, v in ((8, 6), (12, 8), (16, 8)):
        head[at : at + 4] = v.to_bytes(4, "little")
    head[84:88] = b"DXT1"
    raw = bytes(head) + b"x" * 32
    df = spark.createDataFrame([(raw,), (b"DDS " + b"\0" * 124,), (b"",), (None,), (b"JUNK" * 40,)], "raw binary")
    m = F.col("m")
    rows = df.select(B.mended_dds(F.col("raw")).alias("m"), B.dds_issues(F.col("raw")).alias("bad")).select(B.little(m, 4), B.little(m, 20), B.little(m, 28), "bad", "m").collect()
    assert tuple(rows[0][:3]) == (124, 32, 1) and rows[0]["m"][128:] == raw[128:]
    assert {"dds_header", "dds_pixel_format"} <= set(rows[1]["bad"]) and rows[2]["bad"] == ["non_zero_size"] and rows[4]["bad"] == ["magic_bytes"]
    levels = [(1, (0x200).to_bytes(4, "little"))]
    del levels
    one = spark.createDataFrame([([(1, raw[:128] + b"b"), (0, raw[:128] + b"aaaa")],)], "levels array<struct<level:int,raw:binary>>")
    chain = one.select(B.mip_chain(F.col("levels")).alias("c")).first()["c"]
    assert chain[128:] == b"aaaab" and int.from_bytes(chain[28:32], "little") == 2
    u = spark.createDataFrame([(bytes.fromhex("FF01E280"),)], "raw binary").select(B.little(F.col("raw"), 0), B.little(F.col("raw"), 2)).first()
    assert tuple(u) == (2162295295, 0)


def test_stream(spark, tmp_path):
    from texloom.streaming import incremental

    (tmp_path / "in").mkdir()
    run = lambda: incremental.catalogue(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/brick_diff.png").write_bytes(b"1")
    run()
    (tmp_path / "in/iron_n.png").write_bytes(b"2")
    run()
    rows = {(r["texture_type"], r["material"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("diffuse", "brick"), ("normal", "iron")}
