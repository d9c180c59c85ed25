"""Image formats against closed forms and round trips, checkpoints, grading against its numpy twin."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from texloom.functions import colour as G
from texloom.functions import kernels as K
from texloom.operators import phases as H
from texloom.operators import runs, validation
from texloom.sources import files, images

RNG = np.random.default_rng(11)


@pytest.mark.parametrize("ext", ["png", "tga", "bmp", "tif", "dds"])
@pytest.mark.parametrize("n", [1, 3, 4])
def test_round_trip(ext, n):
    a = RNG.random((5, 7, n))
    data = images.encode(a, ext)
    head, got = images.probe(data, f"x.{ext}"), images.decode(data, f"x.{ext}")
    assert (head.width, head.height) == (7, 5)
    want = np.rint(a * 255) / 255
    assert np.allclose(got[..., :3], np.repeat(want, 3, axis=2) if n == 1 else want[..., :3]) and (n < 4 or np.allclose(got[..., 3], want[..., 3]))


def test_sixteen_bits_in_png_only():
    a = RNG.random((4, 4, 3))
    assert np.allclose(images.decode(images.encode(a, "png", 16)), np.rint(a * 65535) / 65535)
    with pytest.raises(ValueError):
        images.encode(a, "tga", 16)
    with pytest.raises(ValueError):
        images.encode(a, "jpg")


def test_run_length_tga():
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 3, 2, 24, 0)
    body = bytes([0x82, 1, 2, 3]) + bytes([0x01, 4, 5, 6, 7, 8, 9]) + bytes([0x80, 10, 11, 12])
    got = images.decode(head + body, "a.tga") * 255
    assert np.allclose(got[1], [[3, 2, 1]] * 3) and np.allclose(got[0], [[6, 5, 4], [9, 8, 7], [12, 11, 10]])


def test_big_endian_and_float_tiff():
    def tiff(order, cells, bits, sample):
        data = cells.tobytes()
        tags = [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, bits), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, len(data)), (339, 3, 1, sample)]
        pack = lambda t: struct.pack(order + "HHI", *t[:3]) + (struct.pack(order + "HH", t[3], 0) if t[1] == 3 else struct.pack(order + "I", t[3]))
        return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(data)) + data + struct.pack(order + "H", len(tags)) + b"".join(map(pack, tags)) + b"\0" * 4

    whole = np.array([[0, 65535], [32768, 1]])
    assert np.allclose(images.decode(tiff(">", whole.astype(">u2"), 16, 1))[..., 0], whole / 65535)
    floats = np.array([[-1.5, 0.25], [7.0, 1.0]])
    assert np.allclose(images.decode(tiff("<", floats.astype("<f4"), 32, 3))[..., 1], floats)


def test_block_codecs():
    def dds(code, body):
        return struct.pack("<4s7I44x2I4s5I5I", b"DDS ", 124, 0x1007, 4, 4, 0, 0, 1, 32, 4, code, 0, 0, 0, 0, 0, 0x1000, 0, 0, 0, 0) + body

    red_blue = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)
    got = images.decode(dds(b"DXT1", red_blue))
    assert np.allclose(got[0], [[1, 0, 0], [0, 0, 1], [2 / 3, 0, 1 / 3], [1 / 3, 0, 2 / 3]]) and np.allclose(got[1:], [1, 0, 0])
    ramp = bytes([255, 0]) + (0o76543210).to_bytes(6, "little")
    assert np.allclose(images.decode(dds(b"ATI1", ramp))[0, :, 0], [1, 0, 6 / 7, 5 / 7])
    both = images.decode(dds(b"DXT5", ramp + red_blue))
    assert both.shape == (4, 4, 4) and np.allclose(both[0, :, 3], [1, 0, 6 / 7, 5 / 7])
    with pytest.raises(ValueError):
        images.decode(dds(b"BC7X", b"\0" * 16))


def test_scan_and_read_of_many_formats(spark, tmp_path):
    a = RNG.random((8, 8, 4)) * 0.5
    for ext in ("png", "tga", "bmp", "tif", "dds"):
        (tmp_path / f"brick_diff.{ext}").write_bytes(images.encode(a[..., : 3 if ext == "bmp" else 4], ext))
    (tmp_path / "broken_diff.png").write_bytes(b"\x89PNG\r\n\x1a\n no")
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            picture.setRGB(x, y, 0xFF8040)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "wall_diff.jpg")))
    rows = {r["filename"]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"brick_diff.png", "brick_diff.tga", "brick_diff.bmp", "brick_diff.tif", "brick_diff.dds", "wall_diff.jpg"}
    assert (rows["wall_diff.jpg"]["original_width"], rows["wall_diff.jpg"]["channels"], rows["wall_diff.jpg"]["has_alpha"]) == (16, 3, False)
    assert rows["brick_diff.tga"]["has_alpha"] and not rows["brick_diff.bmp"]["has_alpha"] and len(rows["brick_diff.png"]["file_hash"]) == 64
    got = {r["filepath"].rsplit("/", 1)[-1]: r for r in images.read_rasters(spark, str(tmp_path)).collect()}
    assert got["broken_diff.png"]["error"] and got["broken_diff.png"]["v"] is None
    assert np.allclose(got["brick_diff.tif"]["v"], (np.rint(a * 255) / 255).ravel())
    jpeg = np.array(got["wall_diff.jpg"]["v"]).reshape(8, 16, 3)
    assert np.allclose(jpeg, np.array([0xFF, 0x80, 0x40]) / 255, atol=0.03)


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a/x.png", b"one"), ("y.png", b"two")], "filepath string, content binary")
    images.write_files(df, str(tmp_path))
    images.write_files(df, str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"a/x.png": b"one", "y.png": b"two"}


def test_checkpoint_round_trip(spark, tmp_path):
    rows = [("a.png", "h1", "pbr", "f"), ("a.png", "h1", "normal", "f"), ("b.png", "h2", "pbr", "f"), ("c.png", "h3", "pbr", "old")]
    files.write_checkpoint(spark.createDataFrame(rows, "filepath string, hash string, phase string, fingerprint string"), str(tmp_path / "c"))
    (tmp_path / "c" / "junk.txt").write_text("{not json\n")
    assert sorted(map(tuple, files.read_checkpoint(spark, str(tmp_path / "c"), "f", lines=True).collect())) == sorted(rows[:3])


def test_manifest_round_trip(spark, tmp_path):
    kinds = [c.strip().split(" ") for c in files.MANIFEST.split(",")]
    row = {n: {"int": 4, "double": 1.5}.get(k, "true" if n in files.FLAGS else "x") for n, k in kinds}
    files.write_manifest(spark.createDataFrame([row]), str(tmp_path / "m"))
    got = files.read_manifest(spark, str(tmp_path / "m")).first().asDict()
    assert got == {**row, **{f: True for f in files.FLAGS}}


def test_grading_twins(spark):
    s = G.Grading(white_balance=0.2, exposure=0.3, gamma=1.1, saturation=0.9, exposure_by={"wood": -0.2}, gamma_by={"default": 1.3})
    px = RNG.random((6, 3))
    df = spark.createDataFrame([(float(r), float(g), float(b), m) for (r, g, b) in px for m in ("wood", " Gold ", "")], "r double, g double, b double, m string")
    got = [x[0] for x in df.select(G.graded(*(F.col(c) for c in "rgbm"), s)).collect()]
    want = [H.graded(p[None, None, :], m, s)[0, 0] for p in px for m in ("wood", " Gold ", "")]
    assert np.allclose(got, want, atol=1e-9)


def test_grading_with_table_noise_and_sharpness():
    rgb = np.clip(0.5 + 0.1 * RNG.standard_normal((24, 24, 3)), 0, 1)
    cube = np.stack(np.meshgrid(*[np.linspace(0, 1, 3)] * 3, indexing="ij")[::-1], axis=-1)
    same = H.graded(rgb, "wood", G.Grading(lut_strength=1.0, clamp=None), (cube, np.zeros(3), np.ones(3)))
    assert np.allclose(same, rgb, atol=1e-6)
    assert H.graded(rgb, "wood", G.Grading(denoise=1.0)).std() < H.graded(rgb, "wood", G.Grading()).std() < H.graded(rgb, "wood", G.Grading(sharpen=1.0)).std()


def test_lab_round_trips(spark):
    px = RNG.random((20, 3))
    assert np.allclose(K.from_lab(K.lab(px)), px, atol=1e-6)
    df = spark.createDataFrame([tuple(map(float, p)) for p in px], "r double, g double, b double").withColumn("lab", G.to_lab(F.col("r"), F.col("g"), F.col("b")))
    rows = df.select("lab", G.from_lab(F.col("lab")).alias("back")).collect()
    assert np.allclose([r["back"] for r in rows], px, atol=1e-4)
    assert np.allclose([tuple(r["lab"]) for r in rows], K.lab(px) * [2.55, 1, 1] + [0, 128, 128], atol=1e-6)
    assert np.allclose(H.delighted_lab(np.full((16, 16, 3), 0.4)), 0.4, atol=1e-6)


def test_layouts():
    assert G.layout_of("unity_mas") == ("metalness", "ao", "smoothness", "none") and G.layout_of("", {"A": "Gloss"}) == ("ao", "roughness", "metalness", "gloss")
    with pytest.raises(ValueError):
        G.layout_of("custom", {"r": "nonsense"})


def test_derive_refuses_other_sizes(spark):
    df = spark.createDataFrame([(1, [0.0] * 5, "wood")], "vec_id long, v array<double>, material string")
    with pytest.raises(Exception, match="values where 4"):
        H.derive(df, lambda a, m: {"x": a}, 2, 2, 1, ("x",)).collect()


def test_running_failures_do_not_depend_on_spans(spark):
    rows = [("p" if k % 3 else "q", int(RNG.integers(0, 40)), k, bool(RNG.random() < 0.3)) for k in range(500)]
    df = spark.createDataFrame(rows, "phase string, ts long, event_id long, failed boolean")
    one, many = (sorted(map(tuple, runs.running_failures(df, spans=s).select("phase", "event_id", "processed", "failures", "stop", "save").collect())) for s in (1, 16))
    assert one == many


def test_lists_are_joined_in_order(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "c", "c", "b"])], "x array<string>, y array<string>")
    assert df.select(validation.added(F.col("x"), F.col("y"))).first()[0] == ["b", "a", "c"]


def test_spheres_are_lit_from_their_lights():
    from texloom.operators import previews

    grey = np.full((8, 8, 3), 0.5)
    panels = previews.lit_sphere(grey, side=33)
    assert panels.shape == (33, 132, 3) and (panels >= 0).all() and (panels <= 1).all() and (panels[0, 0] == 0).all()
    right, left = panels[:, :33].mean(-1), panels[:, 33:66].mean(-1)
    assert right[:, 17:].mean() > right[:, :16].mean() and left[:, :16].mean() > left[:, 17:].mean()
    flat = previews.lit_sphere(grey, normal=np.full((8, 8, 3), [0.5, 0.5, 1.0]), side=33)
    assert np.allclose(flat, panels, atol=1e-6)
    assert previews.lit_sphere(grey, roughness=np.full((8, 8), 0.1), side=33).max() > previews.lit_sphere(grey, roughness=np.ones((8, 8)), side=33).max()
    assert (previews.heat(grey, grey) == 0).all() and previews.side_by_side(np.zeros((2, 2, 3)), grey).shape == (8, 18, 3)


def test_runs_are_cut_short(spark):
    import threading

    assert runs.guarded(spark, lambda: spark.range(10).count(), seconds=60) == 10
    slow = lambda: spark.range(8).select(F.expr("reflect('java.lang.Thread', 'sleep', 4000L)")).collect()
    with pytest.raises(runs.Cancelled):
        runs.guarded(spark, slow, seconds=1)
    stop = threading.Event()
    stop.set()
    with pytest.raises(runs.Cancelled):
        runs.guarded(spark, slow, cancel=stop)
    assert spark.range(5).count() == 5 and runs.progress(spark) == (0, 0)
