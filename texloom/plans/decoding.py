"""Queries on image files: policies of reading, round trips through every writer, checks of outputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.functions import images as I
from texloom.functions import rasters as P
from texloom.functions import tables as T
from texloom.operators import validation as R
from texloom.plans import views as V
from texloom.plans.pixels import r6
from texloom.plans.registry import query
from texloom.plans.validation import _list, _pick
from texloom.sources import images

MODES, EXTS = ("1", "L", "LA", "P", "RGB", "RGBA", "CMYK", "I", "F", "I;16", "I;16B"), (".png", ".TIF", ".tiff", ".bmp")
IMAGE_SQL = f"""WITH i AS (SELECT p_partkey AS k, {_list(MODES, 'p_partkey % 11')} AS mode, {_list(EXTS, '(p_partkey // 11) % 4')} AS ext, CASE p_partkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 0 WHEN 3 THEN 12 END AS bits,
  CASE p_partkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 END AS tag, CASE WHEN p_partkey % 7 = 0 THEN -1.0 ELSE 0 END::DOUBLE AS lo, CASE WHEN p_partkey % 2 = 0 THEN 200.0 ELSE 1 END::DOUBLE AS hi FROM part) """


@query(IMAGE_SQL + """SELECT k, CAST(CASE WHEN bits > 0 THEN bits WHEN tag > 0 THEN tag WHEN lower(ext) IN ('.tif', '.tiff') THEN 16 ELSE 32 END AS INT) AS integer_depth,
  CAST(CASE WHEN mode IN ('1', 'L', 'LA', 'P', 'RGB', 'RGBA', 'CMYK') THEN 8 WHEN mode LIKE 'I;16%' THEN 16 WHEN bits > 0 THEN bits WHEN tag > 0 THEN tag END AS INT) AS content_depth,
  CASE WHEN mode LIKE 'I;16%' THEN 65535.0::DOUBLE WHEN mode = 'I' THEN pow(2.0::DOUBLE, CASE WHEN bits > 0 THEN bits WHEN tag > 0 THEN tag WHEN lower(ext) IN ('.tif', '.tiff') THEN 16 ELSE 32 END) - 1
    WHEN mode = 'F' THEN CASE WHEN coalesce(bits, tag) = 8 AND lo >= 0 AND hi > 1 THEN 255 WHEN coalesce(bits, tag) = 16 AND lo >= 0 AND hi > 1 THEN 65535 ELSE 1 END ELSE 255 END AS divisor, CAST(CASE WHEN mode IN ('LA', 'P', 'RGBA') THEN 4 ELSE 3 END AS INT) AS channels FROM i""")
def decode_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, scale and channels of an image by its mode and metadata."""
    k = F.col("p_partkey")
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("k"), _pick(MODES, k % 11).alias("mode"), _pick(EXTS, F.floor(k / 11) % 4).alias("ext"), F.when(k % 5 == 0, 8).when(k % 5 == 1, 16).when(k % 5 == 2, 0).when(k % 5 == 3, 12).alias("bits"),
        F.when(k % 3 == 0, 16).when(k % 3 == 1, 32).alias("tag"), F.when(k % 7 == 0, -1.0).otherwise(0.0).alias("lo"), F.when(k % 2 == 0, 200.0).otherwise(1.0).alias("hi"),
    )
    mode, bits, tag, ext = (F.col(c) for c in ("mode", "bits", "tag", "ext"))
    return a.select("k", I.integer_depth(bits, tag, ext).cast("int").alias("integer_depth"), I.content_depth(mode, bits, tag).cast("int").alias("content_depth"), I.divisor(mode, bits, tag, ext, F.col("lo"), F.col("hi")).alias("divisor"), I.channels(mode).cast("int").alias("channels"))


_raw = "v * CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 255 WHEN 2 THEN 65535 ELSE 300 END"


@query(f"""WITH {V.RASTERS_SQL}, x AS (SELECT vec_id, unnest(list_transform(v, lambda v: CASE WHEN vec_id % 3 = 0 THEN round({_raw}) ELSE {_raw} END)) AS v FROM v_rasters), m AS (SELECT vec_id, max(v) AS hi FROM x GROUP BY vec_id)
  SELECT vec_id, round(avg(greatest(0.0, least(1.0, v / CASE WHEN vec_id % 3 = 0 THEN CASE vec_id % 5 WHEN 0 THEN 255 WHEN 1 THEN 65535 ELSE 255 END WHEN hi <= 1 THEN 1 WHEN vec_id % 5 = 0 THEN 255 WHEN vec_id % 5 = 1 THEN 65535 WHEN hi <= 255 THEN 255 ELSE 65535 END))), 6) AS mean FROM x JOIN m USING (vec_id) GROUP BY vec_id""")
def content_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values of whole and float images of known and unknown depth brought to [0, 1]."""
    k = F.col("vec_id")
    scale = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 255.0).when(k % 4 == 2, 65535.0).otherwise(300.0)
    a = V.rasters(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.when(k % 3 == 0, F.round(x * scale)).otherwise(x * scale)).alias("v"))
    depth = F.when(k % 5 == 0, 8).when(k % 5 == 1, 16)
    return a.select("vec_id", r6(P.mean(I.content_scaled(F.col("v"), k % 3 == 0, depth, F.lit(255.0))), "mean"))


@query(f"""WITH {V.RGBA_SQL} SELECT vec_id, CASE WHEN vec_id % 5 < 2 THEN 'height' WHEN avg(0.65 + b * 0.3) > 0.7 AND abs(avg(r) - 0.5) < 0.15 AND abs(avg(g) - 0.5) < 0.15 AND stddev_pop(0.65 + b * 0.3) < 0.15 THEN 'normal' ELSE 'diffuse' END AS kind FROM v_rgba GROUP BY vec_id""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by content; images of one channel are height."""
    k = F.col("vec_id")
    ch = [F.filter("v", (lambda c: lambda x, i: i % 4 == c)(c)) for c in range(3)]
    mode = F.when(k % 5 == 0, "L").when(k % 5 == 1, "LA").otherwise("RGBA")
    return V.rasters(spark, sf_dir).select("vec_id", I.content_kind(mode, ch[0], ch[1], F.transform(ch[2], lambda x: 0.65 + x * 0.3)).alias("kind"))


WRITERS = ("png", "tga", "bmp", "tif", "dds")


@query(f"WITH {V.RASTERS_SQL} SELECT vec_id, {_list(WRITERS, 'vec_id % 5')} AS format, CAST(i - 1 AS BIGINT) AS p, round(round_even(v[i] * 255, 0) / 255, 6) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM v_rasters)")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written in each format and read back: clipped, rounded half to even, channels and order kept."""
    a = V.rasters(spark, sf_dir).select("vec_id", F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(4).alias("channels"), "v")
    files = None
    for k, ext in enumerate(WRITERS):
        one = images.encoded(a.where(F.col("vec_id") % 5 == k), ext, keep=("vec_id",)).select(F.concat(F.col("vec_id").cast("string"), F.lit(f".{ext}")).alias("filepath"), "content")
        files = one if files is None else files.unionByName(one)
    got = images.decoded(files)
    name = F.split("filepath", r"\.")
    got = got.select(name[0].cast("long").alias("vec_id"), name[1].alias("format"), F.posexplode("v").alias("p", "x"))
    return got.select("vec_id", "format", F.col("p").cast("long").alias("p"), r6(F.col("x"), "value"))


@query(f"""WITH {V.RASTERS_SQL} SELECT vec_id, i AS p, round(v[i * 4 + 1], 6) AS red, round(v[i * 4 + 4], 6) AS alpha, round(CASE WHEN vec_id % 2 = 0 THEN v[i * 4 + 4] ELSE v[(15 - i) * 4 + 4] END, 6) AS merged FROM (SELECT *, unnest(range(16)) AS i FROM v_rasters)""")
def alpha_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour and alpha taken apart and joined; here every second raster takes its alpha reversed."""
    k, four = F.col("vec_id"), F.lit(4)
    a = V.rasters(spark, sf_dir).select("vec_id", images.rgb(F.col("v"), four).alias("rgb"), images.alpha(F.col("v"), four).alias("alpha"))
    a = a.withColumn("m", images.with_alpha(F.col("rgb"), F.when(k % 2 == 0, F.col("alpha")).otherwise(F.reverse("alpha")))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    at = lambda c, i: F.get(F.col(c), i.cast("int"))
    return a.select("vec_id", "p", r6(at("rgb", F.col("p") * 3), "red"), r6(at("alpha", F.col("p")), "alpha"), r6(at("m", F.col("p") * 4 + 3), "merged"))


def output_image_issues(suffix: Column, name: Column, content: Column, raster: Column, powers: bool = True) -> Column:
    """Checks of an image output, in order: empty, wrong magic, not loadable; then sizes, solid colour, normals.

    ``raster``: struct(height, width, channels, v, error) of the decoded file. Each finding is named once for each side or rule.
    """
    from texloom.operators import containers as B

    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    magic = F.when(ext == "png", B.has_magic(content, "png")).when(ext.isin("jpg", "jpeg"), F.substring(content, 1, 2) == F.lit(b"\xff\xd8")).when(ext == "bmp", B.has_magic(content, "bmp")).otherwise(F.lit(True))
    v, n = raster["v"], raster["channels"]
    at = lambda i, c: F.get(v, i * n + c) * 2.0 - 1.0
    vectors = F.transform(F.sequence(F.lit(0), (F.size(v) / n).cast("int") - 1), lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z")))
    off = lambda u: F.abs(F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"]) - 1.0) > 0.1
    normal = (suffix == "_normal") & (n >= 3)
    rest = [
        ("power_of_two", F.lit(powers) & ~C.is_power(raster["width"])), ("power_of_two", F.lit(powers) & ~C.is_power(raster["height"])), ("solid_color", ~suffix.isin(*T.FLAT_OK_SUFFIXES) & (P.deviation(v) < 0.005)),
        ("normal_integrity", normal & (P.share(vectors, lambda u: u["z"] < 0) > 0.05)), ("normal_integrity", normal & (P.share(vectors, off) > 0.05)),
    ]
    found = F.filter(F.array(*[F.when(t, F.lit(x)) for x, t in rest]), lambda x: x.isNotNull())
    return F.when(F.length(content) == 0, F.array(F.lit("non_zero_size"))).when(~magic, F.array(F.lit("magic_bytes"))).when(raster["error"].isNotNull(), F.array(F.lit("loadable"))).otherwise(found)


SUFFIXES = ("", "_normal", "_roughness", "_albedo")
_q = "round_even(v * CASE WHEN vec_id % 7 = 0 THEN 0.002 ELSE 1 END * 255, 0) / 255"


@query(f"""WITH {V.RASTERS_SQL}, x AS (SELECT vec_id, (vec_id // 3) % 4 AS s, i, {_q} AS v FROM (SELECT vec_id, v[i] AS v, i FROM (SELECT vec_id, v, unnest(range(1, 49)) AS i FROM v_rasters))),
 n AS (SELECT vec_id, avg(CASE WHEN z < 0 THEN 1.0::DOUBLE ELSE 0 END) AS neg, avg(CASE WHEN abs(sqrt(x * x + y * y + z * z) - 1) > 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS off FROM
  (SELECT vec_id, (i - 1) // 3 AS p, max(CASE WHEN (i - 1) % 3 = 0 THEN v * 2 - 1 END) AS x, max(CASE WHEN (i - 1) % 3 = 1 THEN v * 2 - 1 END) AS y, max(CASE WHEN (i - 1) % 3 = 2 THEN v * 2 - 1 END) AS z FROM x WHERE vec_id % 2 = 0 GROUP BY 1, 2
  UNION ALL SELECT vec_id, i, v * 2 - 1, v * 2 - 1, v * 2 - 1 FROM x WHERE vec_id % 2 = 1) GROUP BY 1)
 SELECT vec_id, array_to_string(CASE WHEN vec_id % 11 = 0 THEN ['non_zero_size'] WHEN vec_id % 11 = 1 THEN ['magic_bytes'] WHEN vec_id % 11 = 2 THEN ['loadable'] ELSE list_filter([CASE WHEN vec_id % 2 = 1 THEN 'power_of_two' END, CASE WHEN s != 2 AND sd < 0.005 THEN 'solid_color' END,
  CASE WHEN s = 1 AND neg > 0.05 THEN 'normal_integrity' END, CASE WHEN s = 1 AND off > 0.05 THEN 'normal_integrity' END], lambda x: x IS NOT NULL) END, ',') AS issues FROM (SELECT vec_id, any_value(s) AS s, stddev_pop(v) AS sd FROM x GROUP BY 1) JOIN n USING (vec_id)""")
def output_image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG outputs as bytes: some empty, foreign, cut short, solid or of odd sizes."""
    k = F.col("vec_id")
    dim = F.when(k % 7 == 0, 0.002).otherwise(1.0)
    side = lambda odd, even: F.when(k % 2 == 1, odd).otherwise(even)
    a = V.rasters(spark, sf_dir).select("vec_id", side(3, 4).alias("height"), side(16, 4).alias("width"), side(1, 3).alias("channels"), F.transform(F.slice("v", 1, 48), lambda x: x * dim).alias("v"))
    png = images.encoded(a, "png", keep=("vec_id",))
    content = F.when(k % 11 == 0, F.lit(b"")).when(k % 11 == 1, F.lit(b"\xff\xd8\xff\xe0 no")).when(k % 11 == 2, F.substr("content", F.lit(1), F.lit(40))).otherwise(F.col("content"))
    files = png.select("vec_id", _pick(SUFFIXES, F.floor(k / 3) % 4).alias("suffix"), F.concat(k.cast("string"), F.lit(".png")).alias("filepath"), content.alias("content"))
    rows = files.join(images.decoded(files), "filepath")
    raster = F.struct("height", "width", "channels", "v", "error")
    return rows.select("vec_id", F.array_join(output_image_issues(F.col("suffix"), F.col("filepath"), F.col("content"), raster), ",").alias("issues"))
