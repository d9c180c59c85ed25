"""Queries on colour: Lab statistics and transfer, grading by material, packing layouts, upscaling without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.functions import colour as G
from texloom.functions import rasters as P
from texloom.functions import tables as T
from texloom.plans import views as V
from texloom.plans.catalogue import MATERIAL_SQL, TYPE_SQL, WITH
from texloom.plans.pixels import LIN, LUM, SRGB, r6
from texloom.plans.registry import query
from texloom.plans.validation import _list, _pick

RGBA = f"WITH {V.RGBA_SQL}"
KINDS, MATERIALS = ("diffuse", "albedo", "unknown", "normal", "ui"), ("wood", "metal", "gold")
_f = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16 / 116::DOUBLE END"
_back = lambda t: f"CASE WHEN {t} * {t} * {t} > 0.008856 THEN {t} * {t} * {t} ELSE ({t} - 16 / 116::DOUBLE) / 7.787 END"
_unit = lambda t: f"greatest(0.0, least(1.0, {t}))"
LAB_SQL = f"""v_xyz AS (SELECT vec_id, p, (0.412453 * lr + 0.35758 * lg + 0.180423 * lb) / 0.950456 AS x, 0.212671 * lr + 0.71516 * lg + 0.072169 * lb AS y, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM (SELECT vec_id, p, {LIN('r')} AS lr, {LIN('g')} AS lg, {LIN('b')} AS lb FROM v_rgba)),
 v_lab AS (SELECT vec_id, p, (116 * fy - 16) * 2.55 AS l, 500 * (fx - fy) + 128 AS a, 200 * (fy - fz) + 128 AS b FROM (SELECT vec_id, p, {_f('x')} AS fx, {_f('y')} AS fy, {_f('z')} AS fz FROM v_xyz)),
 v_one AS (SELECT vec_id, {_list(MATERIALS, 'vec_id % 3')} AS grp, {_list(KINDS, 'vec_id % 5')} AS kind, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb, stddev_pop(l) AS sl, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM v_lab GROUP BY vec_id),
 v_ref AS (SELECT grp, count(*) AS n, median(ml) AS ml, median(ma) AS ma, median(mb) AS mb, median(sl) AS sl, median(sa) AS sa, median(sb) AS sb FROM v_one WHERE kind IN ('diffuse', 'albedo', 'unknown') GROUP BY grp HAVING count(*) >= 2)"""


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grp, kind, lab (array of struct), m and s (structs of means and deviations)."""
    at = lambda i, c: F.get(F.col("v"), i * 4 + c)
    k = F.col("vec_id")
    a = V.rasters(spark, sf_dir).select("vec_id", _pick(MATERIALS, k % 3).alias("grp"), _pick(KINDS, k % 5).alias("kind"), P.pixels(16, lambda i: G.to_lab(at(i, 0), at(i, 1), at(i, 2))).alias("lab"))
    part = lambda c: F.transform("lab", lambda x: x[c])
    return a.select("*", F.struct(*[P.mean(part(c)).alias(c) for c in "lab"]).alias("m"), F.struct(*[P.deviation(part(c)).alias(c) for c in "lab"]).alias("s"))


def _reference(rows: DataFrame) -> DataFrame:
    """Medians over the images of a group; groups of one image have none. What is grouped is six numbers an image, no pixels."""
    rows = rows.where(F.col("kind").isin("diffuse", "albedo", "unknown"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.median(f"{x}.{c}").alias(f"{x}{c}") for x in "ms" for c in "lab"]).where("n >= 2")


@query(f"{RGBA}, {LAB_SQL} SELECT grp, n, " + ", ".join(f"round({x}{c}, 5) AS {x}{c}" for x in "ms" for c in "lab") + " FROM v_ref")
def lab_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab statistics of each material's colour maps."""
    return _reference(_lab(spark, sf_dir)).select("grp", "n", *[F.round(f"{x}{c}", 5).alias(f"{x}{c}") for x in "ms" for c in "lab"])


_moved = lambda c: f"greatest(0.0, least(255.0, {c}1 * 0.65 + 0.35 * CASE WHEN s{c} > 1e-6 THEN ({c}1 - m{c}) * greatest(0.5, least(1.5, rs{c} / greatest(s{c}, 1e-6))) + rm{c} ELSE {c}1 END))"


@query(f"""{RGBA}, {LAB_SQL}, v_moved AS (SELECT vec_id, p, {', '.join(f'{_moved(c)} AS {c}' for c in 'lab')} FROM (SELECT t.vec_id, t.p, t.l AS l1, t.a AS a1, t.b AS b1, o.ml, o.ma, o.mb, o.sl, o.sa, o.sb, r.ml AS rml, r.ma AS rma, r.mb AS rmb, r.sl AS rsl, r.sa AS rsa, r.sb AS rsb FROM v_lab t JOIN v_one o USING (vec_id) JOIN v_ref r USING (grp))),
 v_f AS (SELECT vec_id, p, fy + (a - 128) / 500 AS fx, fy, fy - (b - 128) / 200 AS fz FROM (SELECT *, (l / 2.55 + 16) / 116 AS fy FROM v_moved)), v_b AS (SELECT vec_id, p, ({_back('fx')}) * 0.950456 AS x, {_back('fy')} AS y, ({_back('fz')}) * 1.088754 AS z FROM v_f),
 v_c AS (SELECT vec_id, p, {_unit('3.240479 * x - 1.53715 * y - 0.498535 * z')} AS r, {_unit('-0.969256 * x + 1.875991 * y + 0.041556 * z')} AS g, {_unit('0.055648 * x - 0.204043 * y + 1.057311 * z')} AS b FROM v_b)
 SELECT vec_id, p, round({SRGB('r')}, 5) AS r, round({SRGB('g')}, 5) AS g, round({SRGB('b')}, 5) AS b FROM v_c""")
def lab_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours moved towards their material's reference in Lab. Groups are few (materials), so theirs is the small side."""
    rows = _lab(spark, sf_dir)
    ref = _reference(rows).select("grp", *[F.struct(*[F.col(f"{x}{c}").alias(c) for c in "lab"]).alias(f"r{x}") for x in "ms"])
    a = rows.join(ref, "grp").select("vec_id", F.posexplode(F.transform("lab", lambda x: G.from_lab(G.transferred(x, F.col("m"), F.col("s"), F.col("rm"), F.col("rs"))))).alias("p", "c"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), *[F.round(F.col("c")[k], 5).alias(n) for k, n in enumerate("rgb")])


GRADING = G.Grading(
    white_balance=0.25, exposure=0.5, gamma=1.2, saturation=1.1, white_balance_by={"wood": -0.5, "gold": 2.0}, exposure_by={"metal": -1.0, "default": 0.25}, gamma_by={"gold": 0.8}, saturation_by={"default": 0.5, "wood": 1.5},
)
_lit = lambda c, k: f"pow({_unit(f'({LIN(c)}) * ({k}) * pow(2.0::DOUBLE, 0.5 + ev)')}, gm)"
_out = lambda c: f"greatest(0.02, least(0.9, {_unit(f'lu + ({c} - lu) * 1.1 * sa')}))"


@query(f"""{RGBA}, t AS (SELECT *, {_list(MATERIALS, 'vec_id % 3')} AS m, {_list(KINDS, 'vec_id % 5')} AS kind FROM v_rgba), s AS (SELECT *, greatest(-1.0, least(1.0, 0.25 + CASE m WHEN 'wood' THEN -0.5 WHEN 'gold' THEN 2.0 ELSE 0 END))::DOUBLE AS wb,
  (CASE m WHEN 'metal' THEN -1.0 ELSE 0.25 END)::DOUBLE AS ev, (CASE m WHEN 'gold' THEN 0.8 ELSE 1.2 END)::DOUBLE AS gm, (CASE m WHEN 'wood' THEN 1.5 ELSE 0.5 END)::DOUBLE AS sa FROM t WHERE kind IN ('diffuse', 'albedo', 'specular', 'emissive', 'ui', 'unknown')),
 l AS (SELECT vec_id, p, sa, {_lit('r', '1 + 0.18 * wb')} AS r, {_lit('g', '1 - 0.06 * abs(wb)')} AS g, {_lit('b', '1 - 0.18 * wb')} AS b FROM s), o AS (SELECT vec_id, p, {', '.join(f'{_out(c)} AS {c}' for c in 'rgb')} FROM (SELECT *, {LUM()} AS lu FROM l))
 SELECT vec_id, p, round({SRGB('r')}, 6) AS r, round({SRGB('g')}, 6) AS g, round({SRGB('b')}, 6) AS b FROM o""")
def graded_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White balance, exposure, gamma and saturation with values by material, for colour types only."""
    k = F.col("vec_id")
    at = lambda i, c: F.get(F.col("v"), i * 4 + c)
    a = V.rasters(spark, sf_dir).withColumns({"m": _pick(MATERIALS, k % 3), "kind": _pick(KINDS, k % 5)}).where(F.col("kind").isin(*T.GRADED_TYPES))
    a = a.select("vec_id", F.posexplode(P.pixels(16, lambda i: G.graded(at(i, 0), at(i, 1), at(i, 2), F.col("m"), GRADING))).alias("p", "c"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), *[r6(F.col("c")[j], n) for j, n in enumerate("rgb")])


PRESETS = ("unreal_orm", "unity_mas", "source_phong", "idtech_rma", "custom")
_p = "CASE vec_id % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"


@query(f"""{RGBA}, t AS (SELECT vec_id, p, g AS ro, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE b END AS me, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE r END AS ao, CASE WHEN vec_id % 7 = 0 THEN a ELSE 1 - g END AS gl FROM v_rgba WHERE vec_id % 9 > 0)
 SELECT vec_id, p, round({_p.format('ao', 'me', 'ao', 'ro', '1')}, 6) AS r, round({_p.format('ro', 'ao', 'ro', 'me', 'ro')}, 6) AS g, round({_p.format('me', 'gl', 'me', 'ao', 'me')}, 6) AS b, round({_p.format('NULL', 'NULL', 'gl', 'NULL', 'gl')}, 6) AS a FROM t""")
def packed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four presets and a custom one; missing maps take their defaults, and without roughness nothing is packed."""
    k = F.col("vec_id")
    a = V.rasters(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = lambda c: F.get(F.col("v"), F.col("p") * 4 + c)
    maps = (F.when(k % 9 > 0, at(1)), F.when(k % 3 > 0, at(2)), F.when(k % 4 > 0, at(0)), F.when(k % 7 == 0, at(3)))
    case = F
    for j, preset in enumerate(PRESETS):
        layout = G.layout_of(preset, {"R": " One ", "a": "smoothness"} if preset == "custom" else None)
        case = case.when(k % 5 == j, G.packed(layout, *maps))
    a = a.select("vec_id", F.col("p").cast("long").alias("p"), case.otherwise(F.lit(None)).alias("c")).where(F.col("c").isNotNull())
    return a.select("vec_id", "p", *[r6(F.col(f"c.{n}"), n) for n in "rgba"])


@query(WITH + f"""SELECT asset_id, CASE WHEN t IN ('ui', 'mask') THEN 'skip' WHEN t = 'opacity' THEN 'nearest' WHEN t = 'normal' THEN 'normal' ELSE 'model' END AS action, t = 'roughness' AND gloss AS inverted, t IN ('diffuse', 'albedo', 'specular', 'emissive', 'ui', 'unknown') AS graded,
  m IN ('stone', 'concrete', 'brick', 'wood', 'metal', 'fabric') AS detailed, tileable AS seam_repaired, has_alpha AND asset_id % 4 > 0 AS alpha_kept FROM
  (SELECT asset_id, has_alpha, {TYPE_SQL} AS t, {MATERIAL_SQL} AS m, regexp_matches(lower(filepath), '(_gloss|_glossiness)(\\.[^./]*)?$') AS gloss, regexp_matches(lower(filepath), '(^|[^a-z])({'|'.join(T.TILEABLE_WORDS)})([^a-z]|$)') AS tileable FROM v_assets)""")
def phase_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps apply to an asset by type, material and name. Every fourth base stands for one that is packed already."""
    p, kind = F.col("filepath"), C.texture_type(F.col("filepath"))
    a = V.assets(spark, sf_dir).withColumns({"t": kind, "m": C.material(p)})
    t = F.col("t")
    return a.select(
        "asset_id", G.upscale_action(t).alias("action"), ((t == "roughness") & C.is_gloss(p)).alias("inverted"), t.isin(*T.GRADED_TYPES).alias("graded"), F.col("m").isin(*T.DETAIL_MATERIALS).alias("detailed"),
        C.is_tileable(p).alias("seam_repaired"), (F.col("has_alpha") & (F.col("asset_id") % 4 > 0)).alias("alpha_kept"),
    )


@query(f"WITH {V.GRAY_SQL}, d AS (SELECT unnest(range(256)) AS q) SELECT vec_id, CAST(q AS BIGINT) AS p, round(CASE WHEN vec_id % 2 = 0 THEN 1 - v ELSE v END, 6) AS value FROM d JOIN v_gray ON y = (q // 16) // 2 AND x = (q % 16) // 2")
def nearest_upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the size by nearest pixels; every second raster as gloss, inverted after it is enlarged."""
    a = V.rasters(spark, sf_dir).select("vec_id", F.posexplode(G.nearest_upscaled(F.col("v"), 8, 8, 1, 16, 16)).alias("p", "x"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(F.when(F.col("vec_id") % 2 == 0, 1 - F.col("x")).otherwise(F.col("x")), "value"))


_side = lambda q, k: f"least(3, greatest(0, CAST(floor(({q} + 0.5) / 2 - 0.5) AS INT) + {k}))"
_frac = lambda q: f"(({q} + 0.5) / 2 - 0.5 - floor(({q} + 0.5) / 2 - 0.5))"
_mixed = lambda c: f"(a00.{c} * (1 - fx) + a01.{c} * fx) * (1 - fy) + (a10.{c} * (1 - fx) + a11.{c} * fx) * fy"


@query(f"""{RGBA}, d AS (SELECT q, {_side('q // 8', 0)} AS y0, {_side('q // 8', 1)} AS y1, {_side('q % 8', 0)} AS x0, {_side('q % 8', 1)} AS x1, {_frac('q // 8')}::DOUBLE AS fy, {_frac('q % 8')}::DOUBLE AS fx FROM (SELECT unnest(range(64)) AS q)),
 e AS (SELECT a00.vec_id, q, {', '.join(f'{_mixed(c)} AS {c}' for c in 'rgba')} FROM d JOIN v_rgba a00 ON a00.p = y0 * 4 + x0 JOIN v_rgba a01 ON a01.vec_id = a00.vec_id AND a01.p = y0 * 4 + x1 JOIN v_rgba a10 ON a10.vec_id = a00.vec_id AND a10.p = y1 * 4 + x0 JOIN v_rgba a11 ON a11.vec_id = a00.vec_id AND a11.p = y1 * 4 + x1)
 SELECT vec_id, CAST(q AS BIGINT) AS p, round((r * 2 - 1) / greatest(n, 1e-8) * 0.5 + 0.5, 6) AS nx, round((g * 2 - 1) / greatest(n, 1e-8) * 0.5 + 0.5, 6) AS ny, round((b * 2 - 1) / greatest(n, 1e-8) * 0.5 + 0.5, 6) AS nz, round(a, 6) AS alpha FROM (SELECT *, sqrt((r*2-1)*(r*2-1) + (g*2-1)*(g*2-1) + (b*2-1)*(b*2-1)) AS n FROM e)""")
def normal_upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal maps twice the size, bilinear, at unit length again, alpha kept."""
    a = V.rasters(spark, sf_dir).select("vec_id", G.linear_upscaled(F.col("v"), 4, 4, 4, 8, 8).alias("u")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    at = lambda c: F.get(F.col("u"), F.col("p") * 4 + c)
    a = a.select("vec_id", F.col("p").cast("long").alias("p"), G.encoded_unit(at(0), at(1), at(2)).alias("n"), at(3).alias("a"))
    return a.select("vec_id", "p", *[r6(F.col("n")[j], f"n{x}") for j, x in enumerate("xyz")], r6(F.col("a"), "alpha"))
