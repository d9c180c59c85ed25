"""Queries on rasters: statistics, rules, per-pixel maps. Rasters stay arrays in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



from texloom.functions import rasters as P
from texloom.functions import tables as T
from texloom.plans import views as V
from texloom.plans.registry import query

GRAY, RGBA = f"WITH {V.GRAY_SQL} ", f"WITH {V.RGBA_SQL} "
LIN = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"
SRGB = lambda c: f"(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END)"
LUM = lambda f=lambda c: c: f"(0.2126 * {f('r')} + 0.7152 * {f('g')} + 0.0722 * {f('b')})"


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def pixel_rows(df: DataFrame, values: Column, name: str) -> DataFrame:
    """vec_id, p, value: only to compare and to store; operators work on arrays."""
    return df.select("vec_id", F.posexplode(values).alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("p"), r6(F.col("x"), name))


@query(GRAY + "SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(CASE WHEN v > 0.2 AND v < 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS mid FROM v_gray GROUP BY vec_id")
def map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return V.rasters(spark, sf_dir).select("vec_id", r6(P.mean(F.col("v")), "mean"), r6(P.deviation(F.col("v")), "std"), r6(P.percentile(F.col("v"), 0.05), "p05"), r6(P.percentile(F.col("v"), 0.95), "p95"), r6(P.share(F.col("v"), lambda x: (x > 0.2) & (x < 0.8)), "mid"))


@query(RGBA + f"""SELECT vec_id, round(min(l), 6) AS lum_min, round(max(l), 6) AS lum_max, round(avg(CASE WHEN l < 0.02 THEN 1.0::DOUBLE ELSE 0 END), 6) AS black, round(avg(CASE WHEN l > 0.9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS white,
  NOT (avg(CASE WHEN l < 0.02 THEN 1.0::DOUBLE ELSE 0 END) > 0.02 OR avg(CASE WHEN l > 0.9 THEN 1.0::DOUBLE ELSE 0 END) > 0.02 OR min(l) <= 0.001 OR max(l) >= 0.999) AS passed FROM (SELECT vec_id, {LUM(LIN)} AS l FROM v_rgba) GROUP BY vec_id""")
def albedo_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 X37."""
    a = V.rasters(spark, sf_dir).select("vec_id", P.luminance(F.col("v"), 16, 4, linear=True).alias("l"))
    lum = F.col("l")
    a = a.select("vec_id", F.array_min(lum).alias("lo"), F.array_max(lum).alias("hi"), P.share(lum, lambda x: x < 0.02).alias("black"), P.share(lum, lambda x: x > 0.9).alias("white"))
    bad = (F.col("black") > 0.02) | (F.col("white") > 0.02) | (F.col("lo") <= 0.001) | (F.col("hi") >= 0.999)
    return a.select("vec_id", r6(F.col("lo"), "lum_min"), r6(F.col("hi"), "lum_max"), r6(F.col("black"), "black"), r6(F.col("white"), "white"), (~bad).alias("passed"))


@query(RGBA + "SELECT vec_id, round(avg(CASE WHEN abs(sqrt(x*x + y*y + z*z) - 1) > 0.02 THEN 1.0::DOUBLE ELSE 0 END), 6) AS non_unit, round(avg(CASE WHEN z < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_z FROM (SELECT vec_id, r * 2 - 1 AS x, g * 2 - 1 AS y, b * 2 - 1 AS z FROM v_rgba) GROUP BY vec_id")
def normal_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    n = P.pixels(16, lambda i: F.struct(*[(F.get(F.col("v"), i * 4 + c) * 2.0 - 1.0).alias(k) for c, k in enumerate("xyz")]))
    a = V.rasters(spark, sf_dir).select("vec_id", n.alias("n"))
    off = lambda v: F.abs(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) - 1.0) > 0.02
    return a.select("vec_id", r6(P.share(F.col("n"), off), "non_unit"), r6(P.share(F.col("n"), lambda v: v["z"] < 0), "negative_z"))


@query(RGBA + f"SELECT vec_id, p, round({LUM()}, 6) AS luminance, round({LUM(LIN)}, 6) AS linear FROM v_rgba")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 F40 F41."""
    a = V.rasters(spark, sf_dir)
    both = F.arrays_zip(P.luminance(F.col("v"), 16, 4, False).alias("a"), P.luminance(F.col("v"), 16, 4, True).alias("b"))
    return a.select("vec_id", F.posexplode(both).alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("p"), r6(F.col("x.a"), "luminance"), r6(F.col("x.b"), "linear"))


@query(GRAY + f"SELECT vec_id, CAST(y * 8 + x AS BIGINT) AS p, round({LIN('v')}, 6) AS linear, round({SRGB(LIN('v'))}, 6) AS back FROM v_gray")
def srgb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    a = V.rasters(spark, sf_dir).select("vec_id", F.posexplode("v").alias("p", "x"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(P.to_linear(F.col("x")), "linear"), r6(P.to_srgb(P.to_linear(F.col("x"))), "back"))


@query(GRAY + """SELECT vec_id, CAST(y * 8 + x AS BIGINT) AS p, round(1 - v, 6) AS gloss, round(sqrt(least(1.0, v * v + 0.04 * 15)), 6) AS mip4, CASE WHEN (CASE WHEN v > 0.5 THEN 1 - 0.5 * pow(2 * (1 - v), 2) ELSE 0.5 * pow(2 * v, 2) END) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS metal FROM v_gray""")
def scalar_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gloss, roughness of mip level 4, binary metalness."""
    x = F.col("x")
    curve = F.when(x > 0.5, 1 - 0.5 * F.pow(2 * (1 - x), F.lit(2.0))).otherwise(0.5 * F.pow(2 * x, F.lit(2.0)))
    a = V.rasters(spark, sf_dir).select("vec_id", F.posexplode("v").alias("p", "x"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(1 - x, "gloss"), r6(F.sqrt(P.clip(x * x + 0.04 * (2.0**4 - 1))), "mip4"), F.when(curve > 0.5, 1.0).otherwise(0.0).alias("metal"))


SEAM_SQL = f"""v_lum AS (SELECT vec_id, p // 4 AS y, p % 4 AS x, r, g, b, {LUM()} AS l FROM v_rgba),
 v_lr AS (SELECT a.vec_id, avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3) AS d FROM v_lum a JOIN v_lum b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 2 GROUP BY 1),
 v_tb AS (SELECT a.vec_id, avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3) AS d FROM v_lum a JOIN v_lum b ON a.vec_id = b.vec_id AND a.x = b.x AND b.y = a.y + 2 GROUP BY 1),
 v_gx AS (SELECT vec_id, avg(greatest(seam - inner_g, 0)) AS g FROM (SELECT vec_id, y, abs(max(CASE WHEN x = 0 THEN l END) - max(CASE WHEN x = 3 THEN l END)) AS seam, avg(d) AS inner_g FROM (SELECT *, abs(l - lag(l) OVER (PARTITION BY vec_id, y ORDER BY x)) AS d FROM v_lum) GROUP BY 1, 2) GROUP BY 1),
 v_gy AS (SELECT vec_id, avg(greatest(seam - inner_g, 0)) AS g FROM (SELECT vec_id, x, abs(max(CASE WHEN y = 0 THEN l END) - max(CASE WHEN y = 3 THEN l END)) AS seam, avg(d) AS inner_g FROM (SELECT *, abs(l - lag(l) OVER (PARTITION BY vec_id, x ORDER BY y)) AS d FROM v_lum) GROUP BY 1, 2) GROUP BY 1),
 v_seam AS (SELECT vec_id, 0.4 * (v_lr.d + v_tb.d) / 2 + 0.6 * (v_gx.g + v_gy.g) / 2 AS score FROM v_lr JOIN v_tb USING (vec_id) JOIN v_gx USING (vec_id) JOIN v_gy USING (vec_id))"""


def _seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = P.pixels(16 * 3, lambda i: F.get(F.col("v"), F.floor(i / 3).cast("int") * 4 + i % 3))
    a = V.rasters(spark, sf_dir).select("vec_id", rgb.alias("rgb"))
    return a.select("vec_id", P.let(F.col("rgb"), lambda v: P.seam_score(v, 4, 4, 3, 2)).alias("score"))


@query(f"WITH {V.RGBA_SQL}, {SEAM_SQL} SELECT vec_id, round(score, 6) AS score, round(greatest(0.0, least(1.0, 1 - score / 0.3)), 6) AS quality FROM v_seam")
def seam_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 W3 F25."""
    return _seams(spark, sf_dir).select("vec_id", r6(F.col("score"), "score"), r6(P.clip(1 - F.col("score") / 0.3), "quality"))


@query(f"WITH {V.RGBA_SQL}, {SEAM_SQL} SELECT vec_id, quality, quality < 0.55 OR (r <= 20 AND quality < 0.75) AS flagged FROM (SELECT *, row_number() OVER (ORDER BY quality, vec_id) AS r FROM (SELECT vec_id, round(greatest(0.0, least(1.0, 1 - score / 0.3)), 6) AS quality FROM v_seam))")
def tiling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst are found by a top-k, so no task ranks all assets."""
    q = _seams(spark, sf_dir).select("vec_id", F.round(P.clip(1 - F.col("score") / 0.3), 6).alias("quality"))
    worst = q.orderBy("quality", "vec_id").limit(20).select("vec_id", F.lit(True).alias("worst"))
    q = q.join(F.broadcast(worst), "vec_id", "left")
    return q.select("vec_id", "quality", ((F.col("quality") < 0.55) | (F.coalesce("worst", F.lit(False)) & (F.col("quality") < 0.75))).alias("flagged"))


@query(GRAY + """SELECT vec_id, CAST(y * 8 + x AS BIGINT) AS p, round(CASE WHEN m + 3 * s > 1e-8 THEN greatest(0.0, least(1.0, v / (m + 3 * s))) ELSE 0 END, 6) AS robust, round(CASE WHEN hi - lo > 1e-8 THEN (v - lo) / (hi - lo) ELSE 0.5 END, 6) AS min_max, round((v - m) * 1.2 + m, 6) AS contrast
  FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, min(v) OVER w AS lo, max(v) OVER w AS hi FROM v_gray WINDOW w AS (PARTITION BY vec_id))""")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 A15 A16."""
    z = F.arrays_zip(P.robust(F.col("v")).alias("a"), P.min_max(F.col("v")).alias("b"), P.contrast(F.col("v"), 1.2).alias("c"))
    a = V.rasters(spark, sf_dir).select("vec_id", F.posexplode(z).alias("p", "x"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(F.col("x.a"), "robust"), r6(F.col("x.b"), "min_max"), r6(F.col("x.c"), "contrast"))


_near = lambda d, n, half: f"CASE WHEN {d} < 0 THEN {'-' + d + ' - 1' if half else '-(' + d + ')'} WHEN {d} >= {n} THEN {2 * n - (1 if half else 2)} - ({d}) ELSE {d} END"


def _stencil_sql(weights: str, half: bool, name: str) -> str:
    yy, xx = _near("(a.y + k.dy)", 8, half), _near("(a.x + k.dx)", 8, half)
    return GRAY + f", k AS (SELECT * FROM (VALUES {weights}) k(dy, dx, w)) SELECT a.vec_id, CAST(a.y * 8 + a.x AS BIGINT) AS p, round(sum(b.v * k.w), 6) AS {name} FROM v_gray a CROSS JOIN k JOIN v_gray b ON b.vec_id = a.vec_id AND b.y = {yy} AND b.x = {xx} GROUP BY 1, 2"


_kernel = lambda weights: ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for (dy, dx), w in weights.items())


@query(_stencil_sql(_kernel(P.BOX_3), True, "box"))
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3, edge pixels repeated."""
    a = V.rasters(spark, sf_dir)
    return pixel_rows(a, P.let(F.col("v"), lambda v: P.stencil(v, 8, 8, P.BOX_3, about_edge=False)), "box")


@query(_stencil_sql(_kernel(P.SOBEL_X), False, "dx"))
def sobel_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3, reflected about the edge pixels."""
    a = V.rasters(spark, sf_dir)
    return pixel_rows(a, P.let(F.col("v"), lambda v: P.stencil(v, 8, 8, P.SOBEL_X)), "dx")


@query(RGBA + "SELECT vec_id, p, round(r, 6) AS ao, round(g, 6) AS roughness, round(b, 6) AS metalness, round(1 - g, 6) AS smoothness, round(greatest(0.0, least(1.0, 0.35 * (1 - g) + 0.65 * b)), 6) AS envmask FROM v_rgba")
def packed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of one asset are channels of one row, so aligning them needs no join."""
    at = lambda c: F.get(F.col("v"), F.col("p") * 4 + c)
    a = V.rasters(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    maps = {"ao": at(0), "roughness": at(1), "metalness": at(2), "smoothness": 1 - at(1), "envmask": P.clip(0.35 * (1 - at(1)) + 0.65 * at(2))}
    return a.select("vec_id", F.col("p").cast("long").alias("p"), *[r6(c, n) for n, c in maps.items()])


@query(RGBA + "SELECT vec_id, p, round(greatest(0.04, least(1.0, r - 0.22 * g + 0.18 * b + 0.08 * a)), 6) AS roughness, round(greatest(0.0, least(1.0, greatest(r, 0.75 * g))), 6) AS metalness FROM v_rgba")
def zone_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red as the map, the other channels as metal, cloth and leather zones."""
    at = lambda c: F.get(F.col("v"), F.col("p") * 4 + c)
    a = V.rasters(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    z = T.ZONE_ROUGHNESS
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(P.clip(at(0) + z["metal"] * at(1) + z["cloth"] * at(2) + z["leather"] * at(3), 0.04), "roughness"), r6(P.clip(F.greatest(at(0), T.ZONE_METALNESS["metal"] * at(1))), "metalness"))


UNIT_SQL = "v_unit AS (SELECT vec_id, p, x / greatest(n, 1e-8) AS x, y / greatest(n, 1e-8) AS y, abs(z / greatest(n, 1e-8)) AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM (SELECT vec_id, p, r * 2 - 1 AS x, g * 2 - 1 AS y, b * 2 - 1 AS z FROM v_rgba)))"


@query(f"WITH {V.RGBA_SQL}, {UNIT_SQL} SELECT vec_id, p, round(x, 6) AS nx, round(y, 6) AS ny, round(z, 6) AS nz FROM v_unit")
def normal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19 X33."""
    a = V.rasters(spark, sf_dir).select("vec_id", F.posexplode(P.unit_normals(F.col("v"), 16, 4)).alias("p", "n"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), *[r6(F.col(f"n.{k}"), f"n{k}") for k in "xyz"])


@query(f"WITH {V.RGBA_SQL}, {UNIT_SQL}, v_two AS (SELECT a.vec_id, a.p, a.x * b.z + b.x * a.z AS x, a.y * b.z + b.y * a.z AS y, a.z * b.z AS z FROM v_unit a JOIN v_unit b ON a.vec_id = b.vec_id AND b.p = (a.p + 5) % 16) SELECT vec_id, p, round(x / greatest(sqrt(x*x + y*y + z*z), 1e-8), 6) AS bx, round(y / greatest(sqrt(x*x + y*y + z*z), 1e-8), 6) AS by_, round(z / greatest(sqrt(x*x + y*y + z*z), 1e-8), 6) AS bz FROM v_two")
def whiteout_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17."""
    a = V.rasters(spark, sf_dir).select("vec_id", P.unit_normals(F.col("v"), 16, 4).alias("n"))
    n = F.col("n")
    a = a.select("vec_id", F.posexplode(F.transform(n, lambda v, i: P.whiteout(v, F.get(n, (i + 5) % 16)))).alias("p", "b"))
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(F.col("b.x"), "bx"), r6(F.col("b.y"), "by_"), r6(F.col("b.z"), "bz"))


@query(GRAY + "SELECT label AS grp, round(median(m), 6) AS mean, round(median(s), 6) AS std, count(*) AS n FROM (SELECT vec_id, any_value(label) AS label, avg(v) AS m, stddev_pop(v) AS s FROM v_gray GROUP BY vec_id) GROUP BY label HAVING count(*) >= 2")
def group_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 D8."""
    a = V.rasters(spark, sf_dir).select(F.col("label").alias("grp"), P.mean(F.col("v")).alias("m"), P.deviation(F.col("v")).alias("s"))
    return a.groupBy("grp").agg(r6(F.median("m"), "mean"), r6(F.median("s"), "std"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(GRAY + """, s AS (SELECT vec_id, any_value(label) AS label, avg(v) AS m, stddev_pop(v) AS s FROM v_gray GROUP BY vec_id), g AS (SELECT label, median(m) AS gm, median(s) AS gs FROM s GROUP BY label HAVING count(*) >= 2)
  SELECT vec_id, CAST(y * 8 + x AS BIGINT) AS p, round(greatest(0.0, least(1.0, v * 0.65 + 0.35 * ((v - m) * greatest(0.5, least(1.5, gs / greatest(s, 1e-6))) + gm))), 6) AS corrected FROM v_gray JOIN s USING (vec_id) JOIN g ON g.label = s.label""")
def colour_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24 J8."""
    a = V.rasters(spark, sf_dir).withColumns({"m": P.mean(F.col("v")), "s": P.deviation(F.col("v"))})
    g = a.groupBy("label").agg(F.median("m").alias("gm"), F.median("s").alias("gs"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    a = a.join(g, "label").withColumn("k", P.clip(F.col("gs") / F.greatest("s", F.lit(1e-6)), 0.5, 1.5))
    return pixel_rows(a, F.transform("v", lambda x: P.clip(x * 0.65 + 0.35 * ((x - F.col("m")) * F.col("k") + F.col("gm")))), "corrected")


MATERIAL_OF = "(['wood', 'metal', 'default', 'gold', 'brick'])[CAST(vec_id % 5 + 1 AS INT)]"
_metals, _others = ", ".join(map(repr, T.METALS)), ", ".join(map(repr, T.NON_METALS))


@query(GRAY + f"""SELECT vec_id, material, material IN ({_others}) AND m > 0.25 AS high_metal, material IN ({_metals}) AND m < 0.55 AS low_metal, mid > 0.25 AS mid_range, s < 0.01 AS flat FROM
  (SELECT vec_id, {MATERIAL_OF} AS material, round(avg(v), 6) AS m, round(stddev_pop(v), 6) AS s, avg(CASE WHEN v > 0.2 AND v < 0.8 THEN 1.0::DOUBLE ELSE 0 END) AS mid FROM v_gray GROUP BY vec_id)""")
def material_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X36."""
    m = F.get(F.array(*[F.lit(x) for x in ("wood", "metal", "default", "gold", "brick")]), (F.col("vec_id") % 5).cast("int"))
    a = V.rasters(spark, sf_dir).select("vec_id", m.alias("material"), F.round(P.mean(F.col("v")), 6).alias("m"), F.round(P.deviation(F.col("v")), 6).alias("s"), P.share(F.col("v"), lambda x: (x > 0.2) & (x < 0.8)).alias("mid"))
    return a.select("vec_id", "material", (F.col("material").isin(*T.NON_METALS) & (F.col("m") > 0.25)).alias("high_metal"), (F.col("material").isin(*T.METALS) & (F.col("m") < 0.55)).alias("low_metal"), (F.col("mid") > 0.25).alias("mid_range"), (F.col("s") < 0.01).alias("flat"))


@query(GRAY + "SELECT vec_id, CAST((y // 2) * 4 + x // 2 AS BIGINT) AS p, round(avg(v), 6) AS mip FROM v_gray GROUP BY 1, 2")
def area_mip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half size by area."""
    at = lambda i, dy, dx: F.get(F.col("v"), (F.floor(i / 4).cast("int") * 2 + dy) * 8 + (i % 4) * 2 + dx)
    return pixel_rows(V.rasters(spark, sf_dir), P.pixels(16, lambda i: (at(i, 0, 0) + at(i, 0, 1) + at(i, 1, 0) + at(i, 1, 1)) / 4), "mip")


@query(GRAY + ", d AS (SELECT unnest(range(144)) AS q) SELECT vec_id, CAST(q AS BIGINT) AS p, round(v, 6) AS padded FROM d JOIN v_gray ON y = (q // 12 + 6) % 8 AND x = (q % 12 + 6) % 8")
def wrap_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a quarter on each side, wrapped."""
    return pixel_rows(V.rasters(spark, sf_dir), P.pixels(144, lambda q: F.get(F.col("v"), (F.floor(q / 12).cast("int") + 6) % 8 * 8 + (q % 12 + 6) % 8)), "padded")


@query(GRAY + "SELECT a.vec_id, round(avg(abs(a.v - b.v)), 6) AS diff, avg(abs(a.v - b.v)) > 0.15 AS regressed FROM v_gray a JOIN v_gray b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1")
def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster against the one before it."""
    a = V.rasters(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    d = a.join(b, "vec_id").select("vec_id", P.mean(F.zip_with("v", "u", lambda x, y: F.abs(x - y))).alias("d"))
    return d.select("vec_id", r6(F.col("d"), "diff"), (F.col("d") > 0.15).alias("regressed"))


@query(RGBA + """SELECT vec_id, CASE WHEN avg(b) > 0.7 AND abs(avg(r) - 0.5) < 0.15 AND abs(avg(g) - 0.5) < 0.15 AND stddev_pop(b) < 0.15 THEN 'normal' ELSE 'diffuse' END AS kind, min(a) >= 1 AS opaque,
  bool_and(a <= 0.02 OR a >= 0.98) AS binary_alpha, count(DISTINCT a) <= 2 AS two_valued, coalesce(stddev_pop(r) < 0.004, false) AS solid FROM v_rgba GROUP BY vec_id""")
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 A22 P5 P19 P20 P21 P22 X35."""
    ch = {k: F.filter(F.col("v"), (lambda c: lambda x, i: i % 4 == c)(c)) for c, k in enumerate("rgba")}
    a = V.rasters(spark, sf_dir).select("vec_id", *[x.alias(k) for k, x in ch.items()])
    r, g, b, al = (F.col(k) for k in "rgba")
    normal = (P.mean(b) > 0.7) & (F.abs(P.mean(r) - 0.5) < 0.15) & (F.abs(P.mean(g) - 0.5) < 0.15) & (P.deviation(b) < 0.15)
    return a.select("vec_id", F.when(normal, "normal").otherwise("diffuse").alias("kind"), (F.array_min(al) >= 1).alias("opaque"), F.forall(al, lambda x: (x <= 0.02) | (x >= 0.98)).alias("binary_alpha"), (F.size(F.array_distinct(al)) <= 2).alias("two_valued"), (P.deviation(r) < 0.004).alias("solid"))


@query(RGBA + f"SELECT vec_id, p, round(greatest(0.02, least(0.9, pow({LUM(LIN)} * 2, 1 / 1.1::DOUBLE))), 6) AS graded, round(greatest(0.0, least(1.0, {LUM()} + (r - {LUM()}) * 1.2)), 6) AS red FROM v_rgba")
def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X25 without LUT: exposure of one stop, gamma, clamp; saturation of the red channel."""
    rgb = lambda f: P.bt709(*[f(F.get(F.col("v"), F.col("p") * 4 + c)) for c in range(3)])
    a = V.rasters(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(15))))
    lum = rgb(lambda c: c)
    return a.select("vec_id", F.col("p").cast("long").alias("p"), r6(P.clip(F.pow(rgb(P.to_linear) * 2, F.lit(1 / 1.1)), 0.02, 0.9), "graded"), r6(P.clip(lum + (F.get(F.col("v"), F.col("p") * 4) - lum) * 1.2), "red"))
