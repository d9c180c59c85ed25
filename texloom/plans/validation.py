"""Queries of checks: reports of assets, output files, containers. The SQL states each rule from its fields and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.config import Validation
from texloom.functions import catalog as C
from texloom.functions import rasters as P
from texloom.operators import containers as B
from texloom.operators import validation as R
from texloom.plans import views as V
from texloom.plans.pixels import LIN, LUM, SEAM_SQL, r6
from texloom.plans.registry import query

GRAY, RGBA = f"WITH {V.GRAY_SQL} ", f"WITH {V.RGBA_SQL} "


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), key.cast("int"))


_list = lambda values, key: "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({key} + 1 AS INT)]"
KINDS, MATERIALS = ("diffuse", "normal", "unknown", "roughness"), ("wood", "metal", "", "gold", " Brick ", "paint")
NAMES = ("a_metalness", "b", "c_ao", "d_normal", "e_zones", "f_base")
_found = lambda tests: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL)"
_share = lambda test: f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0 END)"


@query(GRAY + f"""SELECT vec_id, name, width, height, {_found((('small', 'width < 64 OR height < 64'), ('solid', 's < 0.004 AND NOT uniform')))}::VARCHAR AS errors,
  {_found((('not_power_of_two', '(width & (width - 1)) != 0 OR (height & (height - 1)) != 0'), ('solid', 's < 0.001 AND uniform')))}::VARCHAR AS warnings
  FROM (SELECT vec_id, {_list(NAMES, 'vec_id % 6')} AS name, CAST(32 + vec_id % 3 * 32 AS INT) AS width, CAST(60 + vec_id % 7 AS INT) AS height, vec_id % 6 IN (0, 2, 4) AS uniform, stddev_pop(v * CASE WHEN vec_id % 4 = 0 THEN 0.001 WHEN vec_id % 4 = 1 THEN 0.01 ELSE 1 END) AS s FROM v_gray GROUP BY vec_id)""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, and near-solid maps with the lower limit for names that may be uniform."""
    k = F.col("vec_id")
    dim = F.when(k % 4 == 0, 0.001).when(k % 4 == 1, 0.01).otherwise(1.0)
    a = V.rasters(spark, sf_dir).select("vec_id", _pick(NAMES, k % 6).alias("name"), (32 + k % 3 * 32).cast("int").alias("width"), (60 + k % 7).cast("int").alias("height"), P.deviation(F.transform("v", lambda x: x * dim)).alias("s"))
    c = R.quality(F.col("name"), F.col("width"), F.col("height"), F.col("s"))
    return a.select("vec_id", "name", "width", "height", _shown(c.errors).alias("errors"), _shown(c.warnings).alias("warnings"))


def _shown(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]"))


@query("""SELECT vec_id, round(avg(CASE WHEN v < -0.01 OR v > 1.01 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outside, avg(CASE WHEN v < -0.01 OR v > 1.01 THEN 1.0::DOUBLE ELSE 0 END) > 0.01 AS out_of_range, round(avg(greatest(0.0, least(1.0, v))), 6) AS mean
  FROM (SELECT vec_id, unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * 4 + 0.5)) AS v FROM embeddings) GROUP BY vec_id""")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a map lies outside [0, 1] before it is clipped."""
    a = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * 4 + 0.5).alias("v"))
    a = a.withColumn("m", R.scalar_map(F.col("v")))
    return a.select("vec_id", r6(P.share(F.col("v"), lambda x: (x < -0.01) | (x > 1.01)), "outside"), F.col("m.out_of_range").alias("out_of_range"), r6(P.mean(F.col("m.v")), "mean"))


MATERIAL_RULES = (
    ("roughness_flat", "rough_std < 0.01"), ("ao_flat", "ao_std < 0.005"), ("metalness_high", "material IN ('wood', 'stone', 'brick', 'fabric', 'plastic', 'glass', 'skin', 'leather', 'concrete', 'default', 'unknown') AND metal_mean > 0.25"),
    ("metalness_low", "material IN ('metal', 'gold', 'silver', 'iron', 'copper') AND metal_mean < 0.55"), ("metalness_mid_range", "metal_mid > 0.25"),
)
ALBEDO_RULES = (("albedo_black", "black > 0.02"), ("albedo_white", "white > 0.02"), ("albedo_near_zero", "lo <= 0.001"), ("albedo_near_one", "hi >= 0.999"))
STATS_SQL = f"""v_stats AS (SELECT vec_id, any_value(label) AS label, CASE WHEN trim(lower({_list(MATERIALS, 'vec_id % 6')})) = '' THEN 'default' ELSE trim(lower({_list(MATERIALS, 'vec_id % 6')})) END AS material,
  stddev_pop(g * CASE WHEN vec_id % 3 = 0 THEN 0.01 ELSE 1 END) AS rough_std, avg(b) AS metal_mean, {_share('b > 0.2 AND b < 0.8')} AS metal_mid, stddev_pop(a * CASE WHEN vec_id % 5 = 0 THEN 0.005 ELSE 1 END) AS ao_std,
  {_share(LUM(LIN) + ' < 0.02')} AS black, {_share(LUM(LIN) + ' > 0.9')} AS white, min({LUM(LIN)}) AS lo, max({LUM(LIN)}) AS hi,
  {_share('abs(sqrt((r*2-1)*(r*2-1) + (g*2-1)*(g*2-1) + (b*2-1)*(b*2-1)) - 1) > 0.02')} AS non_unit, {_share('b * 2 - 1 < 0')} AS negative_z FROM v_rgba GROUP BY vec_id)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters with the maps that the checks look at."""
    k, v = F.col("vec_id"), F.col("v")
    channel = lambda c: F.filter(v, lambda x, i: i % 4 == c)
    a = V.rasters(spark, sf_dir)
    n = P.pixels(16, lambda i: F.struct(*[(F.get(v, i * 4 + c) * 2.0 - 1.0).alias(x) for c, x in enumerate("xyz")]))
    return a.select(
        "vec_id", _pick(MATERIALS, k % 6).alias("material"), _pick(KINDS, k % 4).alias("kind"), P.pixels(48, lambda i: F.get(v, F.floor(i / 3).cast("int") * 4 + i % 3)).alias("rgb"), n.alias("n"),
        F.transform(channel(1), lambda x: x * F.when(k % 3 == 0, 0.01).otherwise(1.0)).alias("rough"), channel(2).alias("metal"), F.transform(channel(3), lambda x: x * F.when(k % 5 == 0, 0.005).otherwise(1.0)).alias("ao"),
        P.luminance(v, 16, 4, linear=True).alias("lum"),
    )


@query(f"WITH {V.RGBA_SQL}, {STATS_SQL} SELECT vec_id, {_found(MATERIAL_RULES)}::VARCHAR AS strict_errors, {_found(ALBEDO_RULES)}::VARCHAR AS lenient_warnings FROM v_stats")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material rules as errors (strict), albedo rules as warnings (not strict)."""
    a = _stats(spark, sf_dir)
    strict = R.material_semantics(F.col("material"), F.col("rough"), F.col("metal"), F.col("ao"), Validation())
    lenient = R.albedo(F.col("lum"), Validation(strict_material_semantics=False))
    return a.select("vec_id", _shown(strict.errors).alias("strict_errors"), _shown(lenient.warnings).alias("lenient_warnings"))


REPORT_SQL = f"""v_report AS (SELECT vec_id, list_concat(list_concat(list_concat({_found((('tiling_seam', 'tileable AND score >= 0.15'),))}, {_found((('normal_non_unit', 'non_unit > 0.01'), ('normal_negative_z', 'negative_z > 0.01')))}),
  {_found((('small', 'TRUE'), ('solid', 'rough_std < 0.004')))}), list_concat({_found(MATERIAL_RULES)}, {_found(ALBEDO_RULES)})) AS errors,
  list_concat({_found((('tiling_poor', 'tileable AND q < 0.55'), ('tiling_below_target', 'tileable AND q >= 0.55 AND q < 0.75')))}, {_found((('pbr_from_colour', "kind IN ('diffuse', 'unknown')"), ('normal_from_colour', "kind IN ('diffuse', 'unknown') AND vec_id % 2 = 0"), ('regression', 'diff > 0.15')))}) AS warnings
  FROM (SELECT s.*, t.score, greatest(0.0, least(1.0, 1 - t.score / 0.3)) AS q, s.vec_id % 2 = 0 AS tileable, {_list(KINDS, 's.vec_id % 4')} AS kind, CASE WHEN s.vec_id % 3 = 1 THEN s.lo ELSE NULL END AS diff FROM v_stats s JOIN v_seam t USING (vec_id)))"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = Validation(), F.col("vec_id")
    a = _stats(spark, sf_dir).withColumn("seam", P.let(F.col("rgb"), lambda v: P.seam_score(v, 4, 4, 3, 2)))
    own = [R.tiling(F.col("seam"), k % 2 == 0, s), R.normal_map(F.col("n"), s), R.quality(F.lit("x_roughness_map"), F.lit(4), F.lit(4), P.deviation(F.col("rough")))]
    unique = [
        R.material_semantics(F.col("material"), F.col("rough"), F.col("metal"), F.col("ao"), s), R.albedo(F.col("lum"), s), R.heuristic(F.col("kind"), F.lit(True), k % 2 == 0, s),
        R.regression(F.when(k % 3 == 1, F.array_min("lum")), s),
    ]
    return R.reported(a, own, unique)


@query(f"WITH {V.RGBA_SQL}, {SEAM_SQL}, {STATS_SQL}, {REPORT_SQL} SELECT vec_id, len(errors) = 0 AS passed, errors::VARCHAR AS errors, warnings::VARCHAR AS warnings FROM v_report")
def asset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of an asset in one row; entries that repeat are listed once, in order."""
    return _reports(spark, sf_dir).select("vec_id", "passed", _shown(F.col("errors")).alias("errors"), _shown(F.col("warnings")).alias("warnings"))


@query(f"""WITH {V.RGBA_SQL}, {SEAM_SQL}, {STATS_SQL}, {REPORT_SQL}, h AS (SELECT count(*) AS n, count_if(len(errors) = 0) AS ok, sum(len(errors)) AS e FROM v_report)
  SELECT 0 AS section, CAST(0 AS BIGINT) AS key, CAST(i - 1 AS INT) AS place, l[i] AS line FROM (SELECT ['Total assets: ' || n, 'Passed: ' || ok || '/' || n, 'Failed: ' || (n - ok) || '/' || n, 'Total errors: ' || e, CASE WHEN n = ok THEN 'All assets passed validation.' ELSE 'FAILED ASSETS:' END] AS l FROM h), (SELECT unnest(range(1, 6)) AS i)
  UNION ALL SELECT 1, vec_id, CAST(i - 1 AS INT), l[i] FROM (SELECT vec_id, list_concat(['  ' || vec_id || ':'], list_transform(errors, lambda x: '    ERROR: ' || x)) AS l, unnest(range(1, len(errors) + 2)) AS i FROM v_report WHERE len(errors) > 0)""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 A4 A5: the lines of the validation report."""
    return R.report_lines(_reports(spark, sf_dir), "vec_id")


@query(f"""WITH {V.RGBA_SQL}, {SEAM_SQL} SELECT vec_id, '{{"filename":"' || vec_id || '.png","passed":' || (score < 0.15)::VARCHAR || ',"seam_score":' || CAST(round(score, 4) AS DECIMAL(10, 4))::VARCHAR || ',"quality_score":' || CAST(round(q, 4) AS DECIMAL(10, 4))::VARCHAR
  || ',"flagged_for_review":' || (round(q, 4) < 0.55 OR (r <= 20 AND round(q, 4) < 0.75))::VARCHAR || '}}' AS entry
  FROM (SELECT *, row_number() OVER (ORDER BY round(q, 4), vec_id) AS r FROM (SELECT vec_id, score, greatest(0.0, least(1.0, 1 - score / 0.3)) AS q FROM v_seam))""")
def tiling_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON entries of the tiling report. The cut of the worst is one top-k, so no task ranks all assets."""
    rgb = P.pixels(48, lambda i: F.get(F.col("v"), F.floor(i / 3).cast("int") * 4 + i % 3))
    a = V.rasters(spark, sf_dir).select("vec_id", rgb.alias("rgb")).select("vec_id", P.let(F.col("rgb"), lambda v: P.seam_score(v, 4, 4, 3, 2)).alias("score"))
    a = a.withColumn("q", F.round(P.clip(1 - F.col("score") / 0.3), 4))
    last = a.orderBy("q", "vec_id").limit(20).agg(F.max(F.struct("q", "vec_id"))).head()[0]
    worst = F.struct("q", "vec_id") <= F.struct(F.lit(last["q"]).alias("q"), F.lit(last["vec_id"]).alias("vec_id")) if last else F.lit(False)
    flagged = (F.col("q") < 0.55) | (worst & (F.col("q") < 0.75))
    number = lambda c: F.round(c, 4).cast("decimal(10,4)")
    entry = F.struct(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("filename"), (F.col("score") < 0.15).alias("passed"), number(F.col("score")).alias("seam_score"), number(F.col("q")).alias("quality_score"), flagged.alias("flagged_for_review"))
    return a.select("vec_id", F.to_json(entry).alias("entry"))


# Containers: files whose header fields come from the part table; SQL applies the rules to the fields.

FIELDS = {
    "header": "CASE WHEN k % 7 = 0 THEN 0 ELSE 124 END", "pf": "CASE WHEN k % 5 = 0 THEN 0 ELSE 32 END", "flags": "CASE k % 4 WHEN 0 THEN 4103 WHEN 1 THEN 135175 WHEN 2 THEN 4099 ELSE 659463 END",
    "caps": "CASE k DIV 4 % 4 WHEN 0 THEN 4096 WHEN 1 THEN 4198408 WHEN 2 THEN 0 ELSE 4198400 END", "width": "CASE WHEN k % 11 = 0 THEN 0 ELSE 1 + k % 40 END", "height": "1 + k % 9", "mips": "k DIV 3 % 9",
    "dxgi": "CASE k DIV 8 % 4 WHEN 0 THEN 71 WHEN 1 THEN 98 WHEN 2 THEN 72 ELSE 5 END", "len": "CASE WHEN k % 23 = 0 THEN 0 WHEN k % 13 = 0 THEN 100 WHEN k % 17 = 0 THEN 130 ELSE 160 END",
    "faces": "CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 2 END", "levels": "k % 5", "size0": "CASE WHEN k % 6 = 0 THEN 0 ELSE 40 END", "klen": "CASE WHEN k % 23 = 0 THEN 0 WHEN k % 13 = 0 THEN 70 WHEN k % 10 = 0 THEN 120 ELSE 240 END",
}
FOURCCS, TYPES = ("DXT1", "DX10", "ATI2", "ABCD"), ("albedo", "normal")
FIELDS_SQL = "WITH f AS (SELECT k, k % 19 = 0 AS foreign_, " + _list(FOURCCS, "(k // 2) % 4") + " AS fourcc, " + _list(TYPES, "k % 2") + " AS kind, " + ", ".join(f"{e.replace('DIV', '//')} AS {n}" for n, e in FIELDS.items()) + " FROM (SELECT p_partkey AS k FROM part)) "


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    return a.select("k", (F.col("k") % 19 == 0).alias("foreign_"), _pick(FOURCCS, F.expr("k DIV 2 % 4")).alias("fourcc"), _pick(TYPES, F.col("k") % 2).alias("kind"), *[F.expr(e).cast("long").alias(n) for n, e in FIELDS.items()])


def dds_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, kind, raw: DDS files with the fields of the view."""
    n, zero = lambda c: B.bytes_of(F.col(c)), lambda k: F.lit(b"\0" * k)
    magic = F.when(F.col("foreign_"), F.lit(b"JUNK")).otherwise(F.lit(B.DDS))
    raw = F.concat(magic, n("header"), n("flags"), n("height"), n("width"), zero(8), n("mips"), zero(44), n("pf"), F.lit(b"\4\0\0\0"), F.col("fourcc").cast("binary"), zero(20), n("caps"), zero(16), n("dxgi"), zero(28))
    return _fields(spark, sf_dir).select("k", "kind", F.substr(raw, F.lit(1), F.col("len").cast("int")).alias("raw"))


SIDE = "greatest(width, height)"
ACTUAL = "CASE WHEN fourcc = 'DX10' THEN CASE WHEN len < 148 THEN NULL WHEN dxgi IN (71, 72) THEN 'bc1' WHEN dxgi = 98 THEN 'bc7' END WHEN fourcc = 'DXT1' THEN 'bc1' WHEN fourcc = 'ATI2' THEN 'bc5' END"
DDS_RULES = (
    ("dds_header", "header != 124"), ("dds_pixel_format", "pf != 32"), ("dds_flags", "(flags & 4103) != 4103"), ("dds_caps_texture", "(caps & 4096) = 0"), ("dds_dimensions", "width = 0 OR height = 0"),
    ("dds_mip_count", "(flags & 131072) != 0 AND mips = 0"), ("dds_mip_count", f"mips > 0 AND {SIDE} > 0 AND mips > floor(log2({SIDE})) + 1"), ("dds_mipchain", f"{SIDE} > 1 AND mips <= 1"), ("dds_caps_mipmap", "(caps & 4194304) != 0 AND mips <= 1"),
    ("dds_dx10_header", "fourcc = 'DX10' AND len < 148"), ("dds_codec", f"coalesce({ACTUAL}, '') != CASE kind WHEN 'albedo' THEN 'bc7' ELSE 'bc5' END"),
)


@query(FIELDS_SQL + f"""SELECT k, array_to_string(CASE WHEN len = 0 THEN ['non_zero_size'] WHEN foreign_ THEN ['magic_bytes'] WHEN len < 128 THEN ['dds_header'] ELSE {_found(DDS_RULES)} END, ',') AS issues,
  CASE WHEN len >= 132 AND NOT foreign_ AND fourcc = 'DX10' THEN (dxgi = 72) != (kind = 'albedo') END AS srgb_mismatch FROM f""")
def dds_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a DDS output, mips required, and whether its format's gamma fits its type."""
    a = dds_files(spark, sf_dir)
    expected = C.codec(F.col("kind"), F.lit(False))
    return a.select("k", F.array_join(B.dds_issues(F.col("raw"), True, expected), ",").alias("issues"), B.srgb_mismatch(F.col("raw"), F.col("kind")).alias("srgb_mismatch"))


def ktx2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, raw: KTX2 files; level j starts at 200 + 10 j, the first one has size0 bytes, the others 5."""
    n, zero = lambda c: B.bytes_of(F.col(c)), lambda k: F.lit(b"\0" * k)
    level = lambda j: F.concat(B.bytes_of(F.lit(200 + 10 * j), 8), B.bytes_of(F.when(F.lit(j == 0), F.col("size0")).otherwise(5), 8), zero(8))
    magic = F.when(F.col("foreign_"), F.lit(b"JUNK" * 3)).otherwise(F.lit(B.KTX2))
    raw = F.concat(magic, zero(8), n("width"), n("height"), zero(8), n("faces"), n("levels"), zero(36), *[level(j) for j in range(5)], zero(100))
    return _fields(spark, sf_dir).select("k", F.substr(raw, F.lit(1), F.col("klen").cast("int")).alias("raw"))


_bad_level = "CASE WHEN (CASE WHEN j = 0 THEN size0 ELSE 5 END) = 0 OR 200 + 10 * j + (CASE WHEN j = 0 THEN size0 ELSE 5 END) > klen THEN 'ktx2_level_index' END"
KTX2_HEAD = (("ktx2_dimensions", "width = 0"), ("ktx2_dimensions", "height = 0"), ("ktx2_face_count", "faces NOT IN (1, 6)"), ("ktx2_level_count", "levels = 0"))


@query(FIELDS_SQL + f"""SELECT k, array_to_string(CASE WHEN klen = 0 THEN ['non_zero_size'] WHEN foreign_ THEN ['magic_bytes'] WHEN klen < 80 THEN ['ktx2_header'] WHEN levels = 0 THEN {_found(KTX2_HEAD)}
  ELSE list_concat({_found((*KTX2_HEAD, ('ktx2_mipchain', f'{SIDE} > 1 AND levels <= 1'), ('ktx2_level_index', 'klen < 80 + 24 * levels')))}, CASE WHEN klen < 80 + 24 * levels THEN [] ELSE list_filter(list_transform(range(0, levels), lambda j: {_bad_level}), lambda x: x IS NOT NULL) END) END, ',') AS issues FROM f""")
def ktx2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a KTX2 output, mips required."""
    return ktx2_files(spark, sf_dir).select("k", F.array_join(B.ktx2_issues(F.col("raw"), True), ",").alias("issues"))


@query(FIELDS_SQL + """, g AS (SELECT *, unnest(range(0, levels)) AS j FROM f WHERE NOT foreign_ AND klen >= 80 + 24 * levels AND levels > 0)
  SELECT k, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(faces AS BIGINT) AS faces, CAST(j AS INT) AS level, CAST(200 + 10 * j AS BIGINT) AS offset_, CAST(CASE WHEN j = 0 THEN size0 ELSE 5 END AS BIGINT) AS length_ FROM g""")
def ktx2_level_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and level index of KTX2 files; a row for each level."""
    a = ktx2_files(spark, sf_dir).withColumns({"h": B.ktx2_header(F.col("raw")), "l": B.ktx2_levels(F.col("raw"))})
    a = a.select("k", "h.width", "h.height", "h.faces", F.explode("l").alias("m"))
    return a.select("k", "width", "height", "faces", "m.level", F.col("m.offset").cast("long").alias("offset_"), F.col("m.length").cast("long").alias("length_"))


@query(FIELDS_SQL + "SELECT k, CASE WHEN fourcc = 'DX10' AND NOT foreign_ AND len >= 132 THEN CAST(CASE dxgi WHEN 71 THEN 72 WHEN 98 THEN 99 ELSE dxgi END AS BIGINT) END AS dxgi, CAST(len AS BIGINT) AS bytes FROM f")
def srgb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear DXGI codes made sRGB; the rest of a file stays."""
    a = dds_files(spark, sf_dir).select("k", B.srgb_dds(F.col("raw")).alias("raw"))
    code = F.when(B.has_magic(F.col("raw"), "dds") & (F.substring("raw", 85, 4).cast("string") == "DX10") & (F.length("raw") >= 132), B.little(F.col("raw"), 128))
    return a.select("k", code.alias("dxgi"), F.length("raw").cast("long").alias("bytes"))


@query("""SELECT k, CAST(n AS BIGINT) AS mips, CAST(128 + list_sum(list_transform(range(0, n), lambda j: greatest(1, 4 >> j) * greatest(1, 4 >> j))) AS BIGINT) AS bytes, CAST(CASE WHEN n > 1 THEN 659463 ELSE 528391 END AS BIGINT) AS flags, CAST(CASE WHEN n > 1 THEN 4198408 ELSE 4096 END AS BIGINT) AS caps,
  array_to_string(list_transform(range(0, n), lambda j: repeat(lpad(to_hex(64 + j), 2, '0'), CAST(greatest(1, 4 >> j) * greatest(1, 4 >> j) AS INT))), '') AS data FROM (SELECT p_partkey AS k, p_partkey % 3 + 1 AS n FROM part)""")
def dds_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of single-level files, given in any order: count, flags, caps, data by level."""
    zero = lambda k: b"\0" * k
    word = lambda x: x.to_bytes(4, "little")

    def level(j: int) -> Column:
        side = max(1, 16 >> j)
        blocks = max(1, 4 >> j) ** 2
        head = b"DDS " + word(124) + word(0x1007) + word(side) + word(side) + zero(8) + word(1) + zero(44) + word(32) + word(4) + b"DXT1" + zero(20) + word(0x1000) + zero(16)
        return F.struct(F.lit(j).alias("level"), F.lit(head + bytes([64 + j]) * blocks).alias("raw"))

    a = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 3 + 1).alias("n"))
    a = a.select("k", "n", B.mip_chain(F.filter(F.array(*[level(j) for j in (2, 0, 1)]), lambda m: m["level"] < F.col("n"))).alias("raw"))
    at = lambda o: B.little(F.col("raw"), o)
    return a.select("k", at(28).alias("mips"), F.length("raw").cast("long").alias("bytes"), at(8).alias("flags"), at(108).alias("caps"), F.hex(F.substr("raw", F.lit(129))).alias("data"))
