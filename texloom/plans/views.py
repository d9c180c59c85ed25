"""Derived views over the driver's tables: assets, rasters and results, as the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = (
    "ironsword", "iron_plate", "brick_wall", "woodfloor", "wood_floor", "cobblestone-path", "metal", "gold_trim", "hero_face", "plastic7", "glasspane", "grass", "Leather_Seat", "tilefloor",
    "rocket", "rock_face", "main_ui_panel", "sandstone", "dirt", "skin", "weapon_copper", "ceramic", "paint.can", "rubber", "fabricated", "concrete", "silver", "cloth",
)
SUFFIXES = ("_diff", "_normal", "_n", "_rough", "_gloss", "_metallic", "_ao", "_orm", "_ui", "_basecolor", "_h", "", "_mask", "_emissive", "_unknown", "_d", "_disp", "_opacity", "_spec", "_Albedo")
EXTENSIONS = (".png", ".tga", ".PNG", ".dds", ".txt", ".jpg", ".bmp")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ASSETS_SQL = f"""v_assets AS (
  SELECT p_partkey AS asset_id,
    'tex/' || ({_list(WORDS)})[CAST(p_partkey % {len(WORDS)} + 1 AS INT)] || '_' || CAST(p_partkey AS VARCHAR)
      || ({_list(SUFFIXES)})[CAST((p_partkey // {len(WORDS)}) % {len(SUFFIXES)} + 1 AS INT)]
      || ({_list(EXTENSIONS)})[CAST(p_partkey % {len(EXTENSIONS)} + 1 AS INT)] AS filepath,
    CAST((1 << CAST(p_size % 9 + 1 AS INT)) + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END AS INT) AS width,
    CAST((1 << CAST(p_partkey % 8 + 2 AS INT)) AS INT) AS height,
    p_partkey % 3 = 0 AS has_alpha, CAST(p_partkey % 97 AS BIGINT) AS hash
  FROM part)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    path = F.concat(F.lit("tex/"), pick(WORDS, key % len(WORDS)), F.lit("_"), key.cast("string"), pick(SUFFIXES, F.floor(key / len(WORDS)) % len(SUFFIXES)), pick(EXTENSIONS, key % len(EXTENSIONS)))
    power = lambda k: F.call_function("shiftleft", F.lit(1), k.cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key.alias("asset_id"), path.alias("filepath"), (power(F.col("p_size") % 9 + 1) + F.when(key % 5 == 0, 3).otherwise(0)).cast("int").alias("width"), power(key % 8 + 2).alias("height"),
        (key % 3 == 0).alias("has_alpha"), (key % 97).alias("hash"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and 64 values in [0, 1]: an 8 x 8 gray raster, or a 4 x 4 one of four channels."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e.cast("double") + 0.5)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", v.alias("v"))


RASTERS_SQL = "v_rasters AS (SELECT vec_id, label, list_transform(embedding, lambda e: greatest(0.0, least(1.0, CAST(e AS DOUBLE) + 0.5))) AS v FROM embeddings)"
GRAY_SQL = RASTERS_SQL + ", v_gray AS (SELECT vec_id, label, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id, label, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i FROM v_rasters))"
RGBA_SQL = RASTERS_SQL + ", v_rgba AS (SELECT vec_id, label, i AS p, v[i * 4 + 1] AS r, v[i * 4 + 2] AS g, v[i * 4 + 3] AS b, v[i * 4 + 4] AS a FROM (SELECT *, unnest(range(16)) AS i FROM v_rasters))"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase results: asset, phase, ok, metric, order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    phase = F.get(F.array(*[F.lit(p) for p in PHASES]), (F.col("event_id") % len(PHASES)).cast("int"))
    return e.select(F.col("user_id").alias("asset_id"), phase.alias("phase"), F.col("event_type").alias("kind"), (F.col("event_id") % 13 == 0).alias("failed"), (F.col("event_id") % 5 == 0).alias("skipped"), F.col("value").alias("metric"), "ts", "event_id")


PHASES = ("upscale", "pbr", "normal", "pom", "postprocess", "mipmap", "validate")
RESULTS_SQL = f"v_results AS (SELECT user_id AS asset_id, ({_list(PHASES)})[CAST(event_id % {len(PHASES)} + 1 AS INT)] AS phase, event_type AS kind, event_id % 13 = 0 AS failed, event_id % 5 = 0 AS skipped, value AS metric, ts, event_id FROM events)"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset with the paths that phases may have left; blanks and nulls are missing."""
    a = assets(spark, sf_dir)
    path = lambda name, k, m: F.when(F.col("asset_id") % k == m, F.concat(F.lit(f"{name}/"), F.col("asset_id").cast("string"))).when(F.col("asset_id") % k == (m + 1) % k, F.lit(""))
    return a.select("*", *[path(n, k, m).alias(n) for n, k, m in OUTPUTS])


OUTPUTS = (("packed", 11, 0), ("repaired_base", 7, 1), ("upscaled", 3, 0), ("graded", 13, 2), ("corrected", 5, 3), ("repaired", 4, 1), ("pbr_albedo", 2, 0), ("rough_aa", 6, 2), ("rough", 2, 1), ("normal_detail", 9, 4), ("normal_map", 2, 0), ("height_pom", 8, 3), ("height_map", 3, 1))
OUTPUTS_SQL = ASSETS_SQL + ", v_outputs AS (SELECT *, " + ", ".join(f"CASE WHEN asset_id % {k} = {m} THEN '{n}/' || CAST(asset_id AS VARCHAR) WHEN asset_id % {k} = {(m + 1) % k} THEN '' END AS {n}" for n, k, m in OUTPUTS) + " FROM v_assets)"
