"""Queries of rules over assets and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.operators import rules as R
from texloom.plans import views as V
from texloom.plans.catalogue import TYPE_SQL, WITH
from texloom.plans.registry import query


@query(WITH + f"""SELECT asset_id, concat_ws(',', CASE WHEN k IN ('diffuse', 'albedo', 'unknown') AND asset_id % 2 = 0 THEN 'pbr_from_colour' END, CASE WHEN k IN ('diffuse', 'albedo', 'unknown') AND asset_id % 3 = 0 THEN 'normal_from_colour' END) AS issues
  FROM (SELECT asset_id, {TYPE_SQL} AS k FROM v_assets)""")
def heuristic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X38 A6 P8."""
    key = F.col("asset_id")
    a = V.assets(spark, sf_dir).select("asset_id", R.heuristic_issues(C.texture_type(F.col("filepath")), key % 2 == 0, key % 3 == 0).alias("i"))
    return a.select("asset_id", F.array_join("i", ",").alias("issues"))


@query("""SELECT page_id, t AS value, regexp_matches(lower(t), '\\.(png|dds|tga|ktx2|jpg|jpeg|bmp|tif|tiff|json)$') AND NOT contains(t, '://') AND NOT starts_with(t, 'data:') AND NOT regexp_matches(t, '[\\r\\n]') AND regexp_matches(t, '[/\\\\]') AS is_path
  FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'out/' || CAST(page_id AS VARCHAR) || '.PNG' WHEN 2 THEN 'x.png' WHEN 3 THEN 'data:a/b.png' ELSE 'a\\b.dds' END AS t FROM pages)""")
def cached_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 P12."""
    k = F.col("page_id") % 5
    t = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit(".PNG"))).when(k == 2, "x.png").when(k == 3, "data:a/b.png").otherwise("a\\b.dds")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.alias("value"), R.probable_path(t).alias("is_path"))


@query("""SELECT p_name || '.png' AS file, CASE WHEN p_partkey % 4 = 0 THEN 'non_zero_size' ELSE 'magic_bytes' END AS check FROM part WHERE p_partkey % 4 < 2""")
def file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty files and files that are not PNG among those named so."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit(b"")).when(k == 1, F.lit(b"\xff\xd8\xff\xe0")).otherwise(F.lit(b"\x89PNG\r\n\x1a\n..."))
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.lit(".png")).alias("file"), raw.alias("content"))
    return R.issues(files)
