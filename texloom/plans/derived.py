"""Queries that derive maps by kernels, and queries on containers built from columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import kernels as K
from texloom.functions import tables as T
from texloom.operators import containers as B
from texloom.operators import phases as H
from texloom.operators import previews as W
from texloom.plans import views as V
from texloom.plans.catalogue import WITH
from texloom.plans.registry import query


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.get(F.array(*[F.lit(x) for x in ("wood", "metal", "default", "gold", "leather")]), (F.col("vec_id") % 5).cast("int"))
    return V.rasters(spark, sf_dir).withColumn("material", m)


@query()
def pbr_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albedo by two ways, roughness, metalness, occlusion, gloss and zones of 4 x 4 colour rasters."""

    def make(a: np.ndarray, material: str) -> dict[str, np.ndarray]:
        albedo = H.delighted(a[..., :3])
        lin = K.to_linear(albedo)
        zones = H.zones(albedo, material)
        rough = np.clip(H.roughness(lin, material) + sum(zones[z] * b for z, b in T.ZONE_ROUGHNESS.items()), 0.04, 1)
        metal = H.metalness(albedo, material)
        for z, least in T.ZONE_METALNESS.items():
            metal = np.maximum(metal, np.clip(zones[z] * least, 0, 1))
        return {"albedo": albedo, "albedo_lab": H.delighted_lab(a[..., :3]), "roughness": rough, "metalness": metal, "ao": H.occlusion(lin), "gloss": np.clip(1 - rough, 0, 1), "zones": np.stack(list(zones.values()), axis=-1)}

    return H.derive(_rasters(spark, sf_dir), make, 4, 4, 4, ("albedo", "albedo_lab", "roughness", "metalness", "ao", "gloss", "zones"))


@query()
def surface_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height, normals, blends, parallax height, height from normals and curvature of 8 x 8 rasters."""

    def make(a: np.ndarray, material: str) -> dict[str, np.ndarray]:
        rgb = np.repeat(a[..., None], 3, axis=2)
        h = H.height(rgb)
        n = H.repaired(H.strengthened(H.blended(H.normals(h), H.detail_normals(rgb), 0.7, 0.3), 1.2))
        return {"height": h, "normal": n, "parallax": H.parallax(h, material == "wood"), "from_normals": K.height_from_normals(n), "curvature": H.curvature(n)}

    return H.derive(_rasters(spark, sf_dir), make, 8, 8, 1, ("height", "normal", "parallax", "from_normals", "curvature"))


@query()
def finishing_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seam repair, emissive mask, reflection mask, specular antialiasing, detail overlay, tables of colour."""
    cube = np.stack(np.meshgrid(*[np.linspace(0, 1, 3)] * 3, indexing="ij")[::-1], axis=-1)

    def make(a: np.ndarray, material: str) -> dict[str, np.ndarray]:
        rgb, alpha = a[..., :3], a[..., 3]
        n = H.normals(alpha)
        return {
            "seamless": H.seam_repaired(rgb, 2), "emissive": H.emissive(rgb), "envmask": H.env_mask(rgb[..., 1], rgb[..., 2]), "roughness_aa": H.antialiased(alpha, n),
            "detail": H.overlaid(n, H.normals(rgb[..., 0])), "graded": K.lut_trilinear(rgb, cube, np.zeros(3), np.ones(3)), "doubled": K.resize(rgb, 8, 8, "cubic"),
        }

    return H.derive(_rasters(spark, sf_dir), make, 4, 4, 4, ("seamless", "emissive", "envmask", "roughness_aa", "detail", "graded", "doubled"))


@query()
def review_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lit sphere, before and after, and the heat of their difference, for 4 x 4 colour rasters."""

    def make(a: np.ndarray, material: str) -> dict[str, np.ndarray]:
        rgb, after = a[..., :3], K.resize(a[..., :3], 8, 8, "cubic")
        return {"sphere": W.lit_sphere(rgb, H.normals(a[..., 3]), a[..., 1], a[..., 2], 16), "strip": W.side_by_side(rgb, after), "heat": W.heat(rgb, after)}

    return H.derive(_rasters(spark, sf_dir), make, 4, 4, 4, ("sphere", "strip", "heat"))


@query()
def mip_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of 8 x 8 rasters as colour, roughness, mask and normal maps."""

    def make(a: np.ndarray, material: str) -> dict[str, np.ndarray]:
        rgb = np.repeat(a[..., None], 3, axis=2)
        out = {}
        for level, side in ((1, 4), (2, 2)):
            out |= {f"colour_{level}": H.mip(rgb, side, side, "albedo", level), f"roughness_{level}": H.mip(a, side, side, "roughness", level), f"mask_{level}": H.mip(a, side, side, "mask", level), f"normal_{level}": H.mip(rgb, side, side, "normal", level)}
        return out

    return H.derive(_rasters(spark, sf_dir), make, 8, 8, 1, tuple(f"{k}_{n}" for k in ("colour", "roughness", "mask", "normal") for n in (1, 2)))


def _dds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDS files of assets: some with bad sizes, no mips or no data."""
    n = lambda x: B.bytes_of(x.cast("long"))
    zero = lambda k: F.lit(b"\0" * k)
    key = F.col("asset_id")
    fourcc = F.when(key % 2 == 0, F.lit(b"DXT1")).otherwise(F.lit(b"ATI2"))
    raw = F.concat(
        F.lit(b"DDS "), n(F.when(key % 7 == 0, 0).otherwise(124)), n(F.lit(0x1007)), n(F.col("height")), n(F.col("width")), zero(8), n(key % 4), zero(44),
        n(F.when(key % 5 == 0, 0).otherwise(32)), n(F.lit(4)), fourcc, zero(20), n(F.when(key % 3 == 0, 0).otherwise(0x1000)), zero(16),
    )
    return V.assets(spark, sf_dir).select("asset_id", raw.alias("raw"))


CODEC = "CASE WHEN asset_id % 2 = 0 THEN 'bc1' ELSE 'bc5' END"


@query(WITH + f"""SELECT asset_id, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h, asset_id % 4 AS mips, {CODEC} AS codec,
  concat_ws(',', CASE WHEN asset_id % 7 = 0 THEN 'dds_header' END, CASE WHEN asset_id % 5 = 0 THEN 'dds_pixel_format' END, CASE WHEN asset_id % 3 = 0 THEN 'dds_caps_texture' END,
    CASE WHEN asset_id % 4 > 1 AND asset_id % 4 > floor(log2(greatest(width, height))) + 1 THEN 'dds_mip_count' END) AS issues FROM v_assets""")
def dds_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written and read again as bytes."""
    d = _dds(spark, sf_dir).withColumn("h", B.dds_header(F.col("raw")))
    return d.select("asset_id", F.col("h.width").alias("w"), F.col("h.height").alias("h"), F.col("h.mips").alias("mips"), F.col("h.codec").alias("codec"), F.array_join(B.dds_issues(F.col("raw")), ",").alias("issues"))


@query(WITH + f"""SELECT asset_id, greatest(asset_id % 4, 1) AS mips, CAST(greatest((width + 3) // 4, 1) * greatest((height + 3) // 4, 1) * CASE WHEN asset_id % 2 = 0 THEN 8 ELSE 16 END AS BIGINT) AS linear_size,
  CAST(CASE WHEN asset_id % 4 > 1 THEN 659463 ELSE 528391 END + 0 AS BIGINT) AS flags FROM v_assets""")
def dds_mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required sizes, flags, linear size and caps put into headers."""
    m = F.col("m")
    d = _dds(spark, sf_dir).select("asset_id", B.mended_dds(F.col("raw")).alias("m"))
    return d.select("asset_id", B.little(m, 28).alias("mips"), B.little(m, 20).alias("linear_size"), B.little(m, 8).alias("flags"))
