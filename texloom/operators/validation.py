"""Checks of processed assets: every rule gives the names of its findings; a driver joins them into one report row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.config import Validation
from texloom.functions import catalog as C
from texloom.functions import rasters as P
from texloom.functions import tables as T



def none() -> Column:
    return F.array().cast("array<string>")


def findings(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order; a test that is null does not hold."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def added(found: Column, more: Column) -> Column:
    """Entries of ``more`` that are not yet in ``found`` go behind it, in order."""
    return P.let(found, lambda f: F.concat(f, F.filter(F.array_distinct(more), lambda x: ~F.array_contains(f, x))))


@dataclass(frozen=True)
class Check:
    """Errors and warnings of one rule."""

    errors: Column
    warnings: Column


def strictly(issues: Column, strict: bool) -> Check:
    """Issues are errors if strict, else warnings."""
    return Check(issues, none()) if strict else Check(none(), issues)


def tiling(seam: Column, tileable: Column, s: Validation) -> Check:
    """A seam above the limit is an error; a poor quality score a warning, of two degrees."""
    quality = P.clip(1 - seam / max(2 * s.max_allowed_diff, 1e-6))
    errors = findings({"tiling_seam": tileable & (seam >= s.max_allowed_diff)})
    warnings = findings({"tiling_poor": tileable & (quality < s.fail_score), "tiling_below_target": tileable & (quality >= s.fail_score) & (quality < s.warn_score)})
    return Check(errors, warnings)


def normal_map(n: Column, s: Validation) -> Check:
    """``n``: decoded vectors struct(x, y, z). More than 1% non-finite, of wrong length or turned away is an error."""
    off = lambda v: F.abs(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]) - 1.0) > s.normal_tolerance
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = lambda n: findings({"normal_not_finite": F.exists(n, lambda v: odd(v["x"]) | odd(v["y"]) | odd(v["z"])), "normal_non_unit": P.share(n, off) > 0.01, "normal_negative_z": P.share(n, lambda v: v["z"] < 0) > 0.01})
    return Check(P.let(n, found), none())


def quality(name: Column, width: Column, height: Column, std: Column) -> Check:
    """Sizes and near-solid maps. Kinds of maps that may be uniform only warn, and at a lower limit."""
    uniform_ok = F.lit(False)
    for tag in T.UNIFORM_OK_TAGS:
        uniform_ok = uniform_ok | F.lower(name).contains(tag)
    solid = std < F.when(uniform_ok, F.lit(0.001)).otherwise(F.lit(0.004))
    errors = findings({"small": (width < 64) | (height < 64), "solid": solid & ~uniform_ok})
    return Check(errors, findings({"not_power_of_two": (width > 0) & (height > 0) & ~(C.is_power(width) & C.is_power(height)), "solid": solid & uniform_ok}))


def scalar_map(a: Column) -> Column:
    """struct(v, out_of_range): values clipped to [0, 1], and whether more than 1% lay clearly outside before."""
    return F.struct(F.transform(a, lambda x: P.clip(x)).alias("v"), (P.share(a, lambda x: (x < -0.01) | (x > 1.01)) > 0.01).alias("out_of_range"))


def material_semantics(category: Column, roughness: Column, metalness: Column, ao: Column, s: Validation) -> Check:
    """Roughness, metalness and occlusion against the material; a null map is not checked."""
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    c = F.when(c == "", F.lit("default")).otherwise(c)
    return strictly(findings({
        "roughness_flat": P.deviation(roughness) < s.roughness_min_stddev,
        "ao_flat": P.deviation(ao) < s.ao_min_stddev,
        "metalness_high": c.isin(*T.NON_METALS) & (P.mean(metalness) > s.metalness_nonmetal_max_mean),
        "metalness_low": c.isin(*T.METALS) & (P.mean(metalness) < s.metalness_metal_min_mean),
        "metalness_mid_range": P.share(metalness, lambda x: (x > 0.2) & (x < 0.8)) > s.metalness_midband_max_ratio,
    }), s.strict_material_semantics)


def albedo(luminance: Column, s: Validation) -> Check:
    """Linear luminance of the albedo within physical limits; a null map warns that nothing was checked."""
    found = strictly(findings({
        "albedo_black": P.share(luminance, lambda x: x < s.albedo_min) > s.black_ratio_max,
        "albedo_white": P.share(luminance, lambda x: x > s.albedo_max) > s.white_ratio_max,
        "albedo_near_zero": F.array_min(luminance) <= 0.001,
        "albedo_near_one": F.array_max(luminance) >= 0.999,
    }), s.strict_material_semantics)
    missing = findings({"albedo_missing": luminance.isNull()})
    return Check(found.errors, F.concat(missing, found.warnings))


def heuristic(kind: Column, has_pbr: Column, has_normal: Column, s: Validation) -> Check:
    """Maps derived from a colour map alone; silent unless asked to warn or fail."""
    if not (s.warn_on_heuristic_maps or s.fail_on_heuristic_maps):
        return Check(none(), none())
    colour = kind.isin("diffuse", "albedo", "unknown")
    return strictly(findings({"pbr_from_colour": colour & has_pbr, "normal_from_colour": colour & has_normal}), s.fail_on_heuristic_maps)


def regression(difference: Column, s: Validation) -> Check:
    """``difference``: mean absolute difference from the last output; null without one."""
    return Check(none(), findings({"regression": difference > s.regression_threshold}))


def reported(rows: DataFrame, own: list[Check], unique: list[Check]) -> DataFrame:
    """Rows with errors, warnings and passed. Errors of ``own`` checks are all listed, those of ``unique`` once; warnings once."""
    errors, warnings = none(), none()
    for c in own:
        errors, warnings = F.concat(errors, c.errors), added(warnings, c.warnings)
    for c in unique:
        errors, warnings = added(errors, c.errors), added(warnings, c.warnings)
    rows = rows.withColumns({"errors": errors, "warnings": warnings})
    return rows.withColumn("passed", F.size("errors") == 0)


def phase_failed(phase: Column, error: Column, passed: Column, errors: Column, issues: Column) -> Column:
    """Whether a phase's result counts as failed: its error, and what the two checking phases found."""
    checked = (phase == "validate") & (F.coalesce(~passed, F.lit(False)) | (F.coalesce(F.size(errors), F.lit(0)) > 0))
    written = (phase == "output_validation") & (F.coalesce(F.size(issues), F.lit(0)) > 0)
    return (F.coalesce(error, F.lit("")) != "") | checked | written


def report_lines(reports: DataFrame, key: str = "asset_id") -> DataFrame:
    """The text report as rows (section, key, place, line): totals first, then each failed asset with its errors.

    Sorted by these columns the lines are the report; nothing gathers all assets in one row.
    """
    totals = reports.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("e"))
    n, ok, e = F.col("n").cast("string"), F.col("ok").cast("string"), F.col("e").cast("string")
    heads = (F.concat(F.lit("Total assets: "), n), F.concat(F.lit("Passed: "), ok, F.lit("/"), n), F.concat(F.lit("Failed: "), (F.col("n") - F.col("ok")).cast("string"), F.lit("/"), n), F.concat(F.lit("Total errors: "), e), F.when(F.col("n") == F.col("ok"), F.lit("All assets passed validation.")).otherwise(F.lit("FAILED ASSETS:")))
    head = totals.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("key"), F.posexplode(F.array(*heads)).alias("place", "line"))
    lines = F.concat(F.array(F.concat(F.lit("  "), F.col(key).cast("string"), F.lit(":"))), F.transform("errors", lambda x: F.concat(F.lit("    ERROR: "), x)))
    body = reports.where(~F.col("passed")).select(F.lit(1).alias("section"), F.col(key).cast("long").alias("key"), F.posexplode(lines).alias("place", "line"))
    return head.unionByName(body)
