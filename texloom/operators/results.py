"""Relations over phase results: precedence of outputs, summaries, failure ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_path(*columns: str) -> Column:
    """The first of the paths that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


#: Which phases' outputs stand for a map, best first.
PRECEDENCE = {
    "base": ("packed", "repaired_base", "upscaled", "filepath"),
    "albedo": ("graded", "corrected", "repaired", "pbr_albedo"),
    "roughness": ("rough_aa", "rough"),
    "normal": ("normal_detail", "normal_map"),
    "height": ("height_pom", "height_map"),
}
POSTPROCESS_ALBEDO = ("repaired", "pbr_albedo", "repaired_base", "upscaled")
VIEWER_ALBEDO = ("graded", "repaired", "corrected", "pbr_albedo")


def resolved(outputs: DataFrame, key: str = "asset_id") -> DataFrame:
    """One row per asset with the path that stands for each map."""
    return outputs.select(key, *[first_path(*paths).alias(name) for name, paths in PRECEDENCE.items()])


def summary(results: DataFrame) -> DataFrame:
    """Per phase: skipped before failed before processed."""
    state = F.when(F.col("skipped"), "skipped").when(F.col("failed"), "failed").otherwise("processed")
    return results.groupBy("phase").agg(*[F.count_if(state == s).alias(s) for s in ("processed", "skipped", "failed")])


def fallback_rollup(rows: DataFrame, key: str = "asset_id", examples: int = 5) -> DataFrame:
    """Per group: how many fell back, the first keys, and the distinct reasons.

    Smallest keys are kept in a bounded heap per task, never a whole group.
    """
    ranked = rows.select("phase", "reason", F.col(key).alias("k"))
    counts = ranked.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    top = ranked.select("phase", "k").distinct().withColumn("r", F.row_number().over(Window.partitionBy("phase").orderBy("k"))).where(F.col("r") <= examples)
    top = top.groupBy("phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ", ").alias("examples"))
    return counts.join(top, "phase")
