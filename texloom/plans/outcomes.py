"""Queries on phase results: precedence, summaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import tables as T
from texloom.operators import results as R
from texloom.plans import views as V
from texloom.plans.registry import query

OUT, RES = f"WITH {V.OUTPUTS_SQL} ", f"WITH {V.RESULTS_SQL} "
_first = lambda cs: "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cs) + ")"


@query(OUT + "SELECT asset_id, " + ", ".join(f"{_first(cs)} AS {n}" for n, cs in R.PRECEDENCE.items()) + " FROM v_outputs")
def map_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 J2 F43."""
    return R.resolved(V.outputs(spark, sf_dir))


@query(OUT + f"SELECT asset_id, {_first(R.POSTPROCESS_ALBEDO)} AS postprocess, {_first(R.VIEWER_ALBEDO)} AS viewer FROM v_outputs")
def albedo_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 J4."""
    return V.outputs(spark, sf_dir).select("asset_id", R.first_path(*R.POSTPROCESS_ALBEDO).alias("postprocess"), R.first_path(*R.VIEWER_ALBEDO).alias("viewer"))


@query(OUT + f"""SELECT asset_id, m.suffix, m.kind, m.mip FROM (SELECT asset_id, {_first(R.PRECEDENCE['albedo'])} AS albedo, {_first(R.PRECEDENCE['roughness'])} AS roughness FROM v_outputs) o,
  (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in T.MAPS)}) m(suffix, kind, mip) WHERE m.suffix = '' OR (m.suffix = '_albedo' AND albedo IS NOT NULL) OR (m.suffix = '_roughness' AND roughness IS NOT NULL)""")
def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of each asset that have a source."""
    maps = spark.createDataFrame(list(T.MAPS), "suffix string, kind string, mip string")
    o = R.resolved(V.outputs(spark, sf_dir)).select("asset_id", F.explode(F.array(
        F.struct(F.lit("").alias("suffix"), F.lit(True).alias("has")), F.struct(F.lit("_albedo").alias("suffix"), F.col("albedo").isNotNull().alias("has")), F.struct(F.lit("_roughness").alias("suffix"), F.col("roughness").isNotNull().alias("has")))).alias("m"))
    return o.where("m.has").select("asset_id", "m.suffix").join(F.broadcast(maps), "suffix").select("asset_id", "suffix", "kind", "mip")


_n = lambda c: f"CAST(count_if({c}) AS BIGINT)"


@query(RES + f"SELECT phase, {_n('NOT skipped AND NOT failed')} AS processed, {_n('skipped')} AS skipped, {_n('failed AND NOT skipped')} AS failed FROM v_results GROUP BY phase")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 P13."""
    return R.summary(V.results(spark, sf_dir))


@query(RES + f"SELECT count(*) AS assets, {_n('bad')} AS failed, {_n('NOT bad')} AS passed, CAST(sum(errors) AS BIGINT) AS errors FROM (SELECT asset_id, bool_or(failed) AS bad, count_if(failed) AS errors FROM v_results GROUP BY asset_id)")
def failed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 A5 A9 A6."""
    per = V.results(spark, sf_dir).groupBy("asset_id").agg(F.bool_or("failed").alias("bad"), F.count_if("failed").alias("errors"))
    return per.agg(F.count(F.lit(1)).alias("assets"), F.count_if("bad").alias("failed"), F.count_if(~F.col("bad")).alias("passed"), F.sum("errors").alias("errors"))


@query(RES + """SELECT phase, n, reasons, examples FROM (SELECT phase, count(*) AS n, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS reasons FROM v_results WHERE failed GROUP BY phase)
  JOIN (SELECT phase, string_agg(CAST(asset_id AS VARCHAR), ', ' ORDER BY asset_id) AS examples FROM (SELECT phase, asset_id, row_number() OVER (PARTITION BY phase ORDER BY asset_id) AS r FROM (SELECT DISTINCT phase, asset_id FROM v_results WHERE failed)) WHERE r <= 5 GROUP BY phase) USING (phase)""")
def fallback_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 O6 U2."""
    return R.fallback_rollup(V.results(spark, sf_dir).where("failed").withColumn("reason", F.col("kind")))


@query(RES + """SELECT phase, status || ': ' || CAST(n AS VARCHAR) || ' (' || kinds || ')' AS line FROM (SELECT phase, CASE WHEN failed THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v_results GROUP BY ALL)""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 K10."""
    r = V.results(spark, sf_dir).groupBy("phase", F.when(F.col("failed"), "FAIL").otherwise("PASS").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return r.select("phase", F.concat("status", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), "kinds", F.lit(")")).alias("line"))


@query(RES + "SELECT asset_id, count(DISTINCT (CAST(metric AS INT) % 3, event_id % 2)) AS sizes FROM v_results GROUP BY asset_id HAVING count(DISTINCT (CAST(metric AS INT) % 3, event_id % 2)) > 1")
def dims_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets whose maps differ in size."""
    size = F.struct((F.bround("metric", 0).cast("int") % 3).alias("w"), (F.col("event_id") % 2).alias("h"))
    return V.results(spark, sf_dir).groupBy("asset_id").agg(F.count_distinct(size).alias("sizes")).where("sizes > 1")


@query(RES + "SELECT phase, event_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, phase ORDER BY ts DESC, event_id DESC) AS r FROM v_results) WHERE r = 1")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each asset and phase."""
    last = V.results(spark, sf_dir).groupBy("asset_id", "phase").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("phase", F.col("m.event_id").alias("event_id"), "asset_id")


@query("SELECT p.p_partkey AS asset_id, coalesce(o.n, 0) AS outputs, CASE WHEN o.n IS NULL THEN 'missing' WHEN o.n > 10 THEN 'done' ELSE 'partial' END AS status FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) o ON o.l_partkey = p.p_partkey")
def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with defaults for those without outputs."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("asset_id")).agg(F.count(F.lit(1)).alias("n"))
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("asset_id")).join(n, "asset_id", "left")
    return a.select("asset_id", F.coalesce("n", F.lit(0)).alias("outputs"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 10, "done").otherwise("partial").alias("status"))
