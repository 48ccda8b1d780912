"""Queries of boxes: source and placed boxes are derived from lineitem as the blueprint's data mapping says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import layout as L
from weftspark.plans.registry import query
from weftspark.plans.tables import table

ASSETS = "(SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 10 AS BIGINT) AS page, l_returnflag AS kind, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 600 AS DOUBLE) AS y0, CAST(l_partkey % 400 + 10 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 600 + 10 + l_quantity AS DOUBLE) AS y1, CAST(l_linenumber - 4 AS DOUBLE) AS shift, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem)"


def assets(spark: SparkSession, sf: str) -> DataFrame:
    c, d = F.col, lambda x: x.cast("double")
    return table(spark, sf, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_orderkey") % 10).cast("bigint").alias("page"), c("l_returnflag").alias("kind"), d(c("l_partkey") % 400).alias("x0"), d(c("l_suppkey") % 600).alias("y0"), d(c("l_partkey") % 400 + 10 + c("l_quantity")).alias("x1"), d(c("l_suppkey") % 600 + 10 + c("l_quantity")).alias("y1"), d(c("l_linenumber") - 4).alias("shift"), d(c("l_quantity")).alias("qty"))


@query("q_box_algebra", f"SELECT id, x1 - x0 AS width, (x0 + x1) / 2 AS cx, round((x1 - x0) * (y1 - y0), 4) AS area FROM {ASSETS}")
def n01(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).withColumn("b", L.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return a.select("id", (F.col("x1") - F.col("x0")).alias("width"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.round(L.area(F.col("b")), 4).alias("area"))


@query("q_geometry_check", f"SELECT id, abs(shift) AS error, abs(shift) <= 2 OR abs(shift) / least(x1 - x0, y1 - y0) * 100 <= 1 AS pass FROM {ASSETS}")
def v12(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf)
    src = L.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    put = L.box(*[F.col(c) + F.col("shift") for c in ("x0", "y0", "x1", "y1")])
    e = a.withColumn("error", F.round(L.corner_error(src, put), 9))
    return e.select("id", "error", L.within(F.col("error"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 2.0, 1.0).alias("pass"))


@query("q_coverage_by_kind", f"SELECT kind, count(*) AS total, count(*) FILTER (WHERE shift < 2) AS matched, round(count(*) FILTER (WHERE shift < 2) * 100.0 / count(*), 6) AS coverage FROM {ASSETS} GROUP BY kind")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf)
    return L.coverage(a, a.where("shift < 2"), ["kind"])


@query("q_coverage_by_page", f"SELECT page, count(*) AS total, count(*) FILTER (WHERE shift < 2) AS matched, round(count(*) FILTER (WHERE shift < 2) * 100.0 / count(*), 6) AS coverage FROM {ASSETS} GROUP BY page")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf)
    return L.coverage(a, a.where("shift < 2"), ["page"])


@query("q_error_stats", f"SELECT page, round(avg(abs(shift)), 6) AS mean, round(quantile_cont(abs(shift), 0.5), 6) AS median, max(abs(shift)) AS most, round(stddev_samp(abs(shift)), 6) AS sd FROM {ASSETS} GROUP BY page")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    e = F.abs("shift")
    return assets(spark, sf).groupBy("page").agg(F.round(F.avg(e), 6).alias("mean"), F.round(F.percentile(e, 0.5), 6).alias("median"), F.max(e).alias("most"), F.round(F.stddev_samp(e), 6).alias("sd"))


@query("q_systematic_shift", f"SELECT page, round(avg(shift), 6) AS mean_dx, round(stddev_samp(shift), 6) AS sd_dx, abs(avg(shift)) > 0.3 AND stddev_samp(shift) < 3 AS systematic_x FROM {ASSETS} GROUP BY page")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    s = L.systematic(assets(spark, sf).select("page", F.col("shift").alias("dx"), F.col("shift").alias("dy")), ["page"], 0.3, 3.0)
    return s.select("page", F.round("mean_dx", 6).alias("mean_dx"), F.round("sd_dx", 6).alias("sd_dx"), "systematic_x")


@query("q_histogram", f"SELECT CAST(least(floor((qty - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM {ASSETS}, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    return L.histogram(assets(spark, sf), "qty", 10)


@query("q_dpi_classes", f"SELECT CASE WHEN d < 250 THEN 'error' WHEN d < 300 THEN 'low' WHEN d < 350 THEN 'warning' WHEN d < 400 THEN 'good' ELSE 'excellent' END AS class, count(*) AS n FROM (SELECT qty * 10 / (x1 - x0) * 72 AS d FROM {ASSETS}) GROUP BY 1")
def v18(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("qty") * 10 / (F.col("x1") - F.col("x0")) * 72
    return assets(spark, sf).groupBy(L.dpi_class(d).alias("class")).agg(F.count("*").alias("n"))


@query("q_nearest_below", f"WITH a AS {ASSETS} SELECT DISTINCT a.page, a.id AS asset, min(b.y0) - a.y1 AS gap FROM a LEFT JOIN a b ON b.page = a.page AND b.kind = 'R' AND b.y0 >= a.y1 WHERE a.kind = 'A' GROUP BY a.page, a.id, a.y1")
def n06(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf)
    below = L.nearest_below(a.where("kind = 'A'").select("page", "id", F.col("y1").alias("at")), a.where("kind = 'R'").select("page", "id", F.col("y0").alias("at")), ["page"])
    return below.select("page", "asset", "gap").distinct()


@query("q_worst_errors", f"SELECT page, id, abs(shift) AS error FROM {ASSETS} QUALIFY row_number() OVER (PARTITION BY page ORDER BY abs(shift) DESC, id) <= 5")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy(F.desc(F.abs("shift")), "id")
    return assets(spark, sf).select("page", "id", F.abs("shift").alias("error"), F.row_number().over(w).alias("r")).where("r <= 5").drop("r")
