"""Queries of placed boxes and print checks; boxes are derived from lineitem as in queries_layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators import layout as L
from weftspark.operators import placement as P
from weftspark.plans.registry import query
from weftspark.plans.tables import table
from weftspark.queries_layout import ASSETS, assets

LABELS = f"(SELECT id + CASE WHEN shift = 3 THEN 100000000 ELSE 0 END AS id, page, x0 + shift AS x0, y0 + shift AS y0, x1 + shift * 2 AS x1, y1 + shift AS y1 FROM {ASSETS} WHERE shift <> -3)"
COLUMNS = "(SELECT unnest(range(10)) AS page, c AS column_id, c * 110.0 AS x0, c * 110.0 + 100 AS x1, 0.0 AS y0, 600.0 AS y1 FROM (SELECT unnest(range(4)) AS c))"


def boxed(spark: SparkSession, sf: str) -> DataFrame:
    return assets(spark, sf).withColumn("b", L.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).where("shift <> -3")
    s = F.col("shift")
    b = L.box(F.col("x0") + s, F.col("y0") + s, F.col("x1") + s * 2, F.col("y1") + s)
    return a.select((F.col("id") + F.when(s == 3, 100000000).otherwise(0)).alias("id"), "page", b.alias("b"))


def columns(spark: SparkSession) -> DataFrame:
    c = spark.range(10).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("column_id"))
    return c.select("page", "column_id", L.box(F.col("column_id") * 110.0, F.lit(0.0), F.col("column_id") * 110.0 + 100, F.lit(600.0)).alias("b"))


@query("q_assets_of_page", f"SELECT id, kind FROM {ASSETS} WHERE page = 3 AND kind = 'A'")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    """Filters by page and kind."""
    return assets(spark, sf).where("page = 3 AND kind = 'A'").select("id", "kind")


@query("q_first_by_id", f"SELECT id, page, kind FROM {ASSETS} WHERE id = (SELECT min(id) FROM {ASSETS}) LIMIT 1")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    """The first row with an id, in a fixed order."""
    a = assets(spark, sf)
    first = a.agg(F.min("id").alias("id"))
    return a.join(F.broadcast(first), "id").orderBy("page", "kind").limit(1).select("id", "page", "kind")


@query("q_page_reading_order", f"SELECT id, row_number() OVER (ORDER BY y0, x0, id) AS place FROM {ASSETS} WHERE page = 2 AND kind = 'R'")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of one page in reading order; one page is what one task orders."""
    return assets(spark, sf).where("page = 2 AND kind = 'R'").select("id", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "id")).cast("bigint").alias("place"))


@query("q_boxes_present", f"SELECT page, count(*) AS boxes FROM {ASSETS} WHERE CASE WHEN shift > 0 THEN x0 END IS NOT NULL GROUP BY page")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    b = boxed(spark, sf).withColumn("b", F.when(F.col("shift") > 0, F.col("b")))
    return b.where("b IS NOT NULL").groupBy("page").agg(F.count("*").alias("boxes"))


@query("q_last_label", "SELECT l_orderkey AS label, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    """Of labels with the same id the last one holds."""
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("qty"))
    return P.last_of(d, "label", ["line", "l_partkey", "l_suppkey", "qty"]).select("label", "line", "qty")


@query("q_orphan_labels", f"SELECT id FROM {LABELS} WHERE id NOT IN (SELECT id FROM {ASSETS})")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf).select("id").join(assets(spark, sf).select("id"), "id", "left_anti")


@query("q_label_errors", f"WITH a AS (SELECT * FROM {ASSETS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY x0 DESC, y0 DESC, x1 DESC, y1 DESC) = 1), l AS (SELECT * FROM {LABELS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY x0 DESC, y0 DESC, x1 DESC, y1 DESC) = 1) SELECT a.id, greatest(abs(a.x0 - l.x0), abs(a.y0 - l.y0), abs(a.x1 - l.x1), abs(a.y1 - l.y1)) AS error FROM a JOIN l ON a.id = l.id")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    """Assets met with the last label of their id, and the largest corner difference."""
    a = P.last_of(boxed(spark, sf).select("id", "b"), "id", ["b"])
    return a.join(P.last_of(labels(spark, sf).select("id", F.col("b").alias("l")), "id", ["l"]), "id").select("id", L.corner_error(F.col("b"), F.col("l")).alias("error"))


@query("q_first_match_by_hash", f"WITH s AS (SELECT id, md5(page || ':' || x0 || ':' || qty) AS h FROM {ASSETS} WHERE kind = 'A'), o AS (SELECT md5(page || ':' || x0 || ':' || qty) AS h, min(id) AS match_id FROM {ASSETS} WHERE kind = 'R' GROUP BY 1) SELECT s.id, o.match_id FROM s JOIN o USING (h)")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).withColumn("h", F.md5(F.concat_ws(":", "page", "x0", "qty")))
    first = a.where("kind = 'R'").groupBy("h").agg(F.min("id").alias("match_id"))
    return a.where("kind = 'A'").join(first, "h").select("id", "match_id")


MATCHED = f"(SELECT s.id, CASE WHEN e.p IS NOT NULL THEN 'hash' WHEN v.p IS NOT NULL THEN 'visual' ELSE 'none' END AS method, CAST(CASE WHEN e.p IS NOT NULL THEN 1.0 WHEN v.p IS NOT NULL THEN 0.96 ELSE 0.0 END AS DOUBLE) AS confidence FROM (SELECT * FROM {ASSETS} WHERE kind = 'A') s LEFT JOIN (SELECT page AS p, x0, qty FROM {ASSETS} WHERE kind = 'R' GROUP BY ALL) e ON e.p = s.page AND e.x0 = s.x0 AND e.qty = s.qty LEFT JOIN (SELECT page AS p, floor(x0 / 5) AS c, qty FROM {ASSETS} WHERE kind = 'R' GROUP BY ALL) v ON v.p = s.page AND v.c = floor(s.x0 / 5) AND v.qty = s.qty)"


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade: equal content, else alike (the same cell of a coarse grid), else none."""
    a = assets(spark, sf).select("id", "page", "kind", "x0", "qty", F.floor(F.col("x0") / 5).alias("c"))
    o = a.where("kind = 'R'")
    d = a.where("kind = 'A'").join(o.select("page", "x0", "qty", F.lit(1).alias("e")).distinct(), ["page", "x0", "qty"], "left").join(o.select("page", "c", "qty", F.lit(1).alias("v")).distinct(), ["page", "c", "qty"], "left")
    method = F.when(F.col("e") == 1, "hash").when(F.col("v") == 1, "visual").otherwise("none")
    return d.select("id", method.alias("method"), F.when(F.col("e") == 1, 1.0).when(F.col("v") == 1, 0.96).otherwise(0.0).alias("confidence"))


@query("q_match_cascade", f"SELECT id, method, confidence FROM {MATCHED}")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


@query("q_match_statistics", f"SELECT count(*) AS total, count(*) FILTER (WHERE method = 'hash') AS by_hash, count(*) FILTER (WHERE method = 'visual') AS by_look, round(count(*) FILTER (WHERE method <> 'none') * 1.0 / count(*), 6) AS rate, round(avg(confidence) FILTER (WHERE method <> 'none'), 6) AS confidence FROM {MATCHED}")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("method") != "none"
    return matched(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("method") == "hash").alias("by_hash"), F.count_if(F.col("method") == "visual").alias("by_look"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"), F.round(F.avg(F.when(hit, F.col("confidence"))), 6).alias("confidence"))


@query("q_metric_drift", "SELECT coalesce(c.k, b.k) AS metric, coalesce(b.n, 0) AS baseline, coalesce(c.n, 0) AS current, abs(coalesce(c.n, 0) - coalesce(b.n, 0)) <= 0.05 * greatest(coalesce(b.n, 0), 1) AS ok FROM (SELECT l_returnflag || l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b FULL JOIN (SELECT l_returnflag || l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) c ON b.k = c.k")
def v23(spark: SparkSession, sf: str) -> DataFrame:
    """Counts against a baseline, missing ones as 0, within five percent."""
    g = lambda s, n: table(spark, sf, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("metric")).agg(F.count("*").alias(n))
    d = g("F", "baseline").join(g("O", "current"), "metric", "full").fillna(0)
    return d.withColumn("ok", F.abs(F.col("current") - F.col("baseline")) <= 0.05 * F.greatest(F.col("baseline"), F.lit(1)))


@query("q_coverage_by_section", f"SELECT coalesce(nullif(split_part(CASE WHEN shift = 0 THEN 'p' ELSE 'p.' || kind || CAST(page AS VARCHAR) || '.x' END, '.', 2), ''), 'unknown') AS section, count(*) AS total, count(*) FILTER (WHERE shift < 2) AS matched, round(count(*) FILTER (WHERE shift < 2) * 100.0 / count(*), 6) AS coverage FROM {ASSETS} GROUP BY 1")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    anchor = F.when(F.col("shift") == 0, "p").otherwise(F.concat(F.lit("p."), "kind", F.col("page").cast("string"), F.lit(".x")))
    a = assets(spark, sf).withColumn("section", F.coalesce(F.nullif(F.split_part(anchor, F.lit("."), F.lit(2)), F.lit("")), F.lit("unknown")))
    return L.coverage(a, a.where("shift < 2"), ["section"])


@query("q_weighted_coverage", f"SELECT page, round(sum(CASE WHEN shift < 2 THEN w ELSE 0 END) / sum(w) * 100, 6) AS coverage FROM (SELECT page, shift, CASE kind WHEN 'A' THEN 2.0 WHEN 'R' THEN 1.5 ELSE 1.0 END * CASE WHEN (x1 - x0) * (y1 - y0) > 2500 THEN 2.0 WHEN greatest(x1 - x0, y1 - y0) > 40 THEN 1.5 ELSE 1.0 END AS w FROM {ASSETS}) GROUP BY page")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage weighted by kind and importance."""
    kinds = F.when(F.col("kind") == "A", 2.0).when(F.col("kind") == "R", 1.5).otherwise(1.0)
    a = boxed(spark, sf).withColumn("w", P.importance(F.col("b"), kinds, 40.0, 2500.0))
    return a.groupBy("page").agg(F.round(F.sum(F.when(F.col("shift") < 2, F.col("w")).otherwise(0.0)) / F.sum("w") * 100, 6).alias("coverage"))


DPI = f"(SELECT id, kind, least(qty * 100 / ((x1 - x0) / 72.0), qty * 90 / ((y1 - y0) / 72.0)) AS dpi FROM {ASSETS})"


def resolutions(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("b")
    return boxed(spark, sf).select("id", "kind", F.least(P.dpi(F.col("qty") * 100, P.width(b)), P.dpi(F.col("qty") * 90, P.height(b))).alias("dpi"))


@query("q_dpi_report", f"SELECT kind, count(*) AS images, round(min(dpi), 6) AS lowest, round(max(dpi), 6) AS highest, round(avg(dpi), 6) AS mean, round(quantile_cont(dpi, 0.5), 6) AS median, round(coalesce(stddev_samp(dpi), 0), 6) AS spread, count(*) FILTER (WHERE dpi < 250) AS errors FROM {DPI} GROUP BY kind")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """Resolution of each axis by the smaller, and its report."""
    r = resolutions(spark, sf)
    return r.groupBy("kind").agg(F.count("*").alias("images"), F.round(F.min("dpi"), 6).alias("lowest"), F.round(F.max("dpi"), 6).alias("highest"), F.round(F.avg("dpi"), 6).alias("mean"), F.round(F.percentile("dpi", 0.5), 6).alias("median"), F.round(F.coalesce(F.stddev_samp("dpi"), F.lit(0.0)), 6).alias("spread"), F.count_if(F.col("dpi") < 250).alias("errors"))


@query("q_worst_dpi", f"SELECT kind, id, round(dpi, 6) AS dpi FROM {DPI} QUALIFY row_number() OVER (PARTITION BY kind ORDER BY dpi, id) <= 5")
def t11(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("kind").orderBy("dpi", "id")
    return resolutions(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 5").select("kind", "id", F.round("dpi", 6).alias("dpi"))


@query("q_scale_errors", f"SELECT page, round(avg((x1 - x0 + shift) / (x1 - x0)), 6) AS width_ratio, abs(avg((x1 - x0 + shift) / (x1 - x0)) - 1) > 0.02 AS off FROM {ASSETS} GROUP BY page")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    r = F.avg(P.ratio(F.col("x1") - F.col("x0") + F.col("shift"), F.col("x1") - F.col("x0"), 1.0))
    return assets(spark, sf).groupBy("page").agg(F.round(r, 6).alias("width_ratio"), (F.abs(r - 1) > 0.02).alias("off"))


@query("q_error_categories", f"SELECT CASE WHEN e <= 2 THEN 'within' WHEN e <= 5 THEN 'minor' WHEN e <= 10 THEN 'moderate' ELSE 'severe' END AS category, count(*) AS n FROM (SELECT abs(shift) * 4 AS e FROM {ASSETS}) GROUP BY 1")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    e = F.abs("shift") * 4
    return assets(spark, sf).groupBy(F.when(e <= 2, "within").when(e <= 5, "minor").when(e <= 10, "moderate").otherwise("severe").alias("category")).agg(F.count("*").alias("n"))


@query("q_exclusive_quantile", f"SELECT page, round(CASE WHEN n < 20 THEN m ELSE lo + (hi - lo) * (0.95 * (n + 1) - floor(0.95 * (n + 1))) END, 6) AS p95 FROM (SELECT page, any_value(n) AS n, max(e) AS m, max(CASE WHEN r = floor(0.95 * (n + 1)) THEN e END) AS lo, max(CASE WHEN r = floor(0.95 * (n + 1)) + 1 THEN e END) AS hi FROM (SELECT page, qty AS e, row_number() OVER (PARTITION BY page ORDER BY qty) AS r, count(*) OVER (PARTITION BY page) AS n FROM {ASSETS}) GROUP BY page)")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """The exclusive 95th percentile of each page: places (n + 1) * 0.95 between order statistics, taken from counts of distinct values."""
    c = assets(spark, sf).groupBy("page", "qty").agg(F.count("*").alias("c"))
    w = Window.partitionBy("page").orderBy("qty")
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("page")))
    at = 0.95 * (F.col("n") + 1)
    holds = lambda r: F.min(F.when(F.col("upto") >= r, F.col("qty")))
    g = c.groupBy("page").agg(F.any_value("n").alias("n"), F.max("qty").alias("m"), holds(F.floor(at)).alias("lo"), holds(F.floor(at) + 1).alias("hi"))
    return g.select("page", F.round(F.when(F.col("n") < 20, F.col("m")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))), 6).alias("p95"))


@query("q_color_audit", "SELECT l_linestatus AS target, count(*) AS images, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS disallowed, count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount = 0) AS without_profile FROM lineitem GROUP BY 1")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by target colour space, conversions that aren't allowed, and missing profiles."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("target")).agg(F.count("*").alias("images"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("disallowed"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_discount") == 0)).alias("without_profile"))


@query("q_font_audit", "SELECT 'font' || (l_suppkey % 10) AS font, count(*) AS uses, count(*) FILTER (WHERE l_linestatus = 'F') AS embedded, count(*) FILTER (WHERE l_returnflag = 'R') AS subset, bool_and(l_linestatus = 'F' AND l_returnflag = 'R') AS printable, array_to_string(list_sort(list(DISTINCT l_orderkey % 10)), ',') AS pages FROM lineitem GROUP BY 1")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    """Fonts by name with their sets of pages (A26, A27); a set of pages is bounded by a document's pages."""
    f = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("font"), (F.col("l_suppkey") % 10).cast("string")).alias("font"))
    return f.agg(F.count("*").alias("uses"), F.count_if(F.col("l_linestatus") == "F").alias("embedded"), F.count_if(F.col("l_returnflag") == "R").alias("subset"), F.bool_and((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("printable"), F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey") % 10)), ",").alias("pages"))


@query("q_geometry_report", f"SELECT page, count(*) AS evaluated, round(count(*) FILTER (WHERE abs(shift) <= 2) * 100.0 / count(*), 6) AS pass_rate, max(abs(shift)) FILTER (WHERE abs(shift) > 2) AS worst, round(avg(abs(shift)) FILTER (WHERE abs(shift) > 2), 6) AS mean FROM {ASSETS} GROUP BY page")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    e = F.abs("shift")
    bad = F.when(e > 2, e)
    return assets(spark, sf).groupBy("page").agg(F.count("*").alias("evaluated"), F.round(F.count_if(e <= 2) * 100.0 / F.count("*"), 6).alias("pass_rate"), F.max(bad).alias("worst"), F.round(F.avg(bad), 6).alias("mean"))


NEAREST = f"(WITH a AS {ASSETS} SELECT a.page, a.id AS asset, min(b.y0) FILTER (WHERE b.y0 >= a.y1) - a.y1 AS below, a.y0 - max(b.y1) FILTER (WHERE b.y1 <= a.y0) AS above FROM a LEFT JOIN a b ON b.page = a.page AND b.kind = 'R' WHERE a.kind = 'A' GROUP BY a.page, a.id, a.y0, a.y1)"


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).select("page", "id", "kind", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return P.nearest_block(a.where("kind = 'A'").drop("kind"), a.where("kind = 'R'").drop("kind"), ["page"])


@query("q_nearest_block", f"SELECT DISTINCT page, asset, coalesce(below, above) AS gap, CASE WHEN below IS NOT NULL THEN 'below' WHEN above IS NOT NULL THEN 'above' ELSE 'none' END AS side FROM {NEAREST}")
def n06(spark: SparkSession, sf: str) -> DataFrame:
    """Below preferred, else above."""
    return anchored(spark, sf).distinct()


@query("q_anchoring_report", f"SELECT page, count(*) AS assets, round(count(gap) * 1.0 / count(*), 6) AS success FROM (SELECT DISTINCT page, asset, coalesce(below, above) AS gap, below IS NULL AS side FROM {NEAREST}) GROUP BY page")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return anchored(spark, sf).distinct().groupBy("page").agg(F.count("*").alias("assets"), F.round(F.count_if(F.col("side") != "none") / F.count("*"), 6).alias("success"))


@query("q_ambiguous_nearest", f"SELECT page, \"at\", count(*) AS rivals FROM (SELECT page, y0 AS \"at\", y0 - min(y0) OVER (PARTITION BY page, kind) AS d FROM {ASSETS} WHERE kind = 'R') WHERE d <= 1 GROUP BY page, \"at\"")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks within one point of the nearest: the minimum comes from a partial aggregate, no window over a page."""
    r = assets(spark, sf).where("kind = 'R'").select("page", F.col("y0").alias("at"))
    near = r.groupBy("page").agg(F.min("at").alias("least"))
    return r.join(near, "page").where(F.col("at") - F.col("least") <= 1).groupBy("page", "at").agg(F.count("*").alias("rivals"))


@query("q_tolerance_summary", f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE abs(shift) <= least(2.0, greatest(x1 - x0, y1 - y0) * 0.01)) AS strict_pass, count(*) FILTER (WHERE abs(shift) <= greatest(2.0, greatest(x1 - x0, y1 - y0) * 0.01)) AS loose_pass FROM {ASSETS} GROUP BY kind")
def a41(spark: SparkSession, sf: str) -> DataFrame:
    """The stricter and the looser tolerance side by side."""
    e, b = F.abs("shift"), F.col("b")
    return boxed(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(e <= P.tolerance(b)).alias("strict_pass"), F.count_if(e <= P.tolerance(b, strict=False)).alias("loose_pass"))


@query("q_systematic_offset", f"SELECT page, count(*) AS failing, round(avg(shift), 6) AS offset_x FROM {ASSETS} WHERE shift > 2 OR shift < -2 GROUP BY page HAVING count(*) >= 4 AND abs(avg(shift)) > 0.05")
def v13(spark: SparkSession, sf: str) -> DataFrame:
    g = assets(spark, sf).where("abs(shift) > 2").groupBy("page").agg(F.count("*").alias("failing"), F.avg("shift").alias("m"))
    return g.where((F.col("failing") >= 4) & (F.abs("m") > 0.05)).select("page", "failing", F.round("m", 6).alias("offset_x"))


@query("q_centre_errors", f"SELECT id, shift * 1.5 AS dx, shift AS dy, abs(shift * 1.5) AS error, round(abs(shift * 1.5) / greatest(x1 - x0, y1 - y0), 6) AS relative, round((x1 - x0 + shift) / (x1 - x0), 6) AS width_ratio, abs(shift * 1.5) <= least(2.0, greatest(x1 - x0, y1 - y0) * 0.01) AS passed FROM {ASSETS}")
def v14(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("shift")
    put = L.box(F.col("x0") + s, F.col("y0") + s, F.col("x1") + s * 2, F.col("y1") + s)
    e = boxed(spark, sf).select("id", P.centre_error(F.col("b"), put).alias("e"))
    return e.select("id", "e.dx", "e.dy", "e.error", F.round("e.relative", 6).alias("relative"), F.round("e.width_ratio", 6).alias("width_ratio"), "e.passed")


@query("q_aspect_kept", f"SELECT kind, count(*) FILTER (WHERE abs((x1 - x0 + shift) / (y1 - y0) - (x1 - x0) / (y1 - y0)) / ((x1 - x0) / (y1 - y0)) <= 0.05) AS kept, count(*) AS n FROM {ASSETS} GROUP BY kind")
def v16(spark: SparkSession, sf: str) -> DataFrame:
    put = L.box(F.col("x0"), F.col("y0"), F.col("x1") + F.col("shift"), F.col("y1"))
    return boxed(spark, sf).groupBy("kind").agg(F.count_if(P.same_aspect(F.col("b"), put, 0.05)).alias("kept"), F.count("*").alias("n"))


CTM = f"(SELECT id, shift AS a, 0.0 AS b, 0.0 AS c, CASE WHEN qty > 40 THEN 200.0 ELSE 1.0 END AS d, x0 * 100 AS e, y0 AS f FROM {ASSETS})"


@query("q_matrix_faults", f"SELECT fault, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN abs(a * d) < 1e-6 THEN 'singular' END, CASE WHEN abs(a) > 100 THEN 'x scale too large' END, CASE WHEN abs(a) < 0.01 THEN 'x scale too small' END, CASE WHEN abs(d) > 100 THEN 'y scale too large' END, CASE WHEN abs(d) < 0.01 THEN 'y scale too small' END, CASE WHEN abs(e) > 10000 THEN 'x translation' END, CASE WHEN abs(f) > 10000 THEN 'y translation' END], lambda x: x IS NOT NULL)) AS fault FROM {CTM}) GROUP BY fault")
def v24(spark: SparkSession, sf: str) -> DataFrame:
    m = F.array(F.col("shift"), F.lit(0.0), F.lit(0.0), F.when(F.col("qty") > 40, 200.0).otherwise(1.0), F.col("x0") * 100, F.col("y0"))
    return assets(spark, sf).select(F.explode(P.matrix_faults(m)).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("q_placement_scale", f"SELECT id, abs(shift) AS scale_x, round(CASE WHEN qty <> 0 OR shift <> 0 THEN degrees(atan2(qty, shift)) ELSE 0 END, 6) AS rotation FROM {ASSETS}")
def n08(spark: SparkSession, sf: str) -> DataFrame:
    """Scale and rotation of a transformation."""
    a, b = F.col("shift"), F.col("qty")
    return assets(spark, sf).select("id", F.abs(a).alias("scale_x"), F.round(F.when((b != 0) | (a != 0), F.degrees(F.atan2(b, a))).otherwise(0.0), 6).alias("rotation"))


@query("q_bounds_faults", f"SELECT id, CASE WHEN x0 + shift * 2 < -2 OR x1 + shift * 2 > 442 THEN 'horizontal range' WHEN 640 - y1 < -2 OR 640 - y0 > 642 THEN 'vertical range' END AS fault FROM {ASSETS} WHERE x0 + shift * 2 < -2 OR x1 + shift * 2 > 442 OR 640 - y1 < -2 OR 640 - y0 > 642")
def v28(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds in a flipped page (N07) and the first rule they break."""
    s = F.col("shift") * 2
    put = L.box(F.col("x0") + s, F.col("y0"), F.col("x1") + s, F.col("y1"))
    return assets(spark, sf).select("id", P.bounds_fault(P.flipped(put, 640.0), 440.0, 640.0).alias("fault")).where("fault IS NOT NULL")


@query("q_box_consistency", f"SELECT kind, count(*) FILTER (WHERE abs(shift) > 2 AND abs(shift) / greatest(x1 - x0, y1 - y0) > 0.01) AS inconsistent, count(*) FILTER (WHERE abs(shift) <= 2) AS accurate FROM {ASSETS} GROUP BY kind")
def v25(spark: SparkSession, sf: str) -> DataFrame:
    """A box rebuilt from its normalised form against where it was put (V25, V26, V29): wrong only beyond both tolerances."""
    page = L.box(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(800.0))
    again = P.denormalized(P.normalized(F.col("b"), page), page)
    e = boxed(spark, sf).withColumn("r", again).withColumn("put", L.box(*[F.col(f"r.{c}") + F.col("shift") for c in ("x0", "y0", "x1", "y1")])).withColumn("e", F.round(L.corner_error(F.col("b"), F.col("put")), 6))
    return e.groupBy("kind").agg(F.count_if((F.col("e") > 2) & (F.col("e") / F.greatest(P.width(F.col("b")), P.height(F.col("b"))) > 0.01)).alias("inconsistent"), F.count_if(F.col("e") <= 2).alias("accurate"))


@query("q_normalized_boxes", f"SELECT id, round(least(1, greatest(0, x0 / 300)), 6) AS x, round(least(1, greatest(0, y0 / 600)), 6) AS y, round(least(1, (x1 - x0) / 300), 6) AS w, round(least(1, (y1 - y0) / 600), 6) AS h FROM {ASSETS} WHERE x0 / 300 BETWEEN -0.01 AND 1.01 AND y0 / 600 BETWEEN -0.01 AND 1.01")
def n02(spark: SparkSession, sf: str) -> DataFrame:
    n = boxed(spark, sf).select("id", P.normalized(F.col("b"), L.box(F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(600.0))).alias("n")).where("n IS NOT NULL")
    return n.select("id", *[F.round(f"n.{c}", 6).alias(c) for c in "xywh"])


@query("q_asset_columns", f"SELECT id, column_id, round(share, 6) AS share FROM (SELECT a.id, c.column_id, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / (a.x1 - a.x0) AS share FROM (SELECT DISTINCT id, page, x0, x1 FROM {ASSETS}) a JOIN {COLUMNS} c ON c.page = a.page) WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, column_id) = 1")
def n05(spark: SparkSession, sf: str) -> DataFrame:
    """The column of each asset by overlap."""
    a = boxed(spark, sf).select("id", "page", "b")
    d = P.columns_of(a, columns(spark))
    return d.groupBy("id").agg(F.max_by("column_id", F.struct("share", -F.col("column_id"))).alias("column_id"), F.round(F.max("share"), 6).alias("share"))


@query("q_anchor_settings", f"SELECT CASE WHEN r < 0.33 THEN 'left' WHEN r > 0.67 THEN 'right' ELSE 'center' END AS align, count(*) AS n, round(sum(CASE WHEN r < 0.33 THEN x0 WHEN r > 0.67 THEN x1 - 440 ELSE (x0 + x1) / 2 - 220 END), 3) AS offsets FROM (SELECT x0, x1, (x0 + x1) / 2 / 440 AS r FROM {ASSETS}) GROUP BY 1")
def n12(spark: SparkSession, sf: str) -> DataFrame:
    s = boxed(spark, sf).select(P.anchor_settings(F.col("b"), L.box(F.lit(0.0), F.lit(0.0), F.lit(440.0), F.lit(600.0))).alias("s"))
    return s.groupBy("s.align").agg(F.count("*").alias("n"), F.round(F.sum("s.x_offset"), 3).alias("offsets"))


@query("q_detected_columns", f"SELECT page, row_number() OVER (PARTITION BY page ORDER BY run) - 1 AS column_id, min(x0) AS x_min, max(x1) AS x_max, count(*) AS blocks FROM (SELECT page, x0, x1, sum(new) OVER (PARTITION BY page ORDER BY mid, id) AS run FROM (SELECT page, id, x0, x1, mid, CASE WHEN mid - lag(mid) OVER (PARTITION BY page ORDER BY mid, id) <= 3 THEN 0 ELSE 1 END AS new FROM (SELECT page, id, x0, x1, (x0 + x1) / 2 AS mid FROM {ASSETS} WHERE y0 < 20 AND kind = 'A'))) GROUP BY page, run HAVING count(*) >= 3")
def n03(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the boxes in a page's head."""
    return P.column_runs(boxed(spark, sf).where("y0 < 20 AND kind = 'A'"), 3.0, 3).withColumn("column_id", F.col("column_id").cast("bigint"))


@query("q_page_masks", f"SELECT page, count(*) AS cells FROM (SELECT DISTINCT page, i, unnest(range(CAST(floor(y0 / 10) AS BIGINT), CAST(ceil(y1 / 10) AS BIGINT))) AS j FROM (SELECT page, y0, y1, unnest(range(CAST(floor(x0 / 10) AS BIGINT), CAST(ceil(x1 / 10) AS BIGINT))) AS i FROM {ASSETS} WHERE kind = 'N')) GROUP BY page")
def n13(spark: SparkSession, sf: str) -> DataFrame:
    return P.masked_cells(boxed(spark, sf).where("kind = 'N'").select("page", "b").distinct(), 10.0)


@query("q_completeness", f"SELECT (SELECT count(DISTINCT id) FROM {ASSETS}) AS total, (SELECT count(DISTINCT id) FROM {ASSETS} WHERE id IN (SELECT id FROM {LABELS})) AS matched, (SELECT count(DISTINCT id) FROM {ASSETS} WHERE id NOT IN (SELECT id FROM {LABELS})) AS missing, (SELECT count(DISTINCT id) FROM {LABELS} WHERE id NOT IN (SELECT id FROM {ASSETS})) AS extra")
def v11(spark: SparkSession, sf: str) -> DataFrame:
    return P.completeness(assets(spark, sf), labels(spark, sf), 95.0).select("total", "matched", "missing", "extra")


@query("q_assignment_check", f"SELECT count(*) FILTER (WHERE c > 1) AS duplicates, (SELECT count(DISTINCT id) FROM {ASSETS} WHERE id NOT IN (SELECT id FROM {LABELS})) AS missing, count(*) FILTER (WHERE id NOT IN (SELECT id FROM {ASSETS})) AS unknown FROM (SELECT id, count(*) AS c FROM {LABELS} GROUP BY id)")
def u07(spark: SparkSession, sf: str) -> DataFrame:
    """Ids assigned twice, never, or unknown, from one full join of counted ids."""
    l, a = labels(spark, sf).groupBy("id").agg(F.count("*").alias("c")), assets(spark, sf).select("id").distinct().withColumn("a", F.lit(1))
    return l.join(a, "id", "full").agg(F.count_if(F.col("c") > 1).alias("duplicates"), F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unknown"))


@query("q_id_union", f"SELECT count(*) AS ids FROM (SELECT id FROM {ASSETS} UNION SELECT id FROM {LABELS})")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    return assets(spark, sf).select("id").union(labels(spark, sf).select("id")).distinct().agg(F.count("*").alias("ids"))


@query("q_placement_rules", f"SELECT id, r AS rule FROM (SELECT id, unnest(list_filter([CASE WHEN greatest(0, least(x1, 220) - greatest(x0, 0)) / (x1 - x0) < 0.5 THEN 'column' END, CASE WHEN (qty * 100 / ((x1 - x0) / 72.0) + qty * 90 / ((y1 - y0) / 72.0)) / 2 < 2000 THEN 'low dpi' END, CASE WHEN abs(qty * 100 / ((x1 - x0) / 72.0) - qty * 90 / ((y1 - y0) / 72.0)) > 500 THEN 'uneven dpi' END, CASE WHEN x0 / 390 > 1 THEN 'coordinates' END, CASE WHEN NOT regexp_full_match('img-' || id, 'img-[0-9]{{4,6}}') THEN 'id' END], lambda x: x IS NOT NULL)) AS r FROM {ASSETS})")
def v27(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold rules on column, resolution, coordinates and id, a row for each broken one."""
    b = F.col("b")
    dx, dy = P.dpi(F.col("qty") * 100, P.width(b)), P.dpi(F.col("qty") * 90, P.height(b))
    rules = F.array(
        F.when(P.column_overlap(b, L.box(F.lit(0.0), F.lit(0.0), F.lit(220.0), F.lit(600.0))) < 0.5, "column"), F.when((dx + dy) / 2 < 2000, "low dpi"), F.when(F.abs(dx - dy) > 500, "uneven dpi"),
        F.when(F.col("x0") / 390 > 1, "coordinates"), F.when(~F.concat(F.lit("img-"), F.col("id").cast("string")).rlike("^img-[0-9]{4,6}$"), "id"),
    )
    return boxed(spark, sf).select("id", F.explode(F.array_compact(rules)).alias("rule"))


@query("q_asset_ids", f"SELECT id, 'img-' || substr(sha256(CAST(qty AS BIGINT)::VARCHAR), 1, 12) || '-p' || page || '-occ' || shift::BIGINT AS asset_id, bit_count(xor(id, page)) AS distance FROM {ASSETS}")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    """Asset ids from content hash, page and occurrence (H05), and the distance of two bit strings."""
    return assets(spark, sf).select("id", F.format_string("img-%s-p%d-occ%d", F.substring(F.sha2(F.col("qty").cast("bigint").cast("string"), 256), 1, 12), "page", F.col("shift").cast("bigint")).alias("asset_id"), F.bit_count(F.col("id").bitwiseXOR(F.col("page"))).alias("distance"))


@query("q_block_ids", "SELECT l_orderkey AS doc, l_linenumber AS line, lower(l_returnflag) || '.' || lower(l_linestatus) || '.' || printf('%03d', row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey)) AS block_id FROM lineitem")
def w02(spark: SparkSession, sf: str) -> DataFrame:
    """Counters by document, kind and section."""
    w = Window.partitionBy("l_orderkey", "l_returnflag", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.format_string("%s.%s.%03d", F.lower("l_returnflag"), F.lower("l_linestatus"), F.row_number().over(w)).alias("block_id"))


@query("q_status_labels", f"SELECT page, printf('%.1f%%', c) AS label, CASE WHEN c >= 100 THEN 'perfect' WHEN c >= 98 THEN 'excellent' WHEN c >= 95 THEN 'good' WHEN c >= 90 THEN 'acceptable' ELSE 'poor' END AS status, least(60.0, 2.0 * power(2, page)) AS delay, ((8000 - 500) // (page + 1)) * 4 AS chunk FROM (SELECT page, count(*) FILTER (WHERE shift < 3) * 100.0 / count(*) AS c FROM {ASSETS} GROUP BY page)")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a share (F22), a capped delay (H20), a chunk size from a window."""
    d = assets(spark, sf).groupBy("page").agg(P.ratio(F.count_if(F.col("shift") < 3) * 100.0, F.count("*").cast("double")).alias("c"))
    c = F.col("c")
    status = F.when(c >= 100, "perfect").when(c >= 98, "excellent").when(c >= 95, "good").when(c >= 90, "acceptable").otherwise("poor")
    return d.select("page", F.format_string("%.1f%%", c).alias("label"), status.alias("status"), F.least(F.lit(60.0), 2.0 * F.pow(F.lit(2.0), "page")).alias("delay"), (F.floor(F.lit(7500) / (F.col("page") + 1)) * 4).alias("chunk"))
