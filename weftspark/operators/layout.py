"""Boxes: algebra, matching of placed and source boxes, errors, resolution and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def corner_error(a: Column, b: Column) -> Column:
    """Largest difference of a coordinate."""
    return F.greatest(*[F.abs(a[c] - b[c]) for c in ("x0", "y0", "x1", "y1")])


def within(error: Column, width: Column, height: Column, points: float, percent: float) -> Column:
    """Passes if the error is within the points, or within the percentage of the smaller side."""
    return (error <= points) | (error / F.least(width, height) * 100 <= percent)


def coverage(source: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """total, matched and percentage by group; ids placed twice count once; an empty group has no row."""
    p = placed.select("id").distinct().withColumn("_p", F.lit(1))
    g = source.join(p, "id", "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("_p").alias("matched"))
    return g.withColumn("coverage", F.round(F.col("matched") * 100.0 / F.col("total"), 6))


def systematic(errors: DataFrame, by: list[str], least_mean: float = 1.0, most_spread: float = 2.0) -> DataFrame:
    """Groups whose mean shift in x or y is large while its spread is small."""
    g = errors.groupBy(*by).agg(F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"), F.stddev_samp("dx").alias("sd_dx"), F.stddev_samp("dy").alias("sd_dy"))
    off = lambda c: F.coalesce((F.abs(F.col(f"mean_{c}")) > least_mean) & (F.col(f"sd_{c}") < most_spread), F.lit(False))
    return g.withColumn("systematic_x", off("dx")).withColumn("systematic_y", off("dy"))


def dpi_class(dpi: Column) -> Column:
    return F.when(dpi < 250, "error").when(dpi < 300, "low").when(dpi < 350, "warning").when(dpi < 400, "good").otherwise("excellent")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal widths from min to max, the last closed; one bin where min equals max."""
    top = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(top))  # one row
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return d.groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def nearest_below(assets: DataFrame, blocks: DataFrame, by: list[str], step: float = 50.0) -> DataFrame:
    """(asset, block, gap): the block that begins soonest at or after the asset's end in its group; ties by id.

    An as-of join without pairs: both sides are cut into stretches of ``step``, a running window
    serves each stretch, and what finds nothing in its own takes the first block of the next
    stretch that has one. A hot group is spread over its stretches. ``assets``: id, at; ``blocks``: id, at.
    """
    cut = F.floor(F.col("at") / step).alias("_s")
    none = F.lit(None).cast("bigint")
    u = assets.select(*by, "at", cut, F.lit(0).alias("_k"), F.col("id").alias("asset"), none.alias("block")).unionByName(blocks.select(*by, "at", cut, F.lit(1).alias("_k"), none.alias("asset"), F.col("id").alias("block")))
    w = Window.partitionBy(*by, "_s").orderBy(F.desc("at"), F.desc("_k"), F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    here = u.withColumn("_n", F.last(F.when(F.col("_k") == 1, F.struct("block", F.col("at").alias("b_at"))), ignorenulls=True).over(w)).where("_k = 0")
    heads = u.groupBy(*by, "_s").agg(F.min(F.when(F.col("_k") == 1, F.struct(F.col("at").alias("b_at"), "block"))).alias("_h"))
    later = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_h", F.last("_h", ignorenulls=True).over(later))
    both = here.join(heads, [*by, "_s"])
    return both.select(*by, "asset", F.coalesce("_n.block", "_h.block").alias("block"), (F.coalesce("_n.b_at", "_h.b_at") - F.col("at")).alias("gap"))
