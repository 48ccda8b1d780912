"""Placement of boxes: coordinates, columns, tolerances, validation rules and reports. Boxes are structs x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.operators.layout import area, box, nearest_below


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def flipped(b: Column, page_height: float) -> Column:
    """Bounds [top, left, bottom, right] of a page whose y axis points down."""
    return F.array(F.lit(page_height) - b["y1"], b["x0"], F.lit(page_height) - b["y0"], b["x1"])


def unflipped(bounds: Column, page_height: float) -> Column:
    return box(bounds[1], F.lit(page_height) - bounds[2], bounds[3], F.lit(page_height) - bounds[0])


def normalized(b: Column, column: Column, slack: float = 0.01) -> Column:
    """x, y, w, h relative to a column's box, clamped to 0..1; null where the corner lies outside by more than ``slack`` or the column is empty."""
    x, y = (b["x0"] - column["x0"]) / width(column), (b["y0"] - column["y0"]) / height(column)
    one = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    ok = (width(column) > 0) & (height(column) > 0) & x.between(-slack, 1 + slack) & y.between(-slack, 1 + slack)
    return F.when(ok, F.struct(one(x).alias("x"), one(y).alias("y"), one(width(b) / width(column)).alias("w"), one(height(b) / height(column)).alias("h")))


def denormalized(n: Column, column: Column) -> Column:
    x0, y0 = column["x0"] + n["x"] * width(column), column["y0"] + n["y"] * height(column)
    return box(x0, y0, x0 + n["w"] * width(column), y0 + n["h"] * height(column))


def column_overlap(b: Column, column: Column) -> Column:
    """Share of the box's width inside the column; null for a box without width."""
    inside = F.greatest(F.lit(0.0), F.least(b["x1"], column["x1"]) - F.greatest(b["x0"], column["x0"]))
    return F.when(width(b) > 0, inside / width(b))


def columns_of(boxes: DataFrame, columns: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, column_id, share): the column with the largest overlap of a box, the first of equals, if that is at least ``least``.

    ``boxes``: id, page, b; ``columns``: page, column_id, b. A page has a handful of columns: one row of its array joins its boxes.
    """
    per = columns.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("column_id", F.col("b").alias("c")))).alias("cols"))
    each = F.transform("cols", lambda x: F.struct(column_overlap(F.col("b"), x["c"]).alias("share"), (-x["column_id"]).alias("first"), x["column_id"].alias("column_id")))
    best = boxes.join(per, "page").select("id", F.array_max(each).alias("m"))
    return best.where(F.col("m.share") >= least).select("id", "m.column_id", F.col("m.share").alias("share"))


def column_runs(boxes: DataFrame, eps: float, least: int) -> DataFrame:
    """(page, column_id, x_min, x_max, blocks): columns as density clusters of the boxes' centres on the x axis.

    In one dimension the clusters are the runs of centres no more than ``eps`` apart that hold ``least`` boxes or more; they are numbered from
    the left. Equal centres are counted first, so that a window orders a page's distinct places only. ``boxes``: page, b.
    """
    c = boxes.select("page", ((F.col("b.x0") + F.col("b.x1")) / 2).alias("at"), "b").groupBy("page", "at").agg(F.count("*").alias("n"), F.min("b.x0").alias("lo"), F.max("b.x1").alias("hi"))
    w = Window.partitionBy("page").orderBy("at")
    c = c.withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(eps + 1)) > eps).cast("int"))
    runs = c.withColumn("run", F.sum("new").over(w)).groupBy("page", "run").agg(F.sum("n").alias("blocks"), F.min("lo").alias("x_min"), F.max("hi").alias("x_max")).where(F.col("blocks") >= least)
    return runs.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("run")) - 1).alias("column_id"), "x_min", "x_max", "blocks")


def nearest_block(assets: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(asset, gap, side): the gap to the block that begins soonest below an asset, else to the one that ends last above it.

    ``assets``: id, top, bottom; ``blocks``: id, top, bottom; smaller is higher.
    """
    own = assets.select(*by, "id", "top", "bottom").distinct().withColumn("key", F.xxhash64("id", "top", "bottom"))  # an id may have several boxes
    below = nearest_below(own.select(*by, F.col("key").alias("id"), F.col("bottom").alias("at")), blocks.select(*by, "id", F.col("top").alias("at")), by).select(*by, F.col("asset").alias("key"), F.col("gap").alias("below"))
    above = nearest_below(own.select(*by, F.col("key").alias("id"), (-F.col("top")).alias("at")), blocks.select(*by, "id", (-F.col("bottom")).alias("at")), by).select(*by, F.col("asset").alias("key"), F.col("gap").alias("above"))
    d = own.join(below.distinct(), [*by, "key"]).join(above.distinct(), [*by, "key"])
    return d.select(*by, F.col("id").alias("asset"), F.coalesce("below", "above").alias("gap"), F.when(F.col("below").isNotNull(), "below").when(F.col("above").isNotNull(), "above").otherwise("none").alias("side"))


def tolerance(b: Column, points: float = 2.0, share: float = 0.01, strict: bool = True, size: str = "both") -> Column:
    """Points allowed: the stricter (else the looser) of a fixed number and a share of the box's size."""
    side = {"width": width(b), "height": height(b), "both": F.greatest(width(b), height(b))}[size]
    return (F.least if strict else F.greatest)(F.lit(points), side * share)


def centre_error(expected: Column, actual: Column, strict: bool = True) -> Column:
    """struct(dx, dy, error, relative, width_ratio, height_ratio, passed) of the centres and sizes."""
    dx, dy = (actual["x0"] + actual["x1"] - expected["x0"] - expected["x1"]) / 2, (actual["y0"] + actual["y1"] - expected["y0"] - expected["y1"]) / 2
    error, size = F.greatest(F.abs(dx), F.abs(dy)), F.greatest(width(expected), height(expected))
    return F.struct(dx.alias("dx"), dy.alias("dy"), error.alias("error"), ratio(error, size).alias("relative"), ratio(width(actual), width(expected), 1.0).alias("width_ratio"), ratio(height(actual), height(expected), 1.0).alias("height_ratio"), (error <= tolerance(expected, strict=strict)).alias("passed"))


def same_aspect(a: Column, b: Column, most: float) -> Column:
    """Relative change of the aspect ratio is at most ``most``; null where a side is 0."""
    one, two = width(a) / height(a), width(b) / height(b)
    return F.when((height(a) > 0) & (height(b) > 0) & (one > 0), F.abs(two - one) / one <= most)


def dpi(pixels: Column, points: Column) -> Column:
    return F.when(points > 0, pixels / (points / 72.0)).otherwise(0.0)


def matrix_faults(m: Column, largest: float = 100.0, smallest: float = 0.01, far: float = 10_000.0) -> Column:
    """Faults of a transformation [a, b, c, d, e, f]: length, not finite, singular, scale, translation; an empty array if there is none."""
    if_ = lambda ok, name: F.when(ok, F.lit(name))
    x, y = F.sqrt(m[0] * m[0] + m[1] * m[1]), F.sqrt(m[2] * m[2] + m[3] * m[3])
    found = F.array(
        if_(F.abs(m[0] * m[3] - m[1] * m[2]) < 1e-6, "singular"), if_(x > largest, "x scale too large"), if_(x < smallest, "x scale too small"),
        if_(y > largest, "y scale too large"), if_(y < smallest, "y scale too small"), if_(F.abs(m[4]) > far, "x translation"), if_(F.abs(m[5]) > far, "y translation"),
    )
    odd = F.exists(m, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.size(m) != 6, F.array(F.lit("length"))).when(odd, F.array(F.lit("not finite"))).otherwise(F.array_compact(found))


def bounds_fault(bounds: Column, page_width: float, page_height: float, slack: float = 2.0) -> Column:
    """The first rule that bounds [top, left, bottom, right] break, or null."""
    top, left, bottom, right = (bounds[i] for i in range(4))
    return (
        F.when((left < -slack) | (right > page_width + slack), "horizontal range").when((top < -slack) | (bottom > page_height + slack), "vertical range")
        .when(left >= right, "horizontal order").when(top >= bottom, "vertical order")
    )


def anchor_settings(b: Column, column: Column) -> Column:
    """struct(align, x_offset, y_offset): aligned to the column's left, centre or right by where the box's centre lies in it."""
    centre = (b["x0"] + b["x1"]) / 2
    at = F.when(width(column) > 0, (centre - column["x0"]) / width(column)).otherwise(0.5)
    align = F.when(at < 0.33, "left").when(at > 0.67, "right").otherwise("center")
    off = F.when(at < 0.33, b["x0"] - column["x0"]).when(at > 0.67, b["x1"] - column["x1"]).otherwise(centre - (column["x0"] + column["x1"]) / 2)
    return F.struct(align.alias("align"), off.alias("x_offset"), (-(b["y1"] - column["y0"])).alias("y_offset"))


def importance(b: Column, weights: Column, large: float, prominent: float) -> Column:
    """Weight by kind, half again for a large side, twice for a prominent area."""
    more = F.when(area(b) > prominent, 2.0).when(F.greatest(width(b), height(b)) > large, 1.5).otherwise(1.0)
    return weights * more


def masked_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """(page, cells): grid cells that a page's boxes touch, each counted once. ``boxes``: page, b."""
    at = lambda lo, hi: F.sequence(F.floor(lo / cell), F.ceil(hi / cell) - 1)
    x = boxes.select("page", "b", F.explode(at(F.col("b.x0"), F.col("b.x1"))).alias("i"))
    return x.select("page", "i", F.explode(at(F.col("b.y0"), F.col("b.y1"))).alias("j")).distinct().groupBy("page").agg(F.count("*").alias("cells"))


def last_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order, by a partial aggregate; null keys have none."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("x")).select("x.*")


def completeness(source: DataFrame, placed: DataFrame, least: float) -> DataFrame:
    """One row: total, matched, missing, extra, coverage (100 for an empty source), passed. ``source``, ``placed``: id."""
    s, p = source.select("id").distinct().withColumn("s", F.lit(1)), placed.select("id").distinct().withColumn("p", F.lit(1))
    g = s.join(p, "id", "full").agg(F.count("s").alias("total"), F.count_if(F.col("s").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))
    cover = F.when(F.col("total") == 0, 100.0).otherwise(F.round(F.col("matched") * 100.0 / F.col("total"), 4))
    return g.withColumn("coverage", cover).withColumn("passed", (F.col("coverage") >= 100) | (F.col("coverage") >= least))
