"""Bounded training samples: drawn by hash of the row's id, stratum by stratum, equal texts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS = 12_000_000  # characters that one stratum's sample holds on average at most, whatever the rows' lengths


def drawn(df: DataFrame, id_col: str, text_cols: list[str], rows: int, stratum: Column | None = None, chars: int = CHARS) -> DataFrame:
    """About ``rows`` rows of each stratum, fewer where texts are so long that ``chars`` would be passed.

    The share comes from counts over all rows, so no limit cuts what was drawn. Rows are drawn by their id: a text that a
    third of all rows repeats takes a third of the draw and then counts once, and starves no other. Null ids are not drawn.
    """
    d = df.where(F.col(id_col).isNotNull()).withColumn("_s", F.coalesce(stratum.cast("string"), F.lit("")) if stratum is not None else F.lit(""))
    long = sum((F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in text_cols), F.lit(0).cast("bigint"))
    sizes = d.groupBy("_s").agg(F.count("*").alias("n"), F.sum(long).alias("c")).collect()  # a row for each stratum; callers have few
    share = F.lit(1.0)
    for r in sizes:
        share = F.when(F.col("_s") == r["_s"], F.lit(min(1.0, rows / max(1, r["n"]), chars / max(1, r["c"] or 1)))).otherwise(share)
    mark = F.pmod(F.xxhash64(F.col(id_col), F.lit(20)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return d.where(mark < share).drop("_s", id_col).dropDuplicates()
