"""A bit filter: which rows may have a partner, told before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 64-bit words: at most so many rows of 16 bytes are broadcast, whatever the input


def may_match(df: DataFrame, column: str, values: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` may occur in the first column of ``values``; none that does is lost.

    Both are bigint. The filter has about 16 bits for each of ``rows`` values (counted where not given), at most
    ``64 * WORDS``, is gathered by partial aggregates and broadcast. A fuller filter passes more, so it only ever saves work.
    """
    v = values.columns[0]
    rows = values.count() if rows is None else rows
    size = min(WORDS, max(1 << 10, 1 << (rows // 4).bit_length()))
    at = lambda c: F.xxhash64(c)
    bits = values.select(at(F.col(v)).alias("_h")).select(F.pmod(F.shiftright("_h", 6), F.lit(size)).alias("_w"), F.expr("shiftleft(1L, cast(_h & 63 AS int))").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    hashed = df.withColumn("_h", at(F.col(column))).withColumn("_w", F.pmod(F.shiftright("_h", 6), F.lit(size)))
    return hashed.join(F.broadcast(bits), "_w").where(F.expr("(shiftrightunsigned(_bits, cast(_h & 63 AS int)) & 1L) = 1L")).drop("_h", "_w", "_bits")
