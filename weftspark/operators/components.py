"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.plans.tables import stored


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find inside each Arrow batch: a batch's links become stars around the smallest id."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while (up := parent.get(x, x)) != root:
                parent[x] = root
                x = up
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(find(x), x) for x in list(parent)]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"]).astype("int64")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that occurs in ``links``; root is the smallest id of its component.

    Large-star and small-star rounds alternate, every round on a written table, so the graph
    is never gathered in one task or on the driver. Null ends and loops are ignored; an
    empty link table gives an empty result. Raises if ``max_rounds`` rounds don't settle.
    """
    e = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = stored(e.mapInPandas(_contract, "a bigint, b bigint").distinct(), "links")
    for _ in range(max_rounds):
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v")).union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        small = big.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        new = big.withColumnRenamed("b", "u").join(small, "u")
        new = new.select(F.col("m").alias("a"), F.col("a").alias("b")).union(new.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        new = stored(new, "links")
        # A star forest is reached once no id is both a centre and a leaf and no leaf has two centres.
        loose = new.agg(F.count("*").alias("n"), F.count_distinct("b").alias("d")).first()
        e = new
        if loose["n"] == loose["d"] and not e.select(F.col("a").alias("b")).join(e, "b", "left_semi").head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
