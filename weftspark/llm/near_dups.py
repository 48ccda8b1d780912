"""Groups of records whose texts are nearly the same (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.bags import bag_rows, near_pairs, star_links
from weftspark.operators.components import connected_components
from weftspark.plans.tables import stored, table


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 12) -> DataFrame:
    """(group_id, id) of every record in a group of two or more; group_id is the smallest id.

    Records with equal word bags form one class before anything is compared, so a group of
    copies costs one row of a partial aggregate however large it is. Null ids, null texts and
    texts under ``min_words`` words belong to no group; repeated ids count once.
    """
    rows = stored(bag_rows(df, id_col, text_col, min_words=min_words), "bags")
    classes = stored(
        rows.groupBy("bag").agg(F.min("id").alias("cls"), F.max("id").alias("last"), F.any_value("n").alias("n"), F.any_value("toks").alias("toks"))
        .select("cls", "last", "bag", "n", "toks", F.lit(0).alias("route"), F.lit(0).alias("lo"), F.lit(1).alias("hi")),
        "classes",
    )
    # Near copies are tied in stars first; the trees then skip pairs within a component, so that
    # a mass of near copies never becomes all its pairs.
    stars = stored(star_links(classes, threshold).select("a", "b"), "star_links")
    first = connected_components(stars)
    known = stored(classes.join(first.select(F.col("node").alias("cls"), F.col("root").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "components")
    links = near_pairs(known, threshold).select("a", "b").union(stars)
    roots = connected_components(links).select(F.col("node").alias("cls"), "root")
    grouped = classes.select("cls", "last", "bag").join(roots, "cls", "left").where("root IS NOT NULL OR last <> cls").select("bag", F.coalesce("root", "cls").alias("group_id"))
    return rows.select("bag", "id").join(grouped, "bag").select("group_id", "id").distinct()


SOURCES = {"translations": "source_text", "knowledge": "content"}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for tbl, text in SOURCES.items():
        g = near_duplicate_groups(table(spark, sf_dir, tbl), "id", text).where("id <> group_id").select(F.lit(tbl).alias("tbl"), F.col("group_id").alias("id_a"), F.col("id").alias("id_b"))
        out = g if out is None else out.union(g)
    return out
