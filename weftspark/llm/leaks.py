"""Passages of test items inside corpus documents (problem 8), by a positional inverted index.

Postings (term, document, position) are written once for those corpus words that some test
item uses. Of every ``run`` consecutive passage words the word that is rarest in the corpus is an
anchor; the postings of anchors alone, each offset by its place in the passage, give the
candidate alignments (document, item, offset). Only for these are the lists of the other
passage words intersected, and gaps-and-islands over the passage positions tells the longest run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.plans.tables import stored, table

SMALL = 200_000  # rows of a test vocabulary (16 bytes each) up to which it is broadcast


def plain_words(text: Column | str) -> Column:
    """Words as runs of letters and digits, lower case, invisible characters left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\p{Cf}+", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows are few, else left to the join strategy of the session."""
    return F.broadcast(df) if rows <= SMALL else df


def phrase_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = 12, slop: int = 0) -> DataFrame:
    """(doc_id, item_id, longest): documents with at least ``run`` consecutive words of an item's passage.

    ``slop`` > 0 asks for proximity instead: passage words may be up to ``slop`` positions
    away from the alignment of the candidate. Null ids, null texts and passages under ``run``
    words match nothing; repeated rows count once; other columns are ignored.
    """
    q = items.select(F.col(item_id).alias("item"), plain_words(passage).alias("w")).where(F.col("item").isNotNull() & (F.size("w") >= run)).distinct()
    q = stored(q.select("item", F.posexplode("w").alias("ipos", "w")).select("item", "ipos", F.xxhash64("w").alias("term")), "passages")
    vocab = stored(q.select("term").distinct(), "vocabulary")
    known = vocab.count()
    words = docs.select(F.col(doc_id).alias("doc"), plain_words(text).alias("w")).where("doc IS NOT NULL AND w IS NOT NULL")
    posts = words.select("doc", F.posexplode("w").alias("pos", "w")).select("doc", "pos", F.xxhash64("w").alias("term"))
    posts = stored(posts.join(_few(vocab, known), "term", "left_semi"), "postings")
    often = stored(posts.groupBy("term").count(), "frequencies")
    ranked = q.join(often, "term", "left").select("item", "ipos", "term", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "ipos").alias("key"))
    w = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, run - 1)
    seen = ranked.withColumn("least", F.min("key").over(w)).withColumn("size", F.count("*").over(w))
    anchors = stored(seen.where((F.col("size") == run) & (F.col("least.n") > 0)).select("item", F.col("least.ipos").alias("ipos"), F.col("least.term").alias("term")).distinct(), "anchors")
    cand = posts.join(_few(anchors, anchors.count()), "term").select("doc", "item", (F.col("pos") - F.col("ipos")).alias("off")).distinct()
    cand = stored(cand, "alignments")
    # Each alignment asks for the passage's words at their places, so that it meets these postings and no others of its document.
    asked = cand.join(q, "item").withColumn("at", F.col("off") + F.col("ipos"))
    if slop:
        asked = asked.withColumn("at", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)))
    asked = stored(asked.select("doc", "item", "off", "ipos", F.col("at").alias("pos"), "term"), "asked")
    hit = posts.join(_few(asked, asked.count()), ["doc", "pos", "term"]).select("doc", "item", "off", "ipos").distinct()
    isle = F.col("ipos") - F.row_number().over(Window.partitionBy("doc", "item", "off").orderBy("ipos"))
    runs = hit.withColumn("isle", isle).groupBy("doc", "item", "off", "isle").count().where(F.col("count") >= run)
    return runs.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("count").alias("longest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage").select("doc_id", "item_id")
