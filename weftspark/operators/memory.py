"""Segment memory: lookups, statistics, folds and upserts over a translations table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions.text import cosine

def memory_key(text: Column, source: Column, target: Column) -> Column:
    """Simple key: md5 of 'source:target:text'; a null part counts as empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat_ws(":", e(source), e(target), e(text)))


def stats(memory: DataFrame) -> DataFrame:
    """entries, usage, quality by language pair; nulls count 0 in usage and not at all in quality."""
    return memory.groupBy("source_lang", "target_lang").agg(F.count("*").alias("entries"), F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("total_usage"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))


def top_examples(memory: DataFrame, k: int, least_quality: float) -> DataFrame:
    """The k best entries of each language pair: quality, then usage, then recency, then id."""
    w = Window.partitionBy("source_lang", "target_lang").orderBy(F.desc("quality_score"), F.desc_nulls_last("usage_count"), F.desc_nulls_last("ts"), "id")
    return memory.where(F.col("quality_score") >= least_quality).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fold_quality(rows: DataFrame, key: list[str], order: list[str], quality: str, block: int = 10_000) -> DataFrame:
    """Running quality of each key: q1, then (q + next) / 2 in order; and the number of rows.

    A run of rows turns a quality q into a * q + b, so rows are cut into blocks of about ``block`` rows, each block is folded to its a and b by
    itself, and the few blocks of a key are then chained: no key, however hot, is ordered in one task. Blocks are ranges of
    the first order column, which must be a number. Null qualities are passed over.
    """
    r = rows.where(F.col(quality).isNotNull() & F.col(order[0]).isNotNull())
    size = r.agg(F.count("*").alias("n"), F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")).first()
    parts = max(1, (size["n"] or 0) // block)
    step = max(1e-9, ((size["hi"] or 0) - (size["lo"] or 0) + 1) / parts)
    r = r.withColumn("_b", F.floor((F.col(order[0]) - F.lit(size["lo"] or 0)) / F.lit(float(step))))
    w = Window.partitionBy(*key, "_b").orderBy(*[F.desc(c) for c in order])
    r = r.withColumn("_back", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*key, "_b")))
    # Within a block: a = 2^-n and b = sum of values times 2^-(places from the end + 1); the key's very first row counts twice.
    g = r.groupBy(*key, "_b").agg(F.count("*").alias("n"), F.sum(F.col(quality) * F.pow(F.lit(2.0), -F.col("_back") - 1)).alias("b"), F.max_by(quality, "_back").alias("first"))
    chain = g.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_b", "n", "b", "first"))).alias("c"))  # a row for each block
    start = F.get(F.col("c"), F.lit(0))["first"]
    value = F.aggregate("c", start, lambda q, x: q * F.pow(F.lit(2.0), -x["n"].cast("double")) + x["b"])
    return chain.select(*key, F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("usage"), value.alias("quality"))


def versioned_key(text: Column, source: Column, target: Column, glossary_version: int = 0, model: str = "unknown") -> Column:
    """sha256 of the compact JSON of glossary version, model, source language, lower-case stripped text and target language, keys in order; null parts are left empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    t = F.regexp_replace(F.lower(e(text)), r"(?U)^\s+|\s+$", "")
    return F.sha2(F.to_json(F.struct(F.lit(glossary_version).alias("g"), F.lit(model).alias("m"), e(source).alias("s"), t.alias("t"), e(target).alias("tgt"))), 256)


def lookup(queries: DataFrame, memory: DataFrame, versions: tuple[int, int] | None = None) -> DataFrame:
    """(id, state, match_id): 'hit' by key, 'miss' without one, 'stale' where the entry's version is too old. ``queries``: id, key; ``memory``: key, match_id, version."""
    m = memory.groupBy("key").agg(F.min_by(F.struct("match_id", "version"), "match_id").alias("m"))
    d = queries.join(m, "key", "left")
    old = F.col("m.version") < (versions[0] if versions else 0)
    return d.select("id", F.when(F.col("m").isNull(), "miss").when(old, "stale").otherwise("hit").alias("state"), F.when(F.col("m").isNotNull() & ~old, F.col("m.match_id")).alias("match_id"))


def similar_entries(queries: DataFrame, memory: DataFrame, least: float, k: int, pool: int = 1000) -> DataFrame:
    """(id, match_id, similarity): an entry with the same text and pair alone, at 1; else the k most similar of the pair's ``pool`` most used.

    Similarity is the cosine rescaled to 0..1, at least ``least``. Both: id, source_text, source_lang, target_lang, vector; memory also
    usage_count, quality_score. An entry never matches itself. The pool is cut before similarities are formed.
    """
    pair = ["source_lang", "target_lang"]
    same = memory.groupBy(*pair, "source_text").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    q = queries.join(same, [*pair, "source_text"], "left").withColumn("exact", F.when(F.col("a") != F.col("id"), F.col("a")).when(F.col("z") != F.col("id"), F.col("z")))
    exact = q.where("exact IS NOT NULL").select("id", F.col("exact").alias("match_id"), F.lit(1.0).alias("similarity"))
    w = Window.partitionBy(*pair).orderBy(F.desc_nulls_last("usage_count"), F.desc_nulls_last("quality_score"), "id")
    few = memory.where("vector IS NOT NULL").withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool).select(*pair, F.col("id").alias("match_id"), F.col("vector").alias("v"))
    near = q.where("exact IS NULL AND vector IS NOT NULL").select("id", *pair, "vector").join(few, pair).where("id <> match_id")
    near = near.select("id", "match_id", F.round((cosine("vector", "v") + 1) / 2, 9).alias("similarity")).where(F.col("similarity") >= least)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "match_id"))).where(F.col("r") <= k)
    return exact.union(best.select("id", "match_id", "similarity"))


def suggestions(rows: DataFrame, key: list[str], order: str, last: int = 5) -> DataFrame:
    """Per key: frequency, the last translation, and the last ``last`` contexts in order. ``rows``: key columns, translation, context, order column."""
    g = rows.groupBy(*key).agg(F.count("*").alias("frequency"), F.max_by("translation", order).alias("translation"))
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    c = rows.where("context IS NOT NULL").select(*key, order, "context").withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    c = c.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "context"))), lambda x: x["context"]).alias("contexts"))
    return g.join(c, key, "left").select(*key, "frequency", "translation", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Insert-ignore: the first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Old and new rows by key; on conflict the old texts stay, usage grows by the number of new rows.

    ``usage_count`` of a key absent from ``old`` starts at the number of its new rows.
    """
    n = new.groupBy(*key).agg(F.count("*").alias("_more"))
    first = keep_first(new, key, order).drop("usage_count")
    kept = old.join(n, key, "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_more")
    added = first.join(old.select(*key), key, "left_anti").join(n, key).withColumnRenamed("_more", "usage_count")
    return kept.unionByName(added.select(*kept.columns))


def term_signature(memory: DataFrame, terms: str = "glossary_terms") -> DataFrame:
    """With ``signature``: the sorted distinct terms of a segment, or __no_terms__."""
    t = F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(terms), F.array().cast("array<string>")))), "|")
    return memory.withColumn("signature", F.when(t == "", "__no_terms__").otherwise(t))


def term_suggestions(memory: DataFrame, least: int) -> DataFrame:
    """Source texts of at most five words that recur with one translation: frequency and distinct contexts."""
    short = memory.where(F.size(F.split(F.trim("source_text"), r"\s+")) <= 5)
    g = short.groupBy("source_text", "translated_text", "target_lang").agg(F.count("*").alias("frequency"), F.count_distinct("context").alias("contexts"))
    return g.where(F.col("frequency") >= least)
