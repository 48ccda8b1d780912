"""Verification of translated segments: the gate's figures, issues, protected tokens and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.functions.text import strip

NUMBER = r"\d+"


def gate_figures(segments: DataFrame, least: float, most: float, longest: int) -> DataFrame:
    """(id, ratio, longest, findings): length ratio (null unless both texts have more than 15 characters) and the longest token; a null text counts as empty."""
    s, t = strip(F.coalesce("source", F.lit(""))), strip(F.coalesce("target", F.lit("")))
    d = segments.select("id", s.alias("s"), t.alias("t"))
    ratio = F.when(F.least(F.length("s"), F.length("t")) > 15, (F.length("t") + 1) / (F.length("s") + 1))
    size = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("t", F.lit(r"[^\s]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    d = d.select("id", ratio.alias("ratio"), size.cast("bigint").alias("longest"))
    off = F.coalesce((F.round("ratio", 6) < least) | (F.round("ratio", 6) > most), F.lit(False))
    return d.withColumn("findings", off.cast("int") + (F.col("longest") > longest).cast("int"))


def missing_tokens(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, token): protected tokens in the source that the target lacks, anywhere in the text, case kept.

    Tokens are met by their first three characters: each place of a text asks only the tokens that begin as it does, so no text is held
    against the whole list, however long that is. Shorter tokens are met by their first character. Null or empty tokens give nothing.
    """
    t = tokens.select("token").where("length(token) > 0").distinct().withColumn("key", F.when(F.length("token") >= 3, F.substring("token", 1, 3)).otherwise(F.substring("token", 1, 1)))
    s = segments.where("source IS NOT NULL").select("id", "source", F.coalesce("target", F.lit("")).alias("target"))
    keys = F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.struct(F.substring(F.col("source"), i, F.lit(3)).alias("a"), F.substring(F.col("source"), i, F.lit(1)).alias("b")))
    each = s.where(F.length("source") > 0).select("id", "source", "target", F.explode(F.array_distinct(F.flatten(F.transform(keys, lambda x: F.array(x["a"], x["b"]))))).alias("key"))
    return each.join(t, "key").where(F.contains("source", F.col("token")) & ~F.contains("target", F.col("token"))).select("id", "token").distinct()


def issues(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, issue, severity) of emptiness, line breaks, lost or added numbers and lost protected tokens; null texts count as empty."""
    s = segments.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"))
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(NUMBER), F.lit(0))
    found = F.array(
        F.when(F.regexp_replace("target", r"\s+", "") == "", F.struct(F.lit("empty_translation").alias("issue"), F.lit("critical").alias("severity"))),
        F.when(lines("source") != lines("target"), F.struct(F.lit("format_mismatch").alias("issue"), F.lit("warning").alias("severity"))),
        F.when(F.size(F.array_except(numbers("source"), numbers("target"))) > 0, F.struct(F.lit("missing_placeholder").alias("issue"), F.lit("critical").alias("severity"))),
        F.when(F.size(F.array_except(numbers("target"), numbers("source"))) > 0, F.struct(F.lit("extra_placeholder").alias("issue"), F.lit("critical").alias("severity"))),
    )
    own = s.select("id", F.explode(F.array_compact(found)).alias("x")).select("id", "x.issue", "x.severity")
    lost = missing_tokens(segments, glossary.select(F.explode("protected_tokens").alias("token")))
    return own.union(lost.select("id", F.concat(F.lit("missing_protected_token:"), "token"), F.lit("warning")))


def quality(segments: DataFrame, found: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(id, quality, issues, passed): 1 less 0.3 for each critical issue, 0.1 for a warning, 0.05 for others, at least 0.

    Passed: no critical issue (``strict``: no warning either) and a quality of at least ``least``.
    """
    cost = F.when(F.col("severity") == "critical", 0.3).when(F.col("severity") == "warning", 0.1).otherwise(0.05)
    g = found.groupBy("id").agg(F.sum(cost).alias("cost"), F.count("*").alias("issues"), F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"))
    d = segments.select("id").join(g, "id", "left").fillna(0, ["cost", "issues", "c", "w"]).withColumn("quality", F.round(F.greatest(F.lit(0.0), 1 - F.col("cost")), 6))
    return d.select("id", "quality", "issues", ((F.col("c") == 0) & (F.lit(not strict) | (F.col("w") == 0)) & (F.col("quality") >= least)).alias("passed"))
