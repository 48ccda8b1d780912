"""Segments of documents: canonical forms, placeholders for fragile tokens, and their way back."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The tokens that translation must not touch, in one expression so that none is looked at twice, and a placeholder's form.
FRAGILE = r"\[\[[a-z0-9_-]+\]\]|https?://[^\s<>\"]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}|[0-9][0-9,.]*"
PLACEHOLDER = r'<ph\s+id="(PH\d{3,}|ASSET_[A-Z0-9_-]+)"\s*/>'


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def canonical(x: Column | str) -> Column:
    """Compatibility form, straight quotes, single blanks, none at the ends; null gives null."""
    x = F.translate(_nfkc(x), "‘’ʼ´“”", "''''\"\"")
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ +| +$", "")


def encoded(df: DataFrame, text: str, start: int = 1) -> DataFrame:
    """``df`` with ``encoded`` and ``mapping`` (id -> token): each fragile token as <ph id="..." />.

    Markers [[x]] are named ASSET_X, all others PH and their number in the text, from ``start``, markers counted too. A fold over
    the text's tokens in the JVM: it cuts the text between them once. Null texts stay null.
    """
    none = F.array().cast("array<string>")
    tokens = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(FRAGILE), F.lit(0)), none)
    names = F.transform("_tokens", lambda t, i: F.when(F.startswith(t, F.lit("[[")), F.concat(F.lit("ASSET_"), F.upper(F.substring(t, F.lit(3), F.length(t) - 4)))).otherwise(F.concat(F.lit("PH"), F.lpad((i + start).cast("string"), F.greatest(F.lit(3), F.length((i + start).cast("string"))), F.lit("0")))))
    gaps = F.split(F.col(text), FRAGILE, -1)
    d = df.withColumn("_tokens", tokens).withColumn("_names", names).withColumn("_gaps", gaps)
    body = F.array_join(F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.concat(F.lit('<ph id="'), F.get(F.col("_names"), i), F.lit('" />')), F.lit("")))), "")
    pairs = F.array_distinct(F.arrays_zip(F.col("_names").alias("k"), F.col("_tokens").alias("v")))
    return d.withColumn("encoded", F.when(F.col(text).isNull(), None).otherwise(body)).withColumn("mapping", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))).drop("_tokens", "_names", "_gaps")


def decoded(text: Column, mapping: Column) -> Column:
    """The tokens back in their places; placeholders that the mapping doesn't know stay."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(text, PLACEHOLDER, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.element_at(mapping, F.regexp_extract(F.get(found, i), PLACEHOLDER, 1)), F.get(found, i), F.lit("")))), "")


def merged(a: Column, b: Column) -> Column:
    """Union of two mappings; raises where they differ on an id."""
    clash = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & (F.element_at(a, k) != F.element_at(b, k)))
    return F.when(clash, F.raise_error(F.lit("placeholder id collision"))).otherwise(F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))))
