"""Documents split into sections: by headings of several kinds, by paragraphs, by size. Splits by lines and paragraphs stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions.text import paragraphs, strip
from weftspark.operators.chunking import pack, units

# What a heading line looks like in each kind of document.
MARKDOWN = r"^(#{1,6})\s+(.+)$"
CHAPTER = r"(?i)^(?:глава|chapter|раздел|section)\s+\d+[:.]\s*.+$"
CHAPTER_BARE = r"(?im)^(?:глава|chapter|раздел|section)\s+\d+[:.]\s*.+$"
CAPITALS = r"^[А-ЯA-Z][А-ЯA-Z\s]{5,}$"
SHORT = 3_000  # characters below which a text without headings is split by paragraphs


def strategy(text: Column) -> Column:
    """markdown, chapters, headings, paragraphs or fixed: the first kind that the text shows. A chapter line without a title is none, as nothing would split at it."""
    many = lambda form: text.rlike("(?m)" + form)
    return F.when(many(MARKDOWN), "markdown").when(text.rlike(CHAPTER_BARE), "chapters").when(many(r"^[А-ЯA-Z][А-ЯA-Z ]{5,}$"), "headings").when(F.length(text) < SHORT, "paragraphs").otherwise("fixed")


def by_headings(df: DataFrame, id_col: str, text_col: str, form: str, level: Column | None = None, title: Column | None = None, least: int = 1) -> DataFrame:
    """(id, section, title, level, start, content): the lines from one heading to the next; lines before the first belong to none.

    A heading is a line that ``form`` matches; ``title`` and ``level`` are expressions of its column ``line``. ``start`` is the heading's offset
    in the text. Sections whose stripped content has fewer than ``least`` characters are left out. Null ids and texts give nothing.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where("id IS NOT NULL")
    w = Window.partitionBy("id").orderBy("at")  # one text's lines
    head = strip("line").rlike(form) if form == CAPITALS else F.col("line").rlike(form)
    lines = lines.withColumn("head", head.cast("int")).withColumn("section", F.sum("head").over(w)).withColumn("off", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.where("section > 0")
    name, lv = title if title is not None else strip("line"), level if level is not None else F.lit(1)
    g = lines.groupBy("id", "section").agg(
        F.max(F.when(F.col("head") == 1, name)).alias("title"), F.max(F.when(F.col("head") == 1, lv)).alias("level"), F.min("off").cast("bigint").alias("start"),
        F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("at", "line")))).alias("body"),
    )
    g = g.withColumn("content", strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n"))).where(F.length("content") >= least)
    return g.select("id", (F.col("section") - 1).cast("int").alias("section"), "title", F.col("level").cast("int").alias("level"), "start", "content")


def markdown(df: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    line = F.col("line")
    return by_headings(df, id_col, text_col, MARKDOWN, F.length(F.regexp_extract(line, MARKDOWN, 1)), strip(F.regexp_extract(line, MARKDOWN, 2)), least)


def chapters(df: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    return by_headings(df, id_col, text_col, CHAPTER, least=least)


def capitals(df: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    return by_headings(df, id_col, text_col, CAPITALS, least=least)


def by_paragraphs(df: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    d = df.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(text_col, least)).alias("section", "content")).where("id IS NOT NULL")
    first = F.split_part("content", F.lit("\n"), F.lit(1))
    return d.select("id", "section", F.concat(F.substring(first, 1, 50), F.when(F.length(first) > 50, "...").otherwise("")).alias("title"), F.lit(1).alias("level"), F.lit(None).cast("bigint").alias("start"), "content")


def fixed(df: DataFrame, id_col: str, text_col: str, size: int = 2_000, least: int = 1) -> DataFrame:
    """Whole sentences packed up to ``size`` characters; a longer sentence stands alone. ``start`` is exact, as nothing but blanks at the ends is lost."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["t"]):
                at, n = 0, 0
                for p in pack(units(t), size, ""):
                    body = p.strip()
                    if len(body) >= least:
                        out.append((i, n, f"Section {n + 1}", 1, at + len(p) - len(p.lstrip()), body))
                        n += 1
                    at += len(p)
            yield pd.DataFrame(out, columns=["id", "section", "title", "level", "start", "content"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return d.mapInPandas(run, f"id {kind}, section int, title string, level int, start bigint, content string")


def parents(sections: DataFrame) -> DataFrame:
    """With ``parent``: the title of the nearest section before it in its text with a smaller level; null where there is none.

    Each text's sections fold in the JVM over a stack of open ones, so levels of any number do.
    """
    rest = [c for c in sections.columns if c not in ("id", "section", "level", "title")]
    g = sections.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "level", "title", *rest))).alias("s"))
    empty = F.struct(F.slice(F.transform("s", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"))), 1, 0).alias("open"), F.slice(F.transform("s", lambda x: x["title"]), 1, 0).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        left = F.filter(acc["open"], lambda o: o["level"] < x["level"])
        above = F.get(F.slice(left, -1, 1), F.lit(0))["title"]
        return F.struct(F.concat(left, F.array(F.struct(x["level"].alias("level"), x["title"].alias("title")))).alias("open"), F.concat(acc["out"], F.array(above)).alias("out"))

    found = F.aggregate("s", empty, step, lambda acc: acc["out"])
    return g.select("id", F.explode(F.arrays_zip(F.col("s"), found.alias("parent"))).alias("z")).select("id", "z.s.*", F.col("z.parent").alias("parent"))


def split(df: DataFrame, id_col: str, text_col: str, least: int = 100, most: int = 10_000, size: int = 2_000) -> DataFrame:
    """(id, section, part, title, level, content): each text by the kind of sections it shows, short ones left out, long ones cut again by size.

    A text shorter than ``least`` is one section. A part of a long section is one level deeper and named after it. Null ids and texts give nothing.
    """
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t IS NOT NULL").withColumn("kind", F.when(F.length(strip("t")) < least, "whole").otherwise(strategy(F.col("t"))))
    out = d.where("kind = 'whole'").select("id", F.lit(0).alias("section"), F.lit("Document").alias("title"), F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("start"), strip("t").alias("content"))
    for kind, way in (("markdown", markdown), ("chapters", chapters), ("headings", capitals), ("paragraphs", by_paragraphs)):
        out = out.union(way(d.where(F.col("kind") == kind), "id", "t", least=least))
    out = out.union(fixed(d.where("kind = 'fixed'"), "id", "t", size, least))
    out = out.select("id", "section", F.lit(0).alias("part"), "title", "level", "content")
    long_ = out.where(F.length("content") > most)
    again = fixed(long_.withColumn("k", F.struct("id", "section", "title", "level").cast(f"struct<id:{d.schema['id'].dataType.simpleString()},section:int,title:string,level:int>")).select(F.to_json("k").alias("k"), "content"), "k", "content", size)
    k = F.from_json("id", f"id {d.schema['id'].dataType.simpleString()}, section int, title string, level int")
    again = again.select(k.alias("k"), F.col("section").alias("part"), "content").select("k.id", "k.section", "part", F.concat("k.title", F.lit(" - Part "), (F.col("part") + 1).cast("string")).alias("title"), (F.col("k.level") + 1).alias("level"), "content")
    return out.where(F.length("content") <= most).union(again)
