"""Texts packed into chunks: by meaning, by sentences, fixed with overlap, by a sliding window, by levels; and the contexts around a chunk."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")
PARAGRAPH_END = re.compile(r"\n\s*\n")


def pack(parts: list[str], limit: int, glue: str) -> list[str]:
    """Consecutive parts joined while they fit; a part above the limit stands alone."""
    out: list[list[str]] = []
    size = 0
    for u in parts:
        if out and size + len(glue) + len(u) <= limit:
            out[-1].append(u)
            size += len(glue) + len(u)
        else:
            out.append([u])
            size = len(u)
    return [glue.join(x) for x in out]


def units(text: str) -> list[str]:
    """Sentences with the blanks that follow them: joined they are the text."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if a < b]


def chunk(text: str, limit: int) -> list[str]:
    """Paragraphs packed up to the limit; paragraphs above it by sentences, packed likewise."""
    out: list[str] = []
    held: list[str] = []
    for p in (x.strip() for x in PARAGRAPH_END.split(text)):
        if len(p) > limit:
            out += pack(held, limit, "\n\n") + pack([s for s in SENTENCE_END.split(p) if s], limit, " ")
            held = []
        elif p:
            held.append(p)
    return out + pack(held, limit, "\n\n")


def by_sentences(text: str, limit: int) -> list[str]:
    return [x.strip() for x in pack(units(text), limit, "") if x.strip()]


def with_overlap(text: str, limit: int, overlap: int) -> list[str]:
    """Whole sentences up to the limit; each chunk begins with the last sentences of the one before that fit into ``overlap``. Every chunk brings a new sentence, so it ends."""
    parts, out, at = units(text), [], 0
    while at < len(parts):
        begin, size = at, 0
        while begin > 0 and out and size + len(parts[begin - 1]) <= overlap:
            begin -= 1
            size += len(parts[begin])
        end = at
        while end < len(parts) and (end == at or size + len(parts[end]) <= limit):
            size += len(parts[end])
            end += 1
        out.append("".join(parts[begin:end]).strip())
        at = end
    return [x for x in out if x]


def by_levels(text: str, limit: int, least: int) -> list[tuple[int, str]]:
    """(level, text): the whole text at level 0 if it fits, else its paragraphs at level 1, and sentences of longer ones at level 2."""
    if len(text) <= limit:
        return [(0, text.strip())] if text.strip() else []
    out: list[tuple[int, str]] = []
    for p in (x.strip() for x in PARAGRAPH_END.split(text)):
        if len(p) >= least:
            out += [(1, p)] if len(p) <= limit else [(2, s) for s in by_sentences(p, limit)]
    return out


STRATEGIES: dict[str, Callable[[str, int, int, int], list[tuple[int, str]]]] = {
    "semantic": lambda t, limit, overlap, least: [(0, x) for x in chunk(t, limit)],
    "sentences": lambda t, limit, overlap, least: [(0, x) for x in by_sentences(t, limit)],
    "fixed": lambda t, limit, overlap, least: [(0, x) for x in with_overlap(t, limit, overlap)],
    "sliding": lambda t, limit, overlap, least: [(0, x) for a in range(0, len(t), limit - overlap) if len((x := t[a : a + limit]).strip()) >= least],
    "levels": lambda t, limit, overlap, least: by_levels(t, limit, least),
}


def chunks(df: DataFrame, id_col: str, text_col: str, how: str, limit: int, overlap: int = 0, least: int = 1) -> DataFrame:
    """(id, chunk_no, level, text) by one of STRATEGIES. Texts of fewer than ``least`` characters, and null ids or texts, give nothing.

    Raises for a limit below 1 or an overlap that isn't smaller.
    """
    if limit < 1 or overlap >= limit:
        raise ValueError("limit below 1, or overlap not below it")
    cut = STRATEGIES[how]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, level, x) for i, t in zip(pdf["id"], pdf["text"]) if len(t.strip()) >= least for n, (level, x) in enumerate(cut(t, limit, overlap, least))]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "level", "text"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return d.mapInPandas(run, f"id {d.schema['id'].dataType.simpleString()}, chunk_no int, level int, text string")


def greedy_chunks(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, chunk_no, text): paragraphs packed up to the limit."""
    return chunks(df, id_col, text_col, "semantic", limit).select("id", "chunk_no", "text")


def with_contexts(pieces: DataFrame, overlap: int, by: str = "id", order: str = "chunk_no", text: str = "text") -> DataFrame:
    """With prefix_context and suffix_context: the end of the piece before, from a sentence's beginning if one falls into it, and the beginning of the piece after, to a sentence's end."""
    w = Window.partitionBy(by).orderBy(order)  # one text's pieces
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    tail: Column = F.when(F.length(before) > overlap, F.substring(before, F.length(before) - overlap + 1, F.lit(overlap))).otherwise(before)
    head: Column = F.substring(after, F.lit(1), F.lit(overlap))
    d = pieces.withColumn("_t", tail).withColumn("_h", head)
    prefix = F.when(F.col("_t").rlike(r"[.!?]\s+\S"), F.regexp_replace("_t", r"(?s)^.*?[.!?]\s+", "")).otherwise(F.col("_t"))
    suffix = F.when(F.col("_h").rlike(r"[.!?]\s"), F.regexp_extract("_h", r"(?s)^(.*?[.!?])\s", 1)).otherwise(F.col("_h"))
    return d.withColumn("prefix_context", F.coalesce(prefix, F.lit(""))).withColumn("suffix_context", F.coalesce(suffix, F.lit(""))).drop("_t", "_h")
