"""Queries of term matching, chunking, exchange formats and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import chunking, terms
from weftspark.plans.registry import query
from weftspark.plans.tables import new_path, table
from weftspark.sources import interop
from weftspark.streaming import intake


@query("q_near_spellings", r"SELECT w.word, t.term FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[\p{L}]+')) AS word FROM documents) w, (SELECT DISTINCT unnest(regexp_extract_all(lower(en), '[\p{L}]+')) AS term FROM glossary) t WHERE length(word) >= 3 AND length(term) >= 3 AND abs(length(word) - length(term)) <= 1 AND (word = term OR list_has_any(list_append(list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:]), word), list_append(list_transform(range(1, length(term) + 1), lambda i: term[:i - 1] || term[i + 1:]), term)))")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    w = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+"), F.lit(0)))
    return terms.near_spellings(table(spark, sf, "documents").select(w("title").alias("word")), table(spark, sf, "glossary").select(w("en").alias("term")))


@query("q_greedy_chunks")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.greedy_chunks(table(spark, sf, "raw_sections"), "section_id", "content", 800)


@query("q_unit_round_trip", r"SELECT DISTINCT regexp_replace(source_text, '^\s+|\s+$', '', 'g') AS source_text FROM translations WHERE source_lang = 'en' AND target_lang = 'fr' AND translated_text IS NOT NULL")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").where("source_lang = 'en' AND target_lang = 'fr'")
    path = new_path(spark, "units")
    interop.write_units(t, path)
    return interop.read_units(spark, path, "en", "fr").select("source_text").distinct()


@query("q_term_export", "SELECT en AS source_term, fr AS target_term FROM glossary WHERE en IS NOT NULL AND fr IS NOT NULL GROUP BY en, fr")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    g, path = table(spark, sf, "glossary"), new_path(spark, "terms")
    # XML text loses nothing here but blanks at the ends, which the reader is told to keep.
    interop.write_terms(g, path, "en", "fr")
    return spark.read.schema(interop.TERM).format("xml").option("rowTag", "termEntry").option("ignoreSurroundingSpaces", "false").load(path).select(F.col("langSet")[0]["tig"][0]["term"].alias("source_term"), F.col("langSet")[1]["tig"][0]["term"].alias("target_term")).distinct()


@query("q_metrics_text", """SELECT 'documents_total{lang="' || coalesce(lang, '') || '"} ' || count(*) AS line FROM documents GROUP BY lang""")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    return interop.metrics_text(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), "documents_total", ["lang"], "n")


@query("q_stream_once", "SELECT count(DISTINCT sha256(text)) AS contents FROM documents")
def z03(spark: SparkSession, sf: str) -> DataFrame:
    return intake.run_available(intake.once(intake.source(spark, f"{sf}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "content_hash"), "once").agg(F.count("content_hash").alias("contents"))
