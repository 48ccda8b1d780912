"""Queries that write files and read them again, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import layout as L
from weftspark.plans.registry import query
from weftspark.plans.tables import new_path, table
from weftspark.queries_layout import ASSETS, assets
from weftspark.sources import files as S
from weftspark.sources import interop
from weftspark.streaming import intake


@query("q_ledger_round_trip", f"SELECT colorspace, count(*) AS assets, count(DISTINCT doc) AS documents, round(sum((x1 - x0) * (y1 - y0)), 2) AS area FROM (SELECT id // 10 AS doc, coalesce(CASE WHEN kind = 'A' THEN 'cmyk' WHEN kind = 'R' THEN 'gray' END, 'rgb') AS colorspace, x0, y0, x1, y1 FROM {ASSETS}) GROUP BY colorspace")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    """Assets to JSON ledgers and back."""
    a = assets(spark, sf).select(
        F.floor(F.col("id") / 10).cast("string").alias("source_pdf"), F.lit(10).alias("total_pages"), F.col("id").cast("string").alias("asset_id"), F.col("kind").alias("asset_type"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("page").cast("int").alias("page_number"),
        L.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.array(F.lit(1.0), F.lit(0.0)).alias("ctm"), F.lit(1).alias("occurrence"), F.lit(None).cast("string").alias("anchor_to"), F.when(F.col("kind") == "A", "cmyk").when(F.col("kind") == "R", "gray").alias("colorspace"),
        F.array().cast("array<struct<font_name:string,font_type:string,embedded:boolean,subset:boolean>>").alias("fonts"),
    )
    path = new_path(spark, "ledgers")
    S.write_ledgers(a, path)
    back = S.read_ledgers(spark, path)
    return back.groupBy("colorspace").agg(F.count("*").alias("assets"), F.count_distinct("source_pdf").alias("documents"), F.round(F.sum(L.area(F.col("bbox"))), 2).alias("area"))


@query("q_memory_round_trip", "SELECT source_lang, target_lang, count(*) AS entries, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT source_text, source_lang, target_lang, any_value(length(source_text)) AS n FROM translations GROUP BY ALL) GROUP BY ALL")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    """A memory to JSON and back, the last of repeated keys kept."""
    path = new_path(spark, "memory")
    S.write_memory(table(spark, sf, "translations"), path)
    return S.read_memory(spark, path).groupBy("source_lang", "target_lang").agg(F.count("*").alias("entries"), F.sum(F.length("source_text")).cast("bigint").alias("chars"))


@query("q_glossary_round_trip", "SELECT category, count(*) AS keys, count(fr) AS with_fr FROM (SELECT category, coalesce(term_key, ru, en) AS k, fr FROM glossary WHERE category IS NOT NULL AND coalesce(term_key, ru, en) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category, k ORDER BY entry_id DESC) = 1) GROUP BY category")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary as one tree by category and key, written and read."""
    path = new_path(spark, "glossary")
    S.glossary_tree(table(spark, sf, "glossary")).select(F.concat(F.lit("{"), F.to_json(F.array("category")).substr(F.lit(2), F.length(F.to_json(F.array("category"))) - 2), F.lit(":"), "json", F.lit("}")).alias("value")).write.mode("overwrite").text(path)
    return S.read_glossary(spark, path).groupBy("category").agg(F.count("*").alias("keys"), F.count("fr").alias("with_fr"))


@query("q_commented_json", "SELECT count(*) AS entries, CAST(sum(length(title)) AS BIGINT) AS chars FROM knowledge WHERE id IS NOT NULL")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files with comment lines (S06); each row is a file's text here."""
    path = new_path(spark, "commented")
    k = table(spark, sf, "knowledge").where("id IS NOT NULL").select(F.concat(F.lit("// note\n  // another\n"), F.to_json(F.struct("id", "title"))).alias("value"))
    k.repartition(4).write.mode("overwrite").option("lineSep", "\u0000").text(path)
    text = spark.read.option("lineSep", "\u0000").text(path).where("value <> ''")
    j = text.select(F.from_json(F.regexp_replace("value", r"(?m)^\s*//.*$", ""), "id bigint, title string").alias("j")).select("j.*")
    return j.agg(F.count("id").alias("entries"), F.sum(F.length("title")).cast("bigint").alias("chars"))


@query("q_text_folder", "SELECT preset, CAST(sum(length(content) + 1) AS BIGINT) AS chars FROM raw_sections WHERE content IS NOT NULL AND preset IS NOT NULL GROUP BY preset")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of a folder, one row each (S09, S10); the files are the sections of a preset, so their lengths add up."""
    path = new_path(spark, "texts")
    table(spark, sf, "raw_sections").where("content IS NOT NULL AND preset IS NOT NULL").select("preset", F.col("content").alias("value")).write.partitionBy("preset").text(path)
    d = S.read_texts(spark, path)
    return d.groupBy(F.regexp_extract("path", "preset=([^/]+)/", 1).alias("preset")).agg(F.sum(F.length("content")).cast("bigint").alias("chars"))


@query("q_term_import", "SELECT DISTINCT en AS source_term, fr AS target_term FROM glossary WHERE en IS NOT NULL AND fr IS NOT NULL AND regexp_full_match(en || fr, '[^\\s].*[^\\s]') AND NOT regexp_matches(en, '^\\s|\\s$') AND NOT regexp_matches(fr, '^\\s|\\s$')".replace("\\\\", "\\"))
def s08(spark: SparkSession, sf: str) -> DataFrame:
    """Terminology written and read again (S08, J13, V22), for terms whose ends are no blanks: XML readers strip those."""
    g, path = table(spark, sf, "glossary"), new_path(spark, "terms")
    edge = lambda c: F.col(c).rlike(r"^\s|\s$")
    interop.write_terms(g.where(F.col("en").isNotNull() & F.col("fr").isNotNull() & ~edge("en") & ~edge("fr")), path, "en", "fr")
    return interop.read_terms(spark, path, "en", "fr")


@query("q_new_contents", "SELECT count(*) AS contents FROM (SELECT DISTINCT content FROM raw_sections WHERE content IS NOT NULL AND preset <> (SELECT min(preset) FROM raw_sections) AND content NOT IN (SELECT content FROM raw_sections WHERE preset = (SELECT min(preset) FROM raw_sections) AND content IS NOT NULL))")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that a state table of hashes doesn't know."""
    s = table(spark, sf, "raw_sections").where("content IS NOT NULL").select("preset", F.sha2("content", 256).alias("sha256"), F.col("source_id").alias("path"))
    known = s.agg(F.min("preset").alias("known"))  # one preset counts as processed
    s = s.crossJoin(F.broadcast(known))
    return S.unseen(s.where("preset <> known"), s.where("preset = known")).agg(F.count("*").alias("contents"))


@query("q_batch_envelopes", "SELECT source_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY source_id")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    """Batches as versioned documents and back."""
    c = table(spark, sf, "chunks").select("source_id", F.col("source_id").alias("source"), "chunk_id", "text")
    back = S.open_envelopes(S.envelope(c, "1.0", "source_id", "chunk_id"), "1.0", "source:string,chunk_id:int,text:string")
    return back.groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("q_markup_pages", "SELECT source_id, md5(string_agg('<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>', chr(10) || chr(10) ORDER BY chunk_id, text)) AS h FROM (SELECT DISTINCT source_id, chunk_id, text, CASE WHEN chunk_id = 0 THEN 'h2' ELSE 'p' END AS tag FROM chunks) GROUP BY source_id")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks as markup, and ordered lines of a document."""
    c = table(spark, sf, "chunks").select("source_id", F.struct("chunk_id", "text").alias("o"), F.when(F.col("chunk_id") == 0, "heading").otherwise("text").alias("kind"), "text").distinct()
    return S.pages(c, "source_id", "o", S.markup(F.col("kind"), F.col("text"))).select("source_id", F.md5("text").alias("h"))


@query("q_audit_trail", f"SELECT kind, '{{\"source\":{{\"assets\":' || count(*) || '}},\"placement\":{{\"shifted\":' || count(*) FILTER (WHERE shift <> 0) || '}},\"passed\":' || CASE WHEN count(*) FILTER (WHERE abs(shift) > 3) = 0 THEN 'true' ELSE 'false' END || '}}' AS json FROM {ASSETS} GROUP BY kind")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and audit trail as nested JSON."""
    g = assets(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("shift") != 0).alias("s"), F.count_if(F.abs("shift") > 3).alias("bad"))
    return g.select("kind", F.to_json(F.struct(F.struct(F.col("n").alias("assets")).alias("source"), F.struct(F.col("s").alias("shifted")).alias("placement"), (F.col("bad") == 0).alias("passed"))).alias("json"))


@query("q_stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def z01(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has passed."""
    return intake.run_available(intake.windowed_counts(intake.source(spark, f"{sf}/events.parquet"), "ts", "event_type", "1 day", "1 hour"), "windows")


@query("q_dead_letters", "SELECT CASE WHEN TRY_CAST(regexp_extract(title, '([A-Z][a-z]+)$', 1) AS INT) IS NULL AND title IS NOT NULL THEN 'failed' ELSE 'done' END AS state, count(*) AS n FROM documents GROUP BY 1")
def z04(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a step can't process go to a table of their own with the reason."""
    return intake.with_dead_letters(intake.source(spark, f"{sf}/documents.parquet").select("doc_id", "title"), "title IS NULL OR try_cast(regexp_extract(title, '([A-Z][a-z]+)$', 1) AS INT) IS NOT NULL", "letters").groupBy("state").agg(F.count("*").alias("n"))
