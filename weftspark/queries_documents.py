"""Queries over documents, knowledge entries, chunks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators.splitting import parents
from weftspark.plans.registry import query
from weftspark.plans.tables import table


@query("q_category_stats", "SELECT category, count(*) AS entries FROM knowledge GROUP BY category")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").groupBy("category").agg(F.count("*").alias("entries"))


@query("q_like_search", "SELECT id, title, CAST(floor(epoch(created_at)) AS BIGINT) AS created FROM knowledge WHERE content LIKE '%mohair%' ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").where(F.col("content").like("%mohair%")).orderBy(F.desc_nulls_last("created_at"), "id").limit(20).select("id", "title", F.unix_timestamp("created_at").alias("created"))


@query("q_dense_counts", "SELECT l.lang, s.section_type, count(d.doc_id) AS docs FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l CROSS JOIN (SELECT DISTINCT section_type FROM documents WHERE section_type IS NOT NULL) s LEFT JOIN documents d ON d.lang = l.lang AND d.section_type = s.section_type GROUP BY ALL")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by language and section type, combinations without rows included: totals by rollup of distinct values, no row pairs."""
    d = table(spark, sf, "documents")
    n = d.groupBy("lang", "section_type").agg(F.count("*").alias("docs"))
    langs, kinds = n.select("lang").where("lang IS NOT NULL").distinct(), n.where("section_type IS NOT NULL").agg(F.collect_set("section_type").alias("k"))
    spine = langs.join(F.broadcast(kinds)).select("lang", F.explode("k").alias("section_type"))  # one row of enum values
    return spine.join(n, ["lang", "section_type"], "left").select("lang", "section_type", F.coalesce("docs", F.lit(0)).alias("docs"))


@query("q_latest_version", "SELECT slug, doc_version, doc_id FROM documents WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY CAST(split_part(doc_version, '.', 1) AS INT) DESC NULLS LAST, CAST(split_part(doc_version, '.', 2) AS INT) DESC NULLS LAST, doc_id DESC) = 1")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    """Newest version of each slug, as a partial aggregate so that a hot slug isn't sorted in one task."""
    v = lambda i: F.split_part("doc_version", F.lit("."), F.lit(i)).cast("int")
    key = F.struct(F.coalesce(v(1), F.lit(-1)), F.coalesce(v(2), F.lit(-1)), "doc_id")
    return table(spark, sf, "documents").where("slug IS NOT NULL").groupBy("slug").agg(F.max_by(F.struct("doc_version", "doc_id"), key).alias("x")).select("slug", "x.*")


@query("q_occurrence_counter", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS occurrence FROM documents WHERE text IS NOT NULL")
def w01(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.row_number().over(w).cast("bigint").alias("occurrence"))


@query("q_content_copies", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("q_chunk_links", "SELECT source_id, chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY source_id) AS total FROM (SELECT DISTINCT source_id, CAST(chunk_id AS BIGINT) AS chunk_id FROM chunks) WINDOW w AS (PARTITION BY source_id ORDER BY chunk_id)")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("source_id", F.col("chunk_id").cast("bigint").alias("chunk_id")).distinct()
    w = Window.partitionBy("source_id").orderBy("chunk_id")
    return c.select("source_id", "chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), F.count("*").over(Window.partitionBy("source_id")).alias("total"))


@query("q_neighbour_frame", "SELECT source_id, chunk_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id) OVER (PARTITION BY source_id ORDER BY chunk_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS h FROM (SELECT DISTINCT source_id, CAST(chunk_id AS BIGINT) AS chunk_id, text FROM chunks)")
def w07(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("source_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text").distinct()
    w = Window.partitionBy("source_id").orderBy("chunk_id")
    return c.select("source_id", "chunk_id", F.md5(F.concat_ws("\n\n", F.lag("text").over(w), "text", F.lead("text").over(w))).alias("h"))


@query("q_budget_cut", "SELECT source_id, count(*) AS taken FROM (SELECT source_id, sum(length(text)) OVER (PARTITION BY source_id ORDER BY chunk_id) AS run FROM (SELECT DISTINCT source_id, chunk_id, text FROM chunks)) WHERE run <= 1500 GROUP BY source_id")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("source_id", "chunk_id", "text").distinct()
    run = F.sum(F.length("text")).over(Window.partitionBy("source_id").orderBy("chunk_id"))
    return c.select("source_id", run.alias("run")).where("run <= 1500").groupBy("source_id").agg(F.count("*").alias("taken"))


@query("q_sections_without_chunks", "SELECT source_id FROM raw_sections WHERE source_id NOT IN (SELECT source_id FROM chunks WHERE source_id IS NOT NULL)")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_sections").join(table(spark, sf, "chunks"), "source_id", "left_anti").select("source_id")


@query("q_sections_with_chunks", "SELECT source_id, section_id FROM raw_sections WHERE source_id IN (SELECT source_id FROM chunks)")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_sections").join(table(spark, sf, "chunks"), "source_id", "left_semi").select("source_id", "section_id")


@query("q_preset_join", "SELECT r.section_id, p.max_chars, length(r.content) > p.max_chars AS oversized FROM raw_sections r JOIN chunk_presets p USING (preset)")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_sections").join(table(spark, sf, "chunk_presets"), "preset").select("section_id", "max_chars", (F.length("content") > F.col("max_chars")).alias("oversized"))


@query("q_source_compare", "SELECT coalesce(d.s, m.source) AS source, coalesce(d.n, 0) AS docs, m.target_share FROM (SELECT lower(trim(source)) AS s, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) d FULL JOIN mix_targets m ON d.s = m.source")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("docs"))
    return d.join(table(spark, sf, "mix_targets"), "source", "full").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), "target_share")


@query("q_daily_events", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("q_top_users", "SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 10")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    return g.orderBy(F.desc("t"), "user_id").limit(10).select("user_id", F.round("t", 4).alias("total"), "n")


@query("q_cumulative_buckets", "SELECT CAST(b AS BIGINT) AS le, count(*) FILTER (WHERE n_chars <= b) AS n FROM documents, (SELECT unnest([100, 500, 1000, 2500, 5000]) AS b) GROUP BY b")
def a39(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative length buckets in one pass over the rows."""
    edges = (100, 500, 1000, 2500, 5000)
    one = table(spark, sf, "documents").agg(*[F.count_if(F.col("n_chars") <= e).alias(f"c{e}") for e in edges])
    return one.select(F.inline(F.array(*[F.struct(F.lit(e).cast("bigint").alias("le"), F.col(f"c{e}").alias("n")) for e in edges])))


@query("q_last_value", "SELECT user_id, max(ts) AS ts, arg_max(event_type, event_id) AS event_type FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def a40(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("q_batch_split", "SELECT target_lang, batch, count(*) AS n, min(id) AS first_id FROM (SELECT id, (row_number() OVER (PARTITION BY target_lang ORDER BY id) - 1) // 100 AS batch, target_lang FROM translations) GROUP BY target_lang, batch")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous batches by target: rows are numbered within ranges of ids, and the ranges' counts add the rest, so no target is ordered in one task."""
    t = table(spark, sf, "translations").select("id", "target_lang", F.floor(F.col("id") / 5_000).alias("part"))
    before = Window.partitionBy("target_lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("target_lang", "part").agg(F.count("*").alias("c")).withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = t.withColumn("r", F.row_number().over(Window.partitionBy("target_lang", "part").orderBy("id"))).withColumn("k", F.coalesce("target_lang", F.lit("")))
    d = own.join(parts.select(F.coalesce("target_lang", F.lit("")).alias("k"), "part", "off"), ["k", "part"]).withColumn("batch", F.floor((F.col("off") + F.col("r") - 1) / 100))
    return d.groupBy("target_lang", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("q_anchor_section", "SELECT coalesce(nullif(split_part(term_key, '.', 2), ''), 'unknown') AS part, count(*) AS n FROM glossary GROUP BY 1")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    part = F.coalesce(F.nullif(F.split_part("term_key", F.lit("."), F.lit(2)), F.lit("")), F.lit("unknown"))
    return table(spark, sf, "glossary").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("q_metadata_levels", "SELECT metadata['section_level'] AS level, count(*) AS n FROM knowledge GROUP BY 1")
def h15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").groupBy(F.col("metadata").getItem("section_level").alias("level")).agg(F.count("*").alias("n"))


@query("q_extraction_metrics", "SELECT section_type, count(*) AS docs, count(title) AS titled, count(*) - count(title) AS untitled, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY section_type")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("section_type").agg(F.count("*").alias("docs"), F.count("title").alias("titled"), (F.count("*") - F.count("title")).alias("untitled"), F.sum("n_chars").cast("bigint").alias("chars"))


@query("q_parent_links", "SELECT id, lv, (SELECT max(o.id) FROM k o WHERE o.source_file = k.source_file AND o.id < k.id AND o.lv < k.lv) AS parent FROM (SELECT id, source_file, CAST(metadata['section_level'] AS BIGINT) AS lv FROM knowledge WHERE source_file IS NOT NULL) k".replace("FROM k o", "FROM (SELECT id, source_file, CAST(metadata['section_level'] AS BIGINT) AS lv FROM knowledge WHERE source_file IS NOT NULL) o"))
def w06(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest earlier entry of the same file with a smaller level, by a fold over each file's entries, for levels of any number."""
    k = table(spark, sf, "knowledge").where("source_file IS NOT NULL").select(F.col("source_file").alias("id"), F.col("id").alias("section"), F.col("metadata").getItem("section_level").cast("bigint").alias("level"), F.col("id").alias("title"))
    return parents(k).select(F.col("section").alias("id"), F.col("level").alias("lv"), "parent")


@query("q_next_version", "SELECT slug, 'v' || printf('%03d', max(CAST(split_part(doc_version, '.', 1) AS INT)) + 1) AS next_version FROM documents WHERE slug IS NOT NULL GROUP BY slug")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("slug IS NOT NULL").groupBy("slug").agg(F.format_string("v%03d", F.max(F.split_part("doc_version", F.lit("."), F.lit(1)).cast("int")) + 1).alias("next_version"))


@query("q_manifest_by_hash", "SELECT sha256(text) AS hash, arg_max(doc_version, (CAST(split_part(doc_version, '.', 1) AS BIGINT) * 1000 + CAST(split_part(doc_version, '.', 2) AS BIGINT)) * 1000000000 + doc_id) AS doc_version, count(*) > 1 AS reused FROM documents WHERE text IS NOT NULL AND doc_version IS NOT NULL GROUP BY 1")
def p16b(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version with a content (P16), and whether its output may be used again."""
    v = lambda i: F.split_part("doc_version", F.lit("."), F.lit(i)).cast("int")
    d = table(spark, sf, "documents").where("text IS NOT NULL AND doc_version IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.max_by("doc_version", F.struct(v(1), v(2), "doc_id")).alias("doc_version"), (F.count("*") > 1).alias("reused"))


@query("q_latest_translation", "SELECT r.section_id, c.chunk_id, length(c.text) AS chars FROM raw_sections r LEFT JOIN (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY chunk_id DESC, text DESC) = 1) c ON c.source_id = r.source_id")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """A left join that keeps one row a section, the last chunk's where there are several."""
    c = table(spark, sf, "chunks").groupBy("source_id").agg(F.max_by(F.struct("chunk_id", "text"), F.struct("chunk_id", "text")).alias("c"))
    return table(spark, sf, "raw_sections").join(c, "source_id", "left").select("section_id", "c.chunk_id", F.length("c.text").alias("chars"))


@query("q_positional_zip", r"SELECT id, n - 1 AS n, length(s[n]) AS source_chars, length(t[n]) AS answer_chars FROM (SELECT id, s, t, unnest(generate_series(1, least(len(s), len(t)))) AS n FROM (SELECT id, string_split(source_text, '. ') AS s, string_split(translated_text, '. ') AS t FROM translations WHERE source_text IS NOT NULL AND translated_text IS NOT NULL))")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by position, as many as the shorter side has."""
    t = table(spark, sf, "translations").where("source_text IS NOT NULL AND translated_text IS NOT NULL").select("id", F.split("source_text", r"\. ").alias("s"), F.split("translated_text", r"\. ").alias("t"))
    n = F.least(F.size("s"), F.size("t"))
    return t.select("id", F.posexplode(F.arrays_zip(F.slice("s", F.lit(1), n).alias("s"), F.slice("t", F.lit(1), n).alias("t"))).alias("n", "z")).select("id", F.col("n").cast("bigint").alias("n"), F.length("z.s").alias("source_chars"), F.length("z.t").alias("answer_chars"))


@query("q_json_fields", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    """A pointer into JSON text (H14), read as a typed struct."""
    return table(spark, sf, "events").groupBy("event_type", (F.from_json("props", "k bigint")["k"] % 10).alias("k")).agg(F.count("*").alias("n"))


@query("q_slim_metadata", "SELECT id, CASE WHEN title IS NULL THEN '{' ELSE '{\"title\":' || CAST(to_json(title) AS VARCHAR) || ',' END || '\"category\":' || CAST(to_json(category) AS VARCHAR) || '}' AS slim, len(list_filter(['title', 'source_file', 'language'], lambda x: CASE x WHEN 'title' THEN title IS NULL WHEN 'source_file' THEN source_file IS NULL ELSE language IS NULL END)) AS missing FROM knowledge WHERE category IS NOT NULL")
def h16(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata without nulls (H16), and how many required fields lack."""
    k = table(spark, sf, "knowledge").where("category IS NOT NULL")
    full = F.to_json(F.struct("title", "source_file", "language"))
    return k.select("id", F.to_json(F.struct("title", "category")).alias("slim"), F.size(F.array_except(F.array(F.lit("title"), F.lit("source_file"), F.lit("language")), F.json_object_keys(full))).cast("bigint").alias("missing"))


@query("q_exchange_dates", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def h22(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("q_hash_embedding", "SELECT id, round(list_sum(list_transform(range(0, 32), lambda i: CAST('0x' || sha256(lower(content))[2 * i + 1 : 2 * i + 2] AS BIGINT) / 255.0)), 6) AS total FROM knowledge WHERE content IS NOT NULL")
def h23(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic stand-in for an embedding: bytes of a hash over 255."""
    h = F.sha2(F.lower("content"), 256)
    v = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)
    return table(spark, sf, "knowledge").where("content IS NOT NULL").select("id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
