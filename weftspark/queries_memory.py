"""Queries over the segment memory, the glossary and the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.functions.text import alias_parts, cosine
from weftspark.operators import memory as M
from weftspark.operators import retrieval as R
from weftspark.plans.registry import query
from weftspark.plans.tables import table

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("q_memory_stats_by_pair", "SELECT source_lang, target_lang, count(*) AS entries, CAST(coalesce(sum(usage_count), 0) AS BIGINT) AS total_usage, round(avg(quality_score), 6) AS avg_quality FROM translations GROUP BY ALL")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return M.stats(table(spark, sf, "translations"))


@query("q_memory_totals", "SELECT count(*) AS entries, CAST(sum(usage_count) AS BIGINT) AS total_usage, count(DISTINCT source_text) AS texts, CAST(count(*) FILTER (WHERE quality_score >= 0.8) AS BIGINT) AS good FROM translations")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").agg(F.count("*").alias("entries"), F.sum("usage_count").cast("bigint").alias("total_usage"), F.count_distinct("source_text").alias("texts"), F.count_if(F.col("quality_score") >= 0.8).alias("good"))


@query("q_memory_key", "SELECT id, md5(coalesce(source_lang, '') || ':' || coalesce(target_lang, '') || ':' || coalesce(source_text, '')) AS key FROM translations")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select("id", M.memory_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang")).alias("key"))


@query("q_content_hash", "SELECT id, sha256(content) AS hash FROM knowledge")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").select("id", F.sha2("content", 256).alias("hash"))


@query("q_exact_lookup", "SELECT n.id, min(o.id) AS hit FROM translations n JOIN translations o ON n.source_text = o.source_text AND n.target_lang = o.target_lang AND o.batch_no < n.batch_no GROUP BY n.id")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    """First earlier entry with the same text and target, by one window over (text, target) classes."""
    t = table(spark, sf, "translations").where("source_text IS NOT NULL AND target_lang IS NOT NULL")
    per = t.groupBy("source_text", "target_lang", "batch_no").agg(F.min("id").alias("m"))
    w = Window.partitionBy("source_text", "target_lang").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = per.withColumn("hit", F.min("m").over(w)).where("hit IS NOT NULL")
    return t.join(seen, ["source_text", "target_lang", "batch_no"]).select("id", "hit")


@query("q_top_examples", "SELECT source_lang, target_lang, id, quality_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_lang, target_lang ORDER BY quality_score DESC NULLS LAST, usage_count DESC NULLS LAST, ts DESC NULLS LAST, id) AS rank FROM translations WHERE quality_score >= 0.8) WHERE rank <= 5")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_examples(table(spark, sf, "translations"), 5, 0.8).select("source_lang", "target_lang", "id", "quality_score", F.col("rank").cast("bigint").alias("rank"))


@query("q_warm_cache", "SELECT id, usage_count, quality_score FROM translations ORDER BY usage_count DESC NULLS LAST, quality_score DESC NULLS LAST, id LIMIT 100")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select("id", "usage_count", "quality_score").orderBy(F.desc_nulls_last("usage_count"), F.desc_nulls_last("quality_score"), "id").limit(100)


@query("q_quality_fold", "WITH RECURSIVE o AS (SELECT context, quality_score AS q, row_number() OVER (PARTITION BY context ORDER BY id) AS i FROM translations WHERE context IS NOT NULL AND quality_score IS NOT NULL), f AS (SELECT context, i, q FROM o WHERE i = 1 UNION ALL SELECT o.context, o.i, (f.q + o.q) / 2 FROM f JOIN o ON o.context = f.context AND o.i = f.i + 1) SELECT context, i AS usage, round(q, 6) AS quality FROM f QUALIFY row_number() OVER (PARTITION BY context ORDER BY i DESC) = 1")
def w08(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").where("context IS NOT NULL")
    return M.fold_quality(t, ["context"], ["id"], "quality_score").select("context", "usage", F.round("quality", 6).alias("quality"))


@query("q_insert_ignore", "SELECT id, source_text, target_lang FROM translations QUALIFY row_number() OVER (PARTITION BY source_text, target_lang ORDER BY batch_no, id) = 1")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return M.keep_first(table(spark, sf, "translations"), ["source_text", "target_lang"], ["batch_no", "id"]).select("id", "source_text", "target_lang")


@query("q_upsert", """WITH o AS (SELECT source_text, target_lang, id, usage_count FROM translations WHERE batch_no = 0 QUALIFY row_number() OVER (PARTITION BY source_text, target_lang ORDER BY id) = 1),
n AS (SELECT source_text, target_lang, min(id) AS id, count(*) AS c FROM translations WHERE batch_no > 0 GROUP BY ALL)
SELECT coalesce(o.id, n.id) AS id, CAST(CASE WHEN o.id IS NULL THEN n.c ELSE coalesce(o.usage_count, 0) + coalesce(n.c, 0) END AS BIGINT) AS usage_count FROM o FULL JOIN n ON o.source_text = n.source_text AND o.target_lang = n.target_lang""")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").select("source_text", "target_lang", "id", "usage_count", "batch_no")
    old = M.keep_first(t.where("batch_no = 0"), ["source_text", "target_lang"], ["id"]).drop("batch_no")
    return M.upsert(old, t.where("batch_no > 0").drop("batch_no"), ["source_text", "target_lang"], ["id"]).select("id", F.col("usage_count").cast("bigint").alias("usage_count"))


@query("q_term_signature", "SELECT signature, count(*) AS segments FROM (SELECT CASE WHEN len(coalesce(glossary_terms, [])) = 0 THEN '__no_terms__' ELSE array_to_string(list_sort(list_distinct(glossary_terms)), '|') END AS signature FROM translations) GROUP BY ALL")
def a43(spark: SparkSession, sf: str) -> DataFrame:
    return M.term_signature(table(spark, sf, "translations")).groupBy("signature").agg(F.count("*").alias("segments"))


@query("q_term_frequency_cap", "SELECT term, count(DISTINCT id) AS segments FROM (SELECT id, unnest(glossary_terms) AS term FROM translations) GROUP BY term ORDER BY segments DESC, term LIMIT 50")
def a44(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").select("id", F.explode("glossary_terms").alias("term"))
    return t.groupBy("term").agg(F.count_distinct("id").alias("segments")).orderBy(F.desc("segments"), "term").limit(50)


@query("q_segments_with_terms", "SELECT t.id, g.entry_id FROM (SELECT DISTINCT id, unnest(glossary_terms) AS term FROM translations) t JOIN glossary g ON g.term_key = t.term")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").select("id", F.explode("glossary_terms").alias("term_key")).distinct()
    return t.join(table(spark, sf, "glossary"), "term_key").select("id", "entry_id")


@query("q_glossary_stats", "SELECT category, count(*) AS entries, count(DISTINCT term_key) AS keys, count(fr) AS with_fr FROM glossary GROUP BY category")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").groupBy("category").agg(F.count("*").alias("entries"), F.count_distinct("term_key").alias("keys"), F.count("fr").alias("with_fr"))


@query("q_glossary_by_key", "SELECT term_key, entry_id, ru, en FROM glossary QUALIFY row_number() OVER (PARTITION BY term_key ORDER BY entry_id DESC) = 1")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").groupBy("term_key").agg(F.max_by(F.struct("entry_id", "ru", "en"), "entry_id").alias("x")).select("term_key", "x.*")


@query("q_protected_tokens", "SELECT token, count(*) AS entries FROM (SELECT unnest(protected_tokens) AS token FROM glossary) GROUP BY token")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").select(F.explode("protected_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("entries"))


@query("q_glossary_long", "SELECT entry_id, 'ru' AS lang, ru AS term FROM glossary WHERE ru IS NOT NULL UNION ALL SELECT entry_id, 'en', en FROM glossary WHERE en IS NOT NULL UNION ALL SELECT entry_id, 'fr', fr FROM glossary WHERE fr IS NOT NULL")
def g_long(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").unpivot("entry_id", ["ru", "en", "fr"], "lang", "term").where("term IS NOT NULL").select("entry_id", "lang", "term")


@query("q_glossary_seed", "SELECT entry_id, 'en' AS target_lang, sha256('ru:en:' || lower(ru)) AS key, en AS translated_text FROM glossary WHERE ru <> '' AND en <> '' UNION ALL SELECT entry_id, 'fr', sha256('ru:fr:' || lower(ru)), fr FROM glossary WHERE ru <> '' AND fr <> ''")
def m09(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "glossary").where("ru <> ''").select("entry_id", "ru", F.explode(F.array(F.struct(F.lit("en").alias("l"), F.col("en").alias("t")), F.struct(F.lit("fr").alias("l"), F.col("fr").alias("t")))).alias("x")).where("x.t <> ''")
    return g.select("entry_id", F.col("x.l").alias("target_lang"), F.sha2(F.concat(F.lit("ru:"), F.col("x.l"), F.lit(":"), F.lower("ru")), 256).alias("key"), F.col("x.t").alias("translated_text"))


B = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"  # blanks of any width, spelt out: the two engines' \s differ


@query("q_alias_parse", rf"SELECT entry_id, regexp_extract(t, '^(.*?) *(?:\(([^()]*)\))?$', 1) AS main, CASE WHEN regexp_extract(t, '^(.*?) *(?:\(([^()]*)\))?$', 2) = '' THEN 0 ELSE len(list_filter(string_split(regexp_extract(t, '^(.*?) *(?:\(([^()]*)\))?$', 2), ','), lambda x: trim(x) <> '')) END AS aliases FROM (SELECT entry_id, trim(regexp_replace(en, '{B}+', ' ', 'g')) AS t FROM glossary WHERE en IS NOT NULL)")
def f30(spark: SparkSession, sf: str) -> DataFrame:
    t = F.trim(F.regexp_replace("en", r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", " "))
    return table(spark, sf, "glossary").where("en IS NOT NULL").select("entry_id", alias_parts(t).alias("p")).select("entry_id", "p.main", F.size("p.aliases").cast("bigint").alias("aliases"))


@query("q_inverted_terms", r"SELECT word, count(DISTINCT entry_id) AS entries FROM (SELECT entry_id, unnest(regexp_extract_all(lower(en), '[\p{L}\p{N}]+')) AS word FROM glossary) GROUP BY word")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "glossary").select("entry_id", F.explode(F.regexp_extract_all(F.lower("en"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count_distinct("entry_id").alias("entries"))


USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def usable(df: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size("embedding") == 64) & ~bad & F.exists("embedding", lambda x: x != 0))


@query("q_vector_search", f"SELECT query_id, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS}, 12) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) QUALIFY rank <= 20")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    """The exact neighbours of every row whose id is divisible by 100, among all rows."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.nearest(e, "vec_id", "embedding", q, 20).select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query("q_rescaled_cosine", f"SELECT b.vec_id AS id, a.vec_id AS query_id, round((1 + {COS}) / 2, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def h09(spark: SparkSession, sf: str) -> DataFrame:
    """Every row against each query (H09): the queries, one row in a hundred, are what is broadcast or not, by the session's threshold."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.size("embedding").alias("n"))
    return e.withColumn("n", F.size("embedding")).join(q, "n").select(F.col("vec_id").alias("id"), "query_id", F.round((cosine("embedding", "q") + 1) / 2, 6).alias("similarity"))


def _fulltext(words: list[str]) -> str:
    times = [f"len(list_filter(w, lambda x: x = '{x}'))" for x in words]
    counts = ", ".join(f"{t} AS c{i}" for i, t in enumerate(times))
    score = " + ".join(f"c{i} * 1.0 / len(w) * ln(1 + (SELECT count(*) FROM k) * 1.0 / (SELECT count(*) FROM k WHERE c{i} > 0))" for i in range(len(words)))
    return f"WITH k AS (SELECT id, w, {counts} FROM (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM knowledge) WHERE len(w) > 0) SELECT id, {score} AS score FROM k WHERE " + " AND ".join(f"c{i} > 0" for i in range(len(words))) + " ORDER BY score DESC, id LIMIT 200"


WORDS = {"en": ["stitches", "until"], "ru": ["петель", "пока"], "fr": ["mailles", "que"], "de": ["maschen", "bis"]}


@query("q_fulltext", " UNION ALL ".join(f"SELECT '{x}' AS query, id, round(score, 6) AS score FROM ({_fulltext(w)})" for x, w in WORDS.items()))
def r01(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 best texts with all words of a query, for a query in each language."""
    out = None
    for x, w in WORDS.items():
        d = R.fulltext(table(spark, sf, "knowledge"), "id", "content", w).select(F.lit(x).alias("query"), "id", F.round("score", 6).alias("score"))
        out = d if out is None else out.union(d)
    return out


@query("q_hybrid_search", f"""WITH t AS ({_fulltext(WORDS['en'])}),
u AS (SELECT id, embedding FROM knowledge WHERE {USABLE}), v AS (SELECT b.id, round({COS}, 12) AS score FROM u a, u b WHERE a.id = (SELECT min(id) FROM u) ORDER BY score DESC, id LIMIT 200)
SELECT id, round(score, 6) AS score FROM (SELECT coalesce(t.id, v.id) AS id, round(0.6 * coalesce(t.score, 0) / (SELECT max(score) FROM t) + 0.4 * coalesce(v.score, 0) / (SELECT max(score) FROM v), 9) AS score FROM t FULL JOIN v ON t.id = v.id) ORDER BY score DESC, id LIMIT 50""")
def r03(spark: SparkSession, sf: str) -> DataFrame:
    """Full text and vectors of the same entries, fused by their maxima."""
    k = usable(table(spark, sf, "knowledge"))
    q = k.orderBy("id").limit(1).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    v = R.nearest(k, "id", "embedding", q, 200).select("id", F.col("cosine").alias("score"))
    return R.fuse(R.fulltext(table(spark, sf, "knowledge"), "id", "content", WORDS["en"]), v, 0.6, 50).select("id", F.round("score", 6).alias("score"))


@query("q_knowledge_search", f"WITH u AS (SELECT id, category, embedding, created_at FROM knowledge WHERE {USABLE}), p AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY category ORDER BY created_at DESC NULLS LAST, id) <= 100) SELECT query_id, id, round(s, 6) AS similarity FROM (SELECT a.id AS query_id, b.id, round((1 + {COS}) / 2, 9) AS s FROM u a JOIN p b ON a.category = b.category AND a.id <> b.id WHERE a.id % 100 = 0) WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5")
def r08(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the same category, the newest 100 first, then by rescaled cosine."""
    u = usable(table(spark, sf, "knowledge")).select("id", "category", "embedding", "created_at")
    w = Window.partitionBy("category").orderBy(F.desc_nulls_last("created_at"), "id")
    p = u.withColumn("r", F.row_number().over(w)).where("r <= 100").select("id", "category", F.col("embedding").alias("v"))
    d = u.where("id % 100 = 0").select(F.col("id").alias("query_id"), "category", "embedding").join(p, "category").where("id <> query_id").select("query_id", "id", F.round((cosine("embedding", "v") + 1) / 2, 9).alias("s")).where("s >= 0.6")
    return d.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "id"))).where("r <= 5").select("query_id", "id", F.round("s", 6).alias("similarity"))


SIMILAR = f"""WITH m AS (SELECT id, source_text, source_lang, target_lang, usage_count, quality_score, CASE WHEN {USABLE} THEN embedding END AS embedding FROM translations WHERE source_lang IS NOT NULL AND target_lang IS NOT NULL),
q AS (SELECT m.*, (SELECT min(o.id) FROM m o WHERE o.source_text = m.source_text AND o.source_lang = m.source_lang AND o.target_lang = m.target_lang) AS a, (SELECT max(o.id) FROM m o WHERE o.source_text = m.source_text AND o.source_lang = m.source_lang AND o.target_lang = m.target_lang) AS z FROM m WHERE id % 100 = 0),
e AS (SELECT *, CASE WHEN a <> id THEN a WHEN z <> id THEN z END AS exact FROM q),
p AS (SELECT * FROM m WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang ORDER BY usage_count DESC NULLS LAST, quality_score DESC NULLS LAST, id) <= 1000)
SELECT id, exact AS match_id, 1.0 AS similarity FROM e WHERE exact IS NOT NULL UNION ALL SELECT id, match_id, round(s, 6) FROM (SELECT a.id, b.id AS match_id, round((1 + {COS}) / 2, 9) AS s FROM e a JOIN p b ON a.source_lang = b.source_lang AND a.target_lang = b.target_lang AND a.id <> b.id WHERE a.exact IS NULL AND a.embedding IS NOT NULL) WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) <= 5"""


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").where("source_lang IS NOT NULL AND target_lang IS NOT NULL")
    ok = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    m = t.select("id", "source_text", "source_lang", "target_lang", "usage_count", "quality_score", F.when(ok, F.col("embedding")).alias("vector"))
    return M.similar_entries(m.where("id % 100 = 0").select("id", "source_text", "source_lang", "target_lang", "vector"), m, 0.6, 5)


@query("q_similar_entries", SIMILAR)
def r04(spark: SparkSession, sf: str) -> DataFrame:
    """Similar entries of the memory for every hundredth one."""
    return _similar(spark, sf).select("id", "match_id", F.round("similarity", 6).alias("similarity"))


@query("q_examples", f"SELECT s.id, md5(t.source_text || coalesce(t.translated_text, '')) AS example, s.similarity FROM ({SIMILAR}) s JOIN translations t ON t.id = s.match_id WHERE s.similarity >= 0.7")
def r06(spark: SparkSession, sf: str) -> DataFrame:
    """Examples for a prompt: texts of similar entries."""
    t = table(spark, sf, "translations").select(F.col("id").alias("match_id"), "source_text", F.coalesce("translated_text", F.lit("")).alias("answer"))
    return _similar(spark, sf).where("similarity >= 0.7").join(t, "match_id").select("id", F.md5(F.concat("source_text", "answer")).alias("example"), F.round("similarity", 6).alias("similarity"))


@query("q_term_suggestions", r"SELECT source_text, target_lang, count(*) AS frequency, arg_max(translated_text, id) FILTER (WHERE translated_text IS NOT NULL) AS translation, array_to_string(list_slice(list(context ORDER BY id) FILTER (WHERE context IS NOT NULL), greatest(count(context) - 4, 1), count(context)), '|') AS contexts FROM translations WHERE translated_text IS NOT NULL GROUP BY source_text, target_lang HAVING count(*) >= 2")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that come again: how often, with which last translation, in which last five contexts."""
    t = table(spark, sf, "translations").where("translated_text IS NOT NULL").select("source_text", "target_lang", F.col("translated_text").alias("translation"), "context", "id")
    d = M.suggestions(t.where("target_lang IS NOT NULL"), ["source_text", "target_lang"], "id").where("frequency >= 2")
    return d.select("source_text", "target_lang", "frequency", "translation", F.array_join("contexts", "|").alias("contexts"))


KEY = """sha256('{"g":0,"m":"unknown","s":' || CAST(to_json(coalesce(source_lang, '')) AS VARCHAR) || ',"t":' || CAST(to_json(regexp_replace(lower(source_text), '^\\s+|\\s+$', '', 'g')) AS VARCHAR) || ',"tgt":' || CAST(to_json(coalesce(target_lang, '')) AS VARCHAR) || '}')""".replace("\\\\", "\\")


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").where("source_text IS NOT NULL").withColumn("key", M.versioned_key(F.col("source_text"), F.col("source_lang"), F.col("target_lang")))


@query("q_versioned_keys", f"SELECT id, {KEY} AS key, CAST('0x' || {KEY}[:12] AS BIGINT) AS version FROM translations WHERE source_text IS NOT NULL")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned cache keys (H01), and their first 48 bits as a number."""
    return keyed(spark, sf).select("id", "key", F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint").alias("version"))


@query("q_cache_split", f"WITH k AS (SELECT id, batch_no, usage_count, {KEY} AS key FROM translations WHERE source_text IS NOT NULL), m AS (SELECT key, min(id) AS match_id, arg_min(coalesce(usage_count, 0), id) AS version FROM k WHERE batch_no = 0 GROUP BY key) SELECT k.id, CASE WHEN m.key IS NULL THEN 'miss' WHEN m.version < 5 THEN 'stale' ELSE 'hit' END AS state, CASE WHEN m.version >= 5 THEN m.match_id END AS match_id FROM k LEFT JOIN m USING (key) WHERE k.batch_no > 0")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that the memory answers, those it answers with an entry too old, and the rest."""
    k = keyed(spark, sf)
    memory = k.where("batch_no = 0").select("key", F.col("id").alias("match_id"), F.coalesce("usage_count", F.lit(0)).alias("version"))
    return M.lookup(k.where("batch_no > 0").select("id", "key"), memory, (5, 0))


@query("q_cache_hit_rate", f"WITH k AS (SELECT id, batch_no, {KEY} AS key FROM translations WHERE source_text IS NOT NULL) SELECT batch_no, count(*) AS segments, round(count(*) FILTER (WHERE key IN (SELECT key FROM k WHERE batch_no = 0)) * 1.0 / count(*), 6) AS hit_rate FROM k WHERE batch_no > 0 GROUP BY batch_no")
def a36(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed(spark, sf).select("id", "batch_no", "key")
    m = k.where("batch_no = 0").select("key").distinct().withColumn("hit", F.lit(1))
    return k.where("batch_no > 0").join(m, "key", "left").groupBy("batch_no").agg(F.count("*").alias("segments"), F.round(F.count("hit") / F.count("*"), 6).alias("hit_rate"))


@query("q_memory_merge", f"WITH k AS (SELECT id, quality_score, {KEY} AS key FROM translations WHERE source_text IS NOT NULL) SELECT key, count(*) AS usage, min(id) AS first_id, round(max(quality_score), 6) AS best FROM k GROUP BY key HAVING count(*) > 1")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by versioned key: the first one's text stays, usage counts up."""
    return keyed(spark, sf).groupBy("key").agg(F.count("*").alias("usage"), F.min("id").alias("first_id"), F.round(F.max("quality_score"), 6).alias("best")).where("usage > 1")


@query("q_memory_delete", f"WITH k AS (SELECT id, batch_no, {KEY} AS key FROM translations WHERE source_text IS NOT NULL) SELECT id FROM k WHERE key NOT IN (SELECT key FROM k WHERE batch_no = 8)")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed(spark, sf).select("id", "batch_no", "key")
    return k.join(k.where("batch_no = 8").select("key"), "key", "left_anti").select("id")


@query("q_simple_examples", "SELECT source_lang, target_lang, id FROM translations WHERE quality_score >= 0.7 QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang ORDER BY quality_score DESC, usage_count DESC NULLS LAST, id) <= 3")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot examples by quality and usage, ties in order of entry."""
    w = Window.partitionBy("source_lang", "target_lang").orderBy(F.desc("quality_score"), F.desc_nulls_last("usage_count"), "id")
    return table(spark, sf, "translations").where("quality_score >= 0.7").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source_lang", "target_lang", "id")


@query("q_simple_statistics", "SELECT count(*) AS entries, CAST(coalesce(sum(usage_count), 0) AS BIGINT) AS usage, round(avg(quality_score), 6) AS quality, (SELECT count(*) FROM (SELECT source_text, target_lang FROM translations GROUP BY ALL HAVING count(*) >= 3)) AS frequent FROM translations")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations")
    often = t.groupBy("source_text", "target_lang").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= 3).alias("frequent"))
    return t.agg(F.count("*").alias("entries"), F.coalesce(F.sum("usage_count"), F.lit(0)).cast("bigint").alias("usage"), F.round(F.avg("quality_score"), 6).alias("quality")).crossJoin(often)  # one row each


@query("q_metadata_value", "SELECT id, metadata['section_level'] AS level FROM knowledge WHERE metadata['section_level'] IS NOT NULL")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").select("id", F.col("metadata").getItem("section_level").alias("level")).where("level IS NOT NULL")


@query("q_metadata_upsert", "SELECT source_file AS key, arg_max(metadata['section_level'], id) AS value, max(id) AS set_by FROM knowledge WHERE source_file IS NOT NULL AND metadata['section_level'] IS NOT NULL GROUP BY source_file")
def m08(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge").select(F.col("source_file").alias("key"), F.col("metadata").getItem("section_level").alias("value"), "id").where("key IS NOT NULL AND value IS NOT NULL")
    return k.groupBy("key").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("set_by"))


@query("q_protected_membership", "SELECT entry_id, ru IN (SELECT unnest(protected_tokens) FROM glossary) AS ru_protected, en IN (SELECT unnest(protected_tokens) FROM glossary) AS en_protected FROM glossary WHERE ru IS NOT NULL AND en IS NOT NULL")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "glossary").where("ru IS NOT NULL AND en IS NOT NULL")
    p = g.select(F.explode("protected_tokens").alias("token")).distinct()
    d = g.select("entry_id", "ru", "en").join(p.select(F.col("token").alias("ru"), F.lit(True).alias("r")), "ru", "left").join(p.select(F.col("token").alias("en"), F.lit(True).alias("e")), "en", "left")
    return d.select("entry_id", F.coalesce("r", F.lit(False)).alias("ru_protected"), F.coalesce("e", F.lit(False)).alias("en_protected"))


@query("q_glossary_of_category", "SELECT entry_id, term_key FROM glossary WHERE category = 'unit'")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").where("category = 'unit'").select("entry_id", "term_key")


@query("q_glossary_prompt", "SELECT category, md5(string_agg('- ' || ru || ' → ' || en, chr(10) ORDER BY term_key, entry_id)) AS h, count(*) AS n FROM glossary WHERE category IN ('abbreviation', 'term', 'unit') AND ru IS NOT NULL AND en IS NOT NULL GROUP BY category")
def f32(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt's lines by category in order of key (F32, F33); a prompt is one text, so its lines meet in one row."""
    g = table(spark, sf, "glossary").where("category IN ('abbreviation', 'term', 'unit') AND ru IS NOT NULL AND en IS NOT NULL")
    lines = F.array_sort(F.collect_list(F.struct("term_key", "entry_id", F.concat(F.lit("- "), "ru", F.lit(" → "), "en").alias("line"))))
    return g.groupBy("category").agg(F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("h"), F.count("*").alias("n"))


@query("q_newline_check", "SELECT id, len(source_text) - len(replace(source_text, chr(10), '')) AS source_lines, len(translated_text) - len(replace(translated_text, chr(10), '')) AS answer_lines FROM translations WHERE len(source_text) - len(replace(source_text, chr(10), '')) <> len(translated_text) - len(replace(translated_text, chr(10), ''))")
def v07(spark: SparkSession, sf: str) -> DataFrame:
    lines = lambda c: (F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))).cast("bigint")
    return table(spark, sf, "translations").select("id", lines("source_text").alias("source_lines"), lines("translated_text").alias("answer_lines")).where("source_lines <> answer_lines")


@query("q_length_ratio", "SELECT id, round(length(translated_text) * 1.0 / length(source_text), 6) AS ratio FROM translations WHERE length(source_text) > 15 AND length(translated_text) > 15 AND (length(translated_text) * 1.0 / length(source_text) < 0.5 OR length(translated_text) * 1.0 / length(source_text) > 1.4)")
def v05(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations").where((F.length("source_text") > 15) & (F.length("translated_text") > 15))
    return t.select("id", (F.length("translated_text") / F.length("source_text")).alias("ratio")).where((F.col("ratio") < 0.5) | (F.col("ratio") > 1.4)).select("id", F.round("ratio", 6).alias("ratio"))


@query("q_long_tokens", r"SELECT id, max(length(w)) AS longest FROM (SELECT id, unnest(regexp_split_to_array(translated_text, '\s+')) AS w FROM translations) GROUP BY id HAVING max(length(w)) > 14")
def v05b(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "translations")
    return t.select("id", F.array_max(F.transform(F.split("translated_text", r"\s+"), lambda w: F.length(w))).cast("bigint").alias("longest")).where("longest > 14")
