"""Queries of text functions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.functions import text as T
from weftspark.operators import chunking as C
from weftspark.operators import splitting as P
from weftspark.plans.registry import query
from weftspark.plans.tables import table


@query("q_clean_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t]+|[ \t]+$', '', 'g')) AS h FROM documents")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_text("text")).alias("h"))


@query("q_language_guess", r"SELECT id, CASE WHEN length(regexp_replace(content, '[^\x{0400}-\x{04FF}]', '', 'g')) > length(regexp_replace(content, '[^A-Za-z\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02AF}]', '', 'g')) THEN 'ru' ELSE 'en' END AS lang FROM knowledge")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").select("id", T.language_guess("content").alias("lang"))


@query("q_any_cyrillic", "SELECT id, regexp_matches(source_text, '[А-Яа-яЁё]') AS cyrillic FROM translations")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select("id", T.any_cyrillic("source_text").alias("cyrillic"))


@query("q_slug", r"SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN 'document' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(title, '[^\p{L}\p{N}_]+', '-', 'g')), '^[-_]+|[-_]+$', '', 'g') AS s FROM documents)")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.slug("title").alias("slug"))


@query("q_token_estimate", "SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) AS docs FROM documents GROUP BY source")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.token_estimate("text")).alias("tokens"), F.count("*").alias("docs"))


@query("q_first_paragraph", r"SELECT id, regexp_replace(list_filter(regexp_split_to_array(content, '\n\s*\n'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')[1], '^\s+|\s+$', '', 'g') AS snippet FROM knowledge")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "knowledge").select("id", T.first_paragraph("content").alias("snippet"))


@query("q_paragraph_split", r"SELECT section_id, i - 1 AS ord, p AS paragraph FROM (SELECT section_id, ps, unnest(generate_series(1, len(ps))) AS i, unnest(ps) AS p FROM (SELECT section_id, list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) AS ps FROM raw_sections))")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_sections").select("section_id", F.posexplode(T.paragraphs("content", 20)).alias("ord", "paragraph")).select("section_id", F.col("ord").cast("bigint").alias("ord"), "paragraph")


@query("q_headings", r"SELECT section_id, count(*) AS headings FROM (SELECT section_id, unnest(string_split(content, chr(10))) AS line FROM raw_sections) WHERE length(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '[.!?…]$') GROUP BY section_id")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "raw_sections").select("section_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(F.length("line").between(1, 40) & ~F.col("line").rlike("[.!?…]$")).groupBy("section_id").agg(F.count("*").alias("headings"))


@query("q_sliding_windows", "SELECT section_id, CAST(a AS BIGINT) AS start, substr(content, CAST(a AS BIGINT) + 1, 500) AS piece FROM (SELECT section_id, content, unnest(generate_series(0, length(content) - 1, 400)) AS a FROM raw_sections) WHERE length(substr(content, CAST(a AS BIGINT) + 1, 500)) >= 100")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "raw_sections").where(F.length("content") > 0).select("section_id", "content", F.explode(F.sequence(F.lit(0), F.length("content") - 1, F.lit(400))).alias("a"))
    return s.select("section_id", F.col("a").cast("bigint").alias("start"), F.substring("content", F.col("a") + 1, F.lit(500)).alias("piece")).where(F.length("piece") >= 100)


@query("q_phrases", r"SELECT phrase, count(*) AS entries FROM (SELECT entry_id, unnest(list_distinct(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS phrase FROM (SELECT entry_id, regexp_extract_all(lower(en), '[\p{L}\p{N}]+') AS w FROM glossary WHERE en IS NOT NULL) WHERE len(w) > 0) GROUP BY phrase")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    w = F.array_join(F.regexp_extract_all(F.lower("en"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    return table(spark, sf, "glossary").where("en IS NOT NULL").select("entry_id", F.explode(T.phrases(w)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("entries"))


@query("q_levenshtein", "SELECT doc_id, levenshtein(lower(source), 'forum') AS distance FROM documents")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.levenshtein(F.lower("source"), F.lit("forum")).cast("bigint").alias("distance"))


@query("q_numbers", r"SELECT id, len(regexp_extract_all(source_text, '[0-9]+(?:\.[0-9]+)?')) AS numbers, len(regexp_extract_all(coalesce(translated_text, ''), '[0-9]+(?:\.[0-9]+)?')) AS answer_numbers FROM translations")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).cast("bigint")
    return table(spark, sf, "translations").select("id", n(F.col("source_text")).alias("numbers"), n(F.coalesce("translated_text", F.lit(""))).alias("answer_numbers"))


@query("q_missing_numbers", r"SELECT id, n AS number FROM (SELECT id, a, unnest(list_distinct(s)) AS n FROM (SELECT id, regexp_extract_all(source_text, '[0-9]+') AS s, regexp_extract_all(coalesce(translated_text, ''), '[0-9]+') AS a FROM translations)) WHERE NOT list_contains(a, n)")
def u03(spark: SparkSession, sf: str) -> DataFrame:
    all_ = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return table(spark, sf, "translations").select("id", F.explode(F.array_except(all_(F.col("source_text")), all_(F.coalesce("translated_text", F.lit(""))))).alias("number"))


@query("q_keywords", r"SELECT language, word, n, row_number() OVER (PARTITION BY language ORDER BY n DESC, word) AS rank FROM (SELECT language, word, count(*) AS n FROM (SELECT language, unnest(regexp_extract_all(lower(content), '[\p{L}]{4,}')) AS word FROM knowledge) GROUP BY language, word) QUALIFY rank <= 10")
def a32(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "knowledge").select("language", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("word"))
    w = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    return k.groupBy("language", "word").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10")


@query("q_distinct_first_spelling", "SELECT lower(source) AS key, source FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) = 1")
def u05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source IS NOT NULL").groupBy(F.lower("source").alias("key")).agg(F.min_by("source", "doc_id").alias("source"))


@query("q_extractive_summary", "SELECT id, list_reduce(list_slice(s, 1, greatest(1, CAST(floor(len(s) * 0.3) AS BIGINT))), lambda a, b: a || '. ' || b) AS summary FROM (SELECT id, string_split(content, '. ') AS s FROM knowledge)")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "knowledge").select("id", F.split("content", r"\. ").alias("s"))
    return s.select("id", F.array_join(F.slice("s", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("s") * 0.3).cast("int"))), ". ").alias("summary"))


@query("q_language_code_check", r"SELECT id, coalesce(length(source_lang) BETWEEN 2 AND 10 AND regexp_full_match(source_lang, '[A-Za-z]+(-[A-Za-z]+)*'), false) AS ok FROM translations")
def f29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select("id", F.coalesce(F.length("source_lang").between(2, 10) & F.col("source_lang").rlike(r"^[A-Za-z]+(-[A-Za-z]+)*$"), F.lit(False)).alias("ok"))


# Section texts with their heading lines (short, without a stop) written as headings of each kind.
HEADED = "regexp_replace(content, '(?m)^([^\n.!?…]{{1,40}})$', '{}', 'g')"


def headed(spark: SparkSession, sf: str, form: str) -> DataFrame:
    return table(spark, sf, "raw_sections").select("section_id", F.regexp_replace("content", r"(?m)^([^\n.!?…]{1,40})$", form).alias("text"))


def _sections(form: str, head: str, title: str) -> str:
    return rf"""SELECT section_id, CAST(section - 1 AS BIGINT) AS section, max(CASE WHEN head THEN {title} END) AS title, CAST(min(off) AS BIGINT) AS start, md5(regexp_replace(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), '^\s+|\s+$', '', 'g')) AS h
FROM (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY section_id ORDER BY n) AS section, coalesce(sum(length(line) + 1) OVER (PARTITION BY section_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
FROM (SELECT section_id, n, ls[n] AS line, regexp_matches(ls[n], '{head}') AS head FROM (SELECT section_id, ls, unnest(generate_series(1, len(ls))) AS n FROM (SELECT section_id, string_split({HEADED.format(form)}, chr(10)) AS ls FROM raw_sections))))
WHERE section > 0 GROUP BY section_id, section HAVING length(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head), ''), '^\s+|\s+$', '', 'g')) > 0"""


def _found(d: DataFrame) -> DataFrame:
    return d.select(F.col("id").alias("section_id"), F.col("section").cast("bigint").alias("section"), "title", "start", F.md5("content").alias("h"))


@query("q_markdown_sections", _sections(r"## \1", r"^(#{1,6})\s+(.+)$", "line[4:]"))
def c03(spark: SparkSession, sf: str) -> DataFrame:
    return _found(P.markdown(headed(spark, sf, "## $1"), "section_id", "text"))


@query("q_chapter_sections", _sections(r"Chapter 7: \1", r"^Chapter\s+\d+[:.]\s*.+$", "line"))
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return _found(P.chapters(headed(spark, sf, "Chapter 7: $1"), "section_id", "text"))


@query("q_capital_sections", _sections("HEADING LINE", "^[А-ЯA-Z][А-ЯA-Z ]{5,}$", "line"))
def c05b(spark: SparkSession, sf: str) -> DataFrame:
    return _found(P.capitals(headed(spark, sf, "HEADING LINE"), "section_id", "text"))


@query("q_split_strategy", r"SELECT section_id, CASE WHEN regexp_matches(content, '(?m)^(#{1,6})\s+(.+)$') THEN 'markdown' WHEN regexp_matches(content, '(?im)^(глава|chapter|раздел|section)\s+\d+[:.]\s*.+$') THEN 'chapters' WHEN regexp_matches(content, '(?m)^[А-ЯA-Z][А-ЯA-Z ]{5,}$') THEN 'headings' WHEN length(content) < 3000 THEN 'paragraphs' ELSE 'fixed' END AS kind FROM raw_sections")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_sections").select("section_id", P.strategy(F.col("content")).alias("kind"))


@query("q_split_documents")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    """The dispatcher over whole documents (C01, C07, C08); by brute force in the tests."""
    return P.split(table(spark, sf, "documents"), "doc_id", "text", least=100, most=2_000, size=800)


@query("q_chunk_strategies")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunking strategy over the sections, with contexts (C09 to C14, W05); by invariants in the tests."""
    out = None
    for how in C.STRATEGIES:
        d = C.with_contexts(C.chunks(table(spark, sf, "raw_sections"), "section_id", "content", how, 500, 100, 20), 80).select(F.lit(how).alias("how"), F.col("id").alias("section_id"), "chunk_no", "level", "text", "prefix_context", "suffix_context")
        out = d if out is None else out.union(d)
    return out


@query("q_carried_headings", r"SELECT section_id, n, coalesce(last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY section_id ORDER BY n), 'cover') AS heading FROM (SELECT section_id, n - 1 AS n, ls[n] AS line, length(ls[n]) BETWEEN 1 AND 40 AND NOT regexp_matches(ls[n], '[.!?…]$') AS head FROM (SELECT section_id, ls, unnest(generate_series(1, len(ls))) AS n FROM (SELECT section_id, string_split(content, chr(10)) AS ls FROM raw_sections)))")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    """Lines carry the heading before them; those before the first one are the cover's."""
    lines = table(spark, sf, "raw_sections").select("section_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    head = F.length("line").between(1, 40) & ~F.col("line").rlike("[.!?…]$")
    w = Window.partitionBy("section_id").orderBy("n")
    return lines.select("section_id", F.col("n").cast("bigint").alias("n"), F.coalesce(F.last(F.when(head, F.col("line")), ignorenulls=True).over(w), F.lit("cover")).alias("heading"))


@query("q_section_types", "SELECT section_id, CASE WHEN regexp_matches(lower(title), 'мат|mat') THEN 'materials' WHEN regexp_matches(lower(title), 'плот|gauge|échantillon|maschenprobe') THEN 'gauge' WHEN regexp_matches(lower(title), 'сбор|finish|assembl|fertig') THEN 'finishing' WHEN regexp_matches(lower(title), 'рук|sleeve|manch|ärmel') THEN 'sleeves' ELSE 'instructions' END AS kind FROM raw_sections")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule in order that fits the heading, else instructions."""
    t = F.lower("title")
    kind = F.when(t.rlike("мат|mat"), "materials").when(t.rlike("плот|gauge|échantillon|maschenprobe"), "gauge").when(t.rlike("сбор|finish|assembl|fertig"), "finishing").when(t.rlike("рук|sleeve|manch|ärmel"), "sleeves").otherwise("instructions")
    return table(spark, sf, "raw_sections").select("section_id", kind.alias("kind"))


HINTED = {"technique": ["row", "ряд", "rang", "reihe"], "material": ["yarn", "пряж", "fil ", "garn"], "measure": ["cm", "см", "gauge", "плотност"]}


@query("q_keyword_category", "SELECT id, CASE WHEN greatest(" + ", ".join(f"t{i}" for i in range(3)) + ") = 0 THEN 'general' " + " ".join(f"WHEN t{i} = greatest(t0, t1, t2) THEN '{k}'" for i, k in enumerate(HINTED)) + " END AS guess FROM (SELECT id, " + ", ".join(" + ".join(f"CAST(contains(lower(coalesce(title, '') || ' ' || substr(content, 1, 500)), '{w}') AS INT)" for w in ws) + f" AS t{i}" for i, ws in enumerate(HINTED.values())) + " FROM knowledge WHERE content IS NOT NULL)")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    """The category with most hints in title and beginning, the first of equals (F27, F28); the beginning is part of the rule."""
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring("content", 1, 500)))
    n = {k: sum((F.contains(t, F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in HINTED.items()}
    best = F.greatest(*n.values())
    kind = F.when(best == 0, "general")
    for k, c in n.items():
        kind = kind.when(c == best, k)
    return table(spark, sf, "knowledge").where("content IS NOT NULL").select("id", kind.alias("guess"))


@query("q_marker_counts", r"SELECT source_id, len(m) AS markers, len(list_distinct(m)) AS different FROM (SELECT source_id, regexp_extract_all(string_agg('[[c-' || chunk_id || ']] ' || text, chr(10) ORDER BY chunk_id, text), '\[\[([a-z0-9_-]+)\]\]', 1) AS m FROM chunks GROUP BY source_id)")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    """Markers put before each chunk (F24), found again (F23, A30), and those that came twice."""
    c = table(spark, sf, "chunks").select("source_id", F.explode(T.markers(F.concat(F.lit("[[c-"), F.col("chunk_id").cast("string"), F.lit("]] "), "text"))).alias("m"))
    return c.groupBy("source_id").agg(F.count("*").alias("markers"), F.count_distinct("m").alias("different"))


@query("q_sentence_budget", "SELECT id, md5(array_to_string(list_slice(s, 1, greatest(1, len(list_filter(range(1, len(s) + 1), lambda i: length(array_to_string(list_slice(s, 1, i), '. ')) <= 200)))), '. ')) AS h FROM (SELECT id, string_split(content, '. ') AS s FROM knowledge WHERE content IS NOT NULL)")
def f34(spark: SparkSession, sf: str) -> DataFrame:
    """Leading sentences up to a budget of characters, at least one."""
    s = table(spark, sf, "knowledge").where("content IS NOT NULL").select("id", F.split("content", r"\. ").alias("s"))
    fits = F.size(F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: F.length(F.array_join(F.slice("s", 1, i), ". ")) <= 200))
    return s.select("id", F.md5(F.array_join(F.slice("s", F.lit(1), F.greatest(F.lit(1), fits)), ". ")).alias("h"))
