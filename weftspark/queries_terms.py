"""Queries of glossary terms in texts: matching, validation, enforcement, selection and the gate on segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import segments as S
from weftspark.operators import terms as T
from weftspark.operators import verification as V
from weftspark.plans.registry import query
from weftspark.plans.tables import table

W = r"list_aggregate(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), 'string_agg', ' ')"
PAD = lambda c: f"' ' || {W.format(c)} || ' '"
TR = f"(SELECT *, {PAD('source_text')} AS tw FROM translations)"
HIT = "contains(t.tw, g.gw)"
RU_EN = "t.source_lang = 'ru' AND t.target_lang = 'en'"
CONTAINS = r"regexp_matches(lower({0}), '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(lower({1})) || CASE WHEN regexp_full_match({1}, '[\p{{L}} ]+') THEN '(''s|s)?' ELSE '' END || '($|[^\p{{L}}\p{{N}}_])')"


# Glossary entries carry an invented name in each term, which no text repeats; the common words before or after it are the terms here.
RU, EN, FR = r"^([а-яё ]+) [А-ЯЁA-Z]", r"^[^ ]+ ([^,(]+)", r"^([a-zàâçéèêëîïôûùœ ]+) [A-Z]"
HEADS = f"(SELECT entry_id, term_key, category, protected_tokens, trim(regexp_extract(ru, '{RU}', 1)) AS ru, trim(regexp_extract(en, '{EN}', 1)) AS en, trim(regexp_extract(fr, '{FR}', 1)) AS fr FROM glossary)"
GL = f"(SELECT *, {PAD('ru')} AS gw FROM {HEADS})"


def heads(spark: SparkSession, sf: str) -> DataFrame:
    head = lambda c, form: F.trim(F.regexp_extract(c, form, 1)).alias(c)
    return table(spark, sf, "glossary").select("entry_id", "term_key", "category", "protected_tokens", head("ru", RU), head("en", EN), head("fr", FR))


def terms_of(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return heads(spark, sf).select(F.col("entry_id").alias("term_id"), F.col(lang).alias("term"))


def texts_of(spark: SparkSession, sf: str, column: str = "source_text") -> DataFrame:
    return table(spark, sf, "translations").select("id", F.col(column).alias("text"))


def segments_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "translations").select("id", F.col("source_text").alias("source"), F.col("translated_text").alias("target"), "source_lang", "target_lang")


def rules_of(spark: SparkSession, sf: str) -> DataFrame:
    g = heads(spark, sf).where("length(ru) > 0 AND length(en) > 0")
    keep = F.arrays_overlap(F.coalesce("protected_tokens", F.array().cast("array<string>")), F.array("ru"))
    return g.select(F.col("entry_id").alias("rule_id"), F.lit("ru").alias("source_lang"), F.lit("en").alias("target_lang"), F.col("ru").alias("src"), F.col("en").alias("tgt"), keep.alias("do_not_translate"), (F.col("category") == "unit").alias("enforce_case"), F.lit(None).cast("array<string>").alias("aliases"))


def _occurrences(lang: str) -> str:
    return rf"SELECT g.entry_id AS term_id, count(*) AS texts FROM (SELECT id, {PAD('source_text')} AS w FROM translations) t, (SELECT entry_id, {PAD(lang)} AS w FROM {HEADS} WHERE length({lang}) > 0) g WHERE contains(t.w, g.w) GROUP BY g.entry_id"


@query("q_glossary_hits", " UNION ALL ".join(f"SELECT '{x}' AS lang, * FROM ({_occurrences(x)})" for x in ("ru", "en", "fr")))
def g01(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in which each glossary term of any language and length occurs as whole words."""
    each = [terms_of(spark, sf, lang).select(F.struct(F.lit(lang).alias("lang"), "term_id").alias("term_id"), "term") for lang in ("ru", "en", "fr")]
    d = T.texts_with_terms(texts_of(spark, sf), each[0].union(each[1]).union(each[2]))
    return d.select("term_id.lang", F.col("term_id")["term_id"].alias("term_id"), "texts")


@query("q_segment_terms", f"SELECT id, count(*) AS terms, CAST(sum(length(ru)) AS BIGINT) AS chars, round(sum(length(ru)) * 1.0 / any_value(n), 6) AS coverage FROM (SELECT DISTINCT t.id, g.entry_id, g.ru, length(t.source_text) AS n FROM {TR} t, {GL} g WHERE length(g.ru) > 0 AND {HIT}) GROUP BY id")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    """Matched terms of each segment and the share of its characters that they make up."""
    t = terms_of(spark, sf, "ru").withColumn("form", T.form_of(F.col("term"))).where("form IS NOT NULL").distinct()
    per = t.groupBy("form").agg(F.count("*").alias("terms"), F.sum(F.length("term")).alias("chars"))
    d = T.held_forms(texts_of(spark, sf).withColumn("n", F.length("text")), "text", t).select("id", "n", "form").distinct().join(per, "form")
    return d.groupBy("id").agg(F.sum("terms").alias("terms"), F.sum("chars").alias("chars"), F.round(F.sum("chars") / F.any_value("n"), 6).alias("coverage"))


@query("q_longest_terms")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of terms of all three languages, overlapping ones removed from the left, the longest first."""
    every = terms_of(spark, sf, "ru").union(terms_of(spark, sf, "en")).union(terms_of(spark, sf, "fr"))
    # Of the terms at one place the smallest id is kept, as the fold would.
    first = every.groupBy(T.form_of(F.col("term")).alias("form")).agg(F.min(F.struct("term_id")).alias("t")).where("form IS NOT NULL").select("form", "t.term_id")
    hits = T.form_hits(texts_of(spark, sf), first.select("form")).join(first, "form").select("id", "pos", (F.col("pos") + F.col("n_words")).alias("end"), "term_id")
    return T.drop_overlaps(hits, ["id"], "pos", "end").select("id", "pos", "term_id")


@query("q_term_statistics", f"SELECT g.category, count(*) AS occurrences, count(DISTINCT g.term_key) AS keys FROM {TR} t, {GL} g WHERE length(g.ru) > 0 AND {HIT} GROUP BY g.category")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    hits = T.term_hits(texts_of(spark, sf), terms_of(spark, sf, "ru")).select("id", F.col("term_id").alias("entry_id")).distinct()
    return hits.join(heads(spark, sf), "entry_id").groupBy("category").agg(F.count("*").alias("occurrences"), F.count_distinct("term_key").alias("keys"))


VIOLATIONS = f"""SELECT id, rule_id, CASE WHEN dnt THEN CASE WHEN NOT contains(tgt_text, src) THEN 'do_not_translate_broken' END WHEN NOT has THEN 'term_missing' WHEN category = 'unit' AND NOT contains(tgt_text, tgt) THEN 'case_mismatch' END AS type, CASE WHEN dnt THEN src ELSE tgt END AS suggestion
FROM (SELECT t.id, g.entry_id AS rule_id, g.category, g.ru AS src, g.en AS tgt, coalesce(list_contains(g.protected_tokens, g.ru), false) AS dnt, coalesce(t.translated_text, '') AS tgt_text, {CONTAINS.format("coalesce(t.translated_text, '')", "g.en")} AS has
FROM {TR} t, {GL} g WHERE length(g.ru) > 0 AND {RU_EN} AND length(g.ru) > 0 AND length(g.en) > 2 AND {HIT})"""


@query("q_term_violations", f"SELECT * FROM ({VIOLATIONS}) WHERE type IS NOT NULL")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that a segment breaks, source terms met by equal words."""
    return T.violations(segments_of(spark, sf), rules_of(spark, sf), fuzzy=False)


@query("q_term_violations_fuzzy")
def v01_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """The same with similar words (F15, G08): matching blocks can't be said in SQL."""
    return T.violations(segments_of(spark, sf), rules_of(spark, sf))


@query("q_term_enforcement")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    return T.enforced(segments_of(spark, sf), rules_of(spark, sf)).select("id", F.md5("target").alias("h"))


@query("q_force_case", "SELECT entry_id, regexp_replace(description, '(?i)' || regexp_escape('yarn'), 'YARN', 'g') AS forced FROM glossary WHERE description IS NOT NULL")
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "glossary").where("description IS NOT NULL").select("entry_id", T.force_case(F.col("description"), F.lit("YARN")).alias("forced"))


SELECTED = "CASE WHEN lower(en) = '{0}' THEN 3 WHEN starts_with(lower(en), '{0}') OR starts_with('{0}', lower(en)) THEN 2 WHEN contains(lower(en), '{0}') AND length('{0}') >= 4 THEN 1 ELSE 0 END"


@query("q_selected_terms", f"SELECT entry_id, en AS source, score FROM (SELECT entry_id, en, greatest({SELECTED.format('needle')}, {SELECTED.format('yarn')}, {SELECTED.format('fine')}) AS score FROM glossary WHERE length(en) > 0) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY en ORDER BY score DESC, entry_id) = 1 ORDER BY score DESC, entry_id LIMIT 50")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    return T.selected_terms(table(spark, sf, "glossary").select("entry_id", F.col("en").alias("source")), ["needle", "yarn", "Fine"], 50)


@query("q_term_verification", f"SELECT id, count(*) AS terms, count(*) FILTER (WHERE ok) AS verified, round(count(*) FILTER (WHERE ok) * 1.0 / count(*), 6) AS quality FROM (SELECT DISTINCT t.id, g.entry_id, contains(lower(coalesce(t.translated_text, '')), lower(g.en)) AS ok FROM {TR} t, {GL} g WHERE length(g.ru) > 0 AND {RU_EN} AND length(g.en) > 0 AND {HIT}) GROUP BY id")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the source's terms whose translation the answer contains."""
    s = segments_of(spark, sf).where("source_lang = 'ru' AND target_lang = 'en'")
    g = heads(spark, sf).where("length(en) > 0").select(F.col("entry_id").alias("term_id"), F.col("ru").alias("term"), "en")
    hits = T.term_hits(s.select("id", F.col("source").alias("text")), g.select("term_id", "term")).select("id", "term_id").distinct()
    d = hits.join(g, "term_id").join(s.select("id", F.lower(F.coalesce("target", F.lit(""))).alias("low")), "id").withColumn("ok", F.contains("low", F.lower("en")))
    return d.groupBy("id").agg(F.count("*").alias("terms"), F.count_if("ok").alias("verified"), F.round(F.count_if("ok") / F.count("*"), 6).alias("quality"))


GATE = """SELECT id, ratio, longest, CASE WHEN ratio < 0.5 OR ratio > 2.0 THEN 1 ELSE 0 END + CASE WHEN longest > 50 THEN 1 ELSE 0 END AS findings FROM (SELECT id, CASE WHEN least(length(s), length(t)) > 15 THEN round((length(t) + 1) * 1.0 / (length(s) + 1), 6) END AS ratio, coalesce(list_max(list_transform(regexp_extract_all(t, '[^\\s]+'), lambda x: length(x))), 0) AS longest
FROM (SELECT id, regexp_replace(coalesce(source_text, ''), '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(coalesce(translated_text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM translations))"""


@query("q_gate_figures", GATE.replace("\\\\", "\\"))
def v05(spark: SparkSession, sf: str) -> DataFrame:
    return V.gate_figures(segments_of(spark, sf), 0.5, 2.0, 50).select("id", F.round("ratio", 6).alias("ratio"), "longest", "findings")


@query("q_gate_pass_rate", f"SELECT source_lang, target_lang, count(*) AS segments, round(avg(CASE WHEN findings = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM translations JOIN ({GATE}) USING (id) GROUP BY ALL".replace("\\\\", "\\"))
def a35(spark: SparkSession, sf: str) -> DataFrame:
    s = segments_of(spark, sf)
    d = V.gate_figures(s, 0.5, 2.0, 50).select("id", "findings").join(s.select("id", "source_lang", "target_lang"), "id")
    return d.groupBy("source_lang", "target_lang").agg(F.count("*").alias("segments"), F.round(F.avg(F.when(F.col("findings") == 0, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


ISSUES = """SELECT id, 'empty_translation' AS issue, 'critical' AS severity FROM translations WHERE regexp_replace(coalesce(translated_text, ''), '\\s+', '', 'g') = ''
UNION ALL SELECT id, 'format_mismatch', 'warning' FROM translations WHERE length(coalesce(source_text, '')) - length(replace(coalesce(source_text, ''), chr(10), '')) <> length(coalesce(translated_text, '')) - length(replace(coalesce(translated_text, ''), chr(10), ''))
UNION ALL SELECT DISTINCT t.id, 'missing_protected_token:' || p.token, 'warning' FROM translations t, (SELECT DISTINCT unnest(protected_tokens) AS token FROM glossary) p WHERE contains(t.source_text, p.token) AND NOT contains(coalesce(t.translated_text, ''), p.token)
UNION ALL SELECT id, 'missing_placeholder', 'critical' FROM translations WHERE len(list_filter(regexp_extract_all(coalesce(source_text, ''), '\\d+'), lambda x: NOT list_contains(regexp_extract_all(coalesce(translated_text, ''), '\\d+'), x))) > 0
UNION ALL SELECT id, 'extra_placeholder', 'critical' FROM translations WHERE len(list_filter(regexp_extract_all(coalesce(translated_text, ''), '\\d+'), lambda x: NOT list_contains(regexp_extract_all(coalesce(source_text, ''), '\\d+'), x))) > 0"""


@query("q_verification_issues", ISSUES)
def v06(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of each segment: emptiness, line breaks, protected tokens, and the numbers that placeholders stand for."""
    return V.issues(segments_of(spark, sf), table(spark, sf, "glossary"))


@query("q_quality_scores", f"SELECT t.id, CAST(round(greatest(0, 1 - coalesce(sum(CASE severity WHEN 'critical' THEN 0.3 WHEN 'warning' THEN 0.1 WHEN 'info' THEN 0.05 END), 0)), 6) AS DOUBLE) AS quality, count(severity) AS issues, count(*) FILTER (WHERE severity = 'critical') = 0 AND round(greatest(0, 1 - coalesce(sum(CASE severity WHEN 'critical' THEN 0.3 WHEN 'warning' THEN 0.1 END), 0)), 6) >= 0.7 AS passed FROM translations t LEFT JOIN ({ISSUES}) i ON i.id = t.id GROUP BY t.id")
def v10(spark: SparkSession, sf: str) -> DataFrame:
    s = segments_of(spark, sf)
    return V.quality(s, V.issues(s, table(spark, sf, "glossary")), 0.7)


@query("q_verification_report", f"SELECT issue, severity, count(*) AS n, count(DISTINCT id) AS segments FROM (SELECT id, split_part(issue, ':', 1) AS issue, severity FROM ({ISSUES})) GROUP BY ALL")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    i = V.issues(segments_of(spark, sf), table(spark, sf, "glossary"))
    return i.groupBy(F.split_part("issue", F.lit(":"), F.lit(1)).alias("issue"), "severity").agg(F.count("*").alias("n"), F.count_distinct("id").alias("segments"))


@query("q_protected_missing", "SELECT DISTINCT t.id, p.token FROM translations t, (SELECT DISTINCT unnest(protected_tokens) AS token FROM glossary) p WHERE contains(t.source_text, p.token) AND NOT contains(coalesce(t.translated_text, ''), p.token)")
def v09(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_tokens(segments_of(spark, sf), table(spark, sf, "glossary").select(F.explode("protected_tokens").alias("token")))


@query("q_placeholder_counts", r"SELECT id, len(regexp_extract_all(source_text, '\[\[[a-z0-9_-]+\]\]|https?://[^\s<>]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}|[0-9][0-9,.]*')) AS tokens FROM translations WHERE source_text IS NOT NULL")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    d = S.encoded(table(spark, sf, "translations").where("source_text IS NOT NULL"), "source_text")
    return d.select("id", F.size("mapping").cast("bigint").alias("tokens"))


@query("q_placeholder_round_trip", "SELECT id, md5(source_text) AS h FROM translations WHERE source_text IS NOT NULL")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    d = S.encoded(table(spark, sf, "translations").where("source_text IS NOT NULL"), "source_text")
    return d.select("id", F.md5(S.decoded(F.col("encoded"), F.col("mapping"))).alias("h"))


@query("q_canonical_forms", r"SELECT count(DISTINCT lower(regexp_replace(regexp_replace(nfc_normalize(fr), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS forms FROM glossary WHERE regexp_full_match(fr, '[ -~\x{00C0}-\x{024F}]*')")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "glossary").where(F.col("fr").rlike(r"^[ -~À-ɏ]*$"))
    return g.agg(F.count_distinct(F.lower(S.canonical("fr"))).alias("forms"))
