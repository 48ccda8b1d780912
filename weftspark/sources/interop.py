"""Exchange formats: translation units, terminology, nested JSON documents, metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "slug string, metadata struct<title:string,author:string,version:string,language:string,created_date:string>, sections array<struct<section_type:string,title:string,blocks:array<struct<block_id:string,block_type:string,content:string,page_number:int,reading_order:int,doc_ref:string>>>>"
TU = "tuv array<struct<`_xml:lang`:string,seg:string>>"
TERM = "langSet array<struct<`_xml:lang`:string,tig:array<struct<term:string>>>>"


def write_units(df: DataFrame, path: str) -> None:
    """Units (source_lang, target_lang, source_text, translated_text) as <tu> elements; incomplete ones are left out."""
    ok = df.where("source_lang IS NOT NULL AND target_lang IS NOT NULL AND source_text IS NOT NULL AND translated_text IS NOT NULL")
    tuv = lambda lang, text: F.struct(F.col(lang).alias("_xml:lang"), F.col(text).alias("seg"))
    ok.select(F.array(tuv("source_lang", "source_text"), tuv("target_lang", "translated_text")).alias("tuv")).write.mode("overwrite").format("xml").option("validateName", "false").option("rootTag", "body").option("rowTag", "tu").save(path)


def read_units(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(source_text, translated_text) of the units that have a variant of both languages (by prefix); stripped, the last variant wins."""
    d = spark.read.schema(TU).format("xml").option("rowTag", "tu").load(path)
    pick = lambda p: F.element_at(F.filter("tuv", lambda v: F.startswith(F.lower(v["_xml:lang"]), F.lit(p.lower()))), -1)
    both = d.where(F.exists("tuv", lambda v: F.startswith(F.lower(v["_xml:lang"]), F.lit(source.lower()))) & F.exists("tuv", lambda v: F.startswith(F.lower(v["_xml:lang"]), F.lit(target.lower()))))
    return both.select(F.regexp_replace(pick(source)["seg"], r"^\s+|\s+$", "").alias("source_text"), F.regexp_replace(pick(target)["seg"], r"^\s+|\s+$", "").alias("translated_text"))


def write_terms(df: DataFrame, path: str, source: str, target: str) -> None:
    """Glossary rows with both languages as <termEntry> elements."""
    lang = lambda c: F.struct(F.lit(c).alias("_xml:lang"), F.array(F.struct(F.col(c).alias("term"))).alias("tig"))
    df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.array(lang(source), lang(target)).alias("langSet")).write.mode("overwrite").format("xml").option("validateName", "false").option("rootTag", "body").option("rowTag", "termEntry").save(path)


def read_terms(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(source_term, target_term): every source term of an entry with every target term; exact language codes."""
    d = spark.read.schema(TERM).format("xml").option("rowTag", "termEntry").load(path)
    terms = lambda c: F.flatten(F.transform(F.filter("langSet", lambda x: x["_xml:lang"] == c), lambda x: F.transform(x["tig"], lambda t: t["term"])))
    return d.select(F.explode(terms(source)).alias("source_term"), terms(target).alias("t")).select("source_term", F.explode("t").alias("target_term")).distinct()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Block rows of nested JSON documents, in document order; missing optional keys are null."""
    d = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    s = d.select("slug", F.col("metadata.language").alias("language"), F.posexplode_outer("sections").alias("section_ord", "s"))
    return s.select("slug", "language", "section_ord", F.col("s.section_type").alias("section_type"), F.col("s.title").alias("section_title"), F.posexplode_outer("s.blocks").alias("block_ord", "b")).select("slug", "language", "section_ord", "section_type", "section_title", "block_ord", "b.*")


def write_documents(blocks: DataFrame, path: str) -> None:
    """The inverse of ``read_documents``: one JSON document a line."""
    b = blocks.groupBy("slug", "language", "section_ord", "section_type", "section_title").agg(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "block_type", "content", "page_number", "reading_order", "doc_ref"))).alias("blocks"))
    s = b.groupBy("slug", "language").agg(F.array_sort(F.collect_list(F.struct("section_ord", "section_type", F.col("section_title").alias("title"), "blocks"))).alias("sections"))
    s.select("slug", F.struct("language").alias("metadata"), "sections").write.mode("overwrite").json(path)


def metrics_text(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Exposition-format lines of a labelled measure."""
    lab = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), lab, F.lit("} "), F.col(value).cast("string")).alias("line"))
