"""Files in and out: asset ledgers, memories, glossaries, commented JSON, text folders, reports, pages of markup, and a folder's new contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSET = "asset_id string, asset_type string, sha256 string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, ctm array<double>, occurrence int, anchor_to string, colorspace string, fonts array<struct<font_name:string,font_type:string,embedded:boolean,subset:boolean>>"
LEDGER = f"source_pdf string, total_pages int, assets array<struct<{', '.join(f'{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}' for x in ASSET.split(', '))}>>"
MEMORY = "entries array<struct<source_text:string,translated_text:string,source_lang:string,target_lang:string,usage_count:bigint,quality_score:double>>"


def write_ledgers(assets: DataFrame, path: str) -> None:
    """One JSON ledger a line for each source_pdf, its assets in order of page and id; binary columns are not written. A document's assets meet in one row."""
    cols = [x.split(" ", 1)[0] for x in ASSET.split(", ")]
    g = assets.groupBy("source_pdf", "total_pages").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "asset_id", F.struct(*cols).alias("a")))), lambda x: x["a"]).alias("assets"))
    g.write.mode("overwrite").json(path)


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """Asset rows of ledgers, one document a line or a file; a missing colour space is rgb."""
    d = spark.read.schema(LEDGER).json(path)
    return d.select("source_pdf", "total_pages", F.inline("assets")).withColumn("colorspace", F.coalesce("colorspace", F.lit("rgb")))


def write_memory(rows: DataFrame, path: str, per_file: int = 10_000) -> None:
    """A memory as JSON documents of at most ``per_file`` entries each."""
    cols = ["source_text", "translated_text", "source_lang", "target_lang", "usage_count", "quality_score"]
    parts = max(1, -(-rows.count() // per_file))
    g = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(*cols).alias("e")))), lambda x: x["e"]).alias("entries"))
    g.select("entries").write.mode("overwrite").json(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """Entries by text and languages; of repeated keys the last in file order stays."""
    d = spark.read.schema(MEMORY).json(path).select("_metadata.file_path", F.posexplode("entries").alias("n", "e")).select("file_path", "n", "e.*")
    key = ["source_text", "source_lang", "target_lang"]
    return d.groupBy(*key).agg(F.max_by(F.struct("translated_text", "usage_count", "quality_score"), F.struct("file_path", "n")).alias("x")).select(*key, "x.*")


def glossary_tree(entries: DataFrame) -> DataFrame:
    """(category, json): a document for each category, key -> terms; a later entry replaces an earlier one of its key. The key is term_key, else ru, else en."""
    d = entries.withColumn("k", F.coalesce("term_key", "ru", "en")).where("k IS NOT NULL AND category IS NOT NULL")
    last = d.groupBy("category", "k").agg(F.max_by(F.struct("ru", "en", "fr"), "entry_id").alias("v"))
    return last.groupBy("category").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(category, term_key, ru, en, fr) of documents {category: {key: {ru, en, fr}}}, one a line; ``metadata`` is no category; abbreviations, terms and units lose their s."""
    d = spark.read.text(path).select(F.from_json("value", "map<string, map<string, struct<ru:string,en:string,fr:string>>>").alias("m"))
    c = d.select(F.explode("m").alias("category", "keys")).where("category <> 'metadata'").select("category", F.explode("keys").alias("term_key", "v"))
    one = F.when(F.col("category").isin("abbreviations", "terms", "units"), F.expr("substring(category, 1, length(category) - 1)")).otherwise(F.col("category"))
    return c.select(one.alias("category"), "term_key", "v.*")


def read_commented_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files whose lines may be comments (// at their beginning)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json(F.regexp_replace("value", r"(?m)^\s*//.*$", ""), schema).alias("j")).select("j.*")


def read_texts(spark: SparkSession, path: str, endings: tuple[str, ...] = ("txt", "md"), recursive: bool = True) -> DataFrame:
    """(path, title, content) of text files; the title is the name without its ending; empty files are left out."""
    r = spark.read.option("pathGlobFilter", "*.{" + ",".join(endings) + "}").option("recursiveFileLookup", str(recursive).lower())
    d = r.text(path, wholetext=True).select("_metadata.file_path", "_metadata.file_name", F.col("value").alias("content"))
    return d.where(F.regexp_replace("content", r"\s+", "") != "").select(F.col("file_path").alias("path"), F.regexp_replace("file_name", r"\.[^.]+$", "").alias("title"), "content")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files of any kind."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unseen(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose content no state row names, one for each content (the first path)."""
    new = files.join(state.select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("path").alias("path"))


def envelope(rows: DataFrame, version: str, by: str, order: str) -> DataFrame:
    """(by, json): batches as documents {schema_version, count, metadata}; a batch's rows meet in one."""
    cols = [c for c in rows.columns if c != by]
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("row")))).alias("r"))
    return g.select(by, F.to_json(F.struct(F.lit(version).alias("schema_version"), F.size("r").alias("count"), F.transform("r", lambda x: x["row"]).alias("metadata"))).alias("json"))


def open_envelopes(batches: DataFrame, version: str, schema: str) -> DataFrame:
    """The rows of such documents; another version raises."""
    j = batches.select(F.from_json("json", f"schema_version string, count int, metadata array<struct<{schema}>>").alias("j"))
    return j.select(F.when(F.col("j.schema_version") == version, F.col("j.metadata")).otherwise(F.raise_error(F.lit("another schema version"))).alias("m")).select(F.inline("m"))


def markup(kind: Column, text: Column) -> Column:
    """A block as an element: headings h2, list items li, tables pre, all else p; &, < and > escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(kind == "heading", "h2").when(kind == "list", "li").when(kind == "table", "pre").otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))


def pages(blocks: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """(by, text): a document's lines in order, an empty line between them."""
    g = blocks.select(by, order, line.alias("line")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"))
    return g.select(by, F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
