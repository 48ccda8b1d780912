"""Oversized texts cut at natural boundaries, and stored pieces that break the rules (problem 5).

Texts are worked on by ranges: a range of characters with halos on both sides goes to
a worker, which finds the boundaries that fall inside its range (paragraph ends, sentence ends, blanks). The
boundary tables are stitched by prefix sums over the ranges' lengths; pieces are packed
from boundary offsets alone, which stream by range after range, and only then cut out of the ranges that they touch.
``split_files`` gives the pieces of files from byte ranges: the list of ranges is made from the files' sizes by the executors, each
worker reads its bytes and the halos, and none holds a whole file. ``split`` takes texts that fit a row.

Stored chunks are located in their text without searching: blanks left aside, a chunk ends
where the lengths of all chunks up to it add up to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.plans.tables import new_path, stored, table

RANGE = 65_536  # characters of a range
HALO = 4_096  # characters seen on either side; larger limits widen it
BLANKS = r"[\s\x1c-\x1f\x85   -     　]"
GAP = re.compile(BLANKS + "+")
STOP = re.compile(rf"[.!?…]+(?={BLANKS}+(\w))")
# Shortened words after which a point ends nothing, whatever follows.
SHORT = re.compile(r"(?:^|[\s(])(?:z\. ?B|d\. ?h|bzw|vgl|inkl|e\.g|i\.e|p\. ?ex|т\. ?е|т\. ?д|см\. рис|Nr|No|Dr|St)$")


def boundaries(text: str, whole: bool = True) -> list[tuple[int, str]]:
    """(end, kind) of each sentence and paragraph, ends without the blanks that follow, in order.

    A sentence ends with . ! ? or … when a capital follows after blanks, and where its paragraph ends; of one
    place only the stronger kind is named. The end of the text is a paragraph end if ``whole``.
    """
    found: dict[int, str] = {}
    for m in STOP.finditer(text):
        if m.group(1).isupper() and not SHORT.search(text[max(0, m.start() - 12) : m.start()]):
            found[m.end()] = "sentence"
    for m in re.finditer(rf"{BLANKS}*\n[^\S\n]*\n{BLANKS}*", text):
        if m.start():
            found[m.start()] = "paragraph"
    if whole and text.strip():
        found[len(text.rstrip())] = "paragraph"
    return sorted(found.items())


def ink(text: str) -> int:
    return len(GAP.sub("", text))


RANGES = "r int, left string, body string, right string, last boolean, chars int, inks int"


def text_ranges(df: DataFrame, id_col: str, text_col: str, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """(source, r, left, body, right, last, chars, inks): each text by ranges, the halos apart; a text of one range stays in the JVM."""
    d = df.select(F.col(id_col).alias("source"), F.col(text_col).alias("t")).where("source IS NOT NULL AND t IS NOT NULL AND length(t) > 0")
    none = F.lit("")
    one = d.where(F.length("t") <= size).select("source", F.lit(0).alias("r"), none.alias("left"), F.col("t").alias("body"), none.alias("right"), F.lit(True).alias("last"), F.length("t").alias("chars"), F.length(F.regexp_replace("t", BLANKS, "")).alias("inks"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, t in zip(pdf["source"], pdf["t"]):
                for r, at in enumerate(range(0, len(t), size)):
                    body = t[at : at + size]
                    yield pd.DataFrame([(source, r, t[max(0, at - halo) : at], body, t[at + size : at + size + halo], at + size >= len(t), len(body), ink(body))], columns=["source", *_names(RANGES)])

    many = d.where(F.length("t") > size).mapInPandas(cut, f"source {d.schema['source'].dataType.simpleString()}, {RANGES}")
    return one.union(many)


def _names(fields: str) -> list[str]:
    return [x.split()[0] for x in fields.split(", ")]


def file_ranges(spark: SparkSession, paths: list[str], size: int = RANGE * 4, halo: int = HALO * 4) -> DataFrame:
    """The same columns for UTF-8 files or folders of them; paths are of any file system that the executors reach.

    Sizes are listed by the binary file source without reading contents; a worker reads only its bytes and the halos. Empty
    files have no range. ``size`` and ``halo`` are in bytes, the other figures in characters.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("p"), F.col("length").alias("n")).where("n > 0")
    jobs = files.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)))
    schema = f"source string, {RANGES}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        def edge(b: bytes, i: int) -> int:
            while 0 < i < len(b) and b[i] & 0xC0 == 0x80:
                i += 1
            return i

        for pdf in batches:
            for p, n, i in pdf.itertuples(index=False):
                fs, name = FileSystem.from_uri(p)
                start = max(0, i * size - halo)
                with fs.open_input_file(name) as f:
                    b = f.read_at(min(n, (i + 1) * size + halo) - start, start)
                lo, hi = edge(b, i * size - start), edge(b, min((i + 1) * size, n) - start)
                first = edge(b, 1) if start and b[0] & 0xC0 == 0x80 else 0
                body = b[lo:hi].decode("utf-8", "replace")
                yield pd.DataFrame([(p, i, b[first:lo].decode("utf-8", "replace"), body, b[hi:].decode("utf-8", "ignore"), (i + 1) * size >= n, len(body), ink(body))], columns=["source", *_names(RANGES)])

    return jobs.repartition("p", "i").mapInPandas(read, schema)


def placed(ranges: DataFrame) -> DataFrame:
    """Ranges with char_at and ink_at: where they begin in their text, by prefix sums of the lengths."""
    lengths = ranges.select("source", "r", "chars", "inks")
    w = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    at = lengths.select("source", "r", F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("char_at"), F.coalesce(F.sum("inks").over(w), F.lit(0)).alias("ink_at"))
    return ranges.join(at, ["source", "r"])


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for x in pdf.itertuples(index=False):
            text, n = x.left + x.body + x.right, len(x.left)
            ends = boundaries(text, whole=x.last)
            blank = {m.start(): "blank" for m in GAP.finditer(text)} | dict(ends)
            out += [(x.source, x.char_at + e - n, k) for e, k in blank.items() if n < e <= n + len(x.body)]
        yield pd.DataFrame(out, columns=["source", "at", "kind"])


def boundary_table(ranges: DataFrame) -> DataFrame:
    """(source, at, kind): all boundaries by offset, of kinds paragraph, sentence and blank; stitched over the ranges."""
    cols = ["source", "left", "body", "right", "last", "char_at"]
    return placed(ranges).select(*cols).mapInPandas(_find, f"source {ranges.schema['source'].dataType.simpleString()}, at bigint, kind string").distinct()


RANK = {"paragraph": 3, "sentence": 2, "blank": 1}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each range's boundaries as two arrays: offsets in the text, and ranks of their kinds."""
    for pdf in batches:
        for x in pdf.itertuples(index=False):
            text, n = x.left + x.body + x.right, len(x.left)
            found = {m.start(): 1 for m in GAP.finditer(text)} | {e: RANK[k] for e, k in boundaries(text, whole=x.last)}
            at = np.array(sorted(e for e in found if n < e <= n + len(x.body)), "i8")
            kinds = np.array([found[e] for e in at.tolist()], "i1")
            yield pd.DataFrame([(x.source, x.r, x.char_at + x.chars, x.total, x.limit, (at + x.char_at - n).tobytes(), kinds.tobytes())], columns=["source", "r", "until", "total", "limit", "at", "kinds"])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy pieces (number, begin, end) of each source; its ranges come in order and only those at hand are held."""
    source, begin, piece = None, 0, 0
    where, kinds = np.empty(0, "i8"), np.empty(0, "i1")
    for pdf in batches:
        out = []
        for x in pdf.itertuples(index=False):
            if x.source != source:
                source, begin, piece, where, kinds = x.source, 0, 0, np.empty(0, "i8"), np.empty(0, "i1")
            where, kinds = np.concatenate([where, np.frombuffer(x.at, "i8")]), np.concatenate([kinds, np.frombuffer(x.kinds, "i1")])
            while begin < x.total and x.until >= min(x.total, begin + x.limit):
                end = x.total
                if x.total - begin > x.limit:
                    lo, hi = np.searchsorted(where, [begin, begin + x.limit], side="right")
                    end = begin + x.limit
                    for rank in (3, 2, 1):
                        # A paragraph end is taken only if it fills half the limit; else a sentence end fills more.
                        fit = np.flatnonzero(kinds[lo:hi] >= rank)
                        if len(fit) and (rank < 3 or where[lo + fit[-1]] - begin >= x.limit // 2):
                            end = int(where[lo + fit[-1]])
                            break
                out.append((source, piece, begin, end))
                begin, piece = end, piece + 1
            keep = np.searchsorted(where, begin, side="right")
            where, kinds = where[keep:], kinds[keep:]
        yield pd.DataFrame(out, columns=["source", "piece", "begin", "end"])


def split(df: DataFrame, id_col: str, text_col: str, limit_col: str, overlap_col: str, size: int = RANGE) -> DataFrame:
    """(source, piece, begin, text, overlap_with_prev, overlap_with_next, prefix_context, suffix_context).

    Pieces of at most ``limit`` characters, blanks at their ends removed, cut at paragraph ends, else
    sentence ends, else blanks, else hard at the limit; prefix and suffix contexts are the end of the piece before and
    the beginning of the piece after, at most ``overlap`` characters, from a word's edge where there is one. Null
    ids or texts, blank texts, and limits that are null or below 1 give no piece; an overlap that is null counts as 0.
    """
    given = df.select(F.col(id_col).alias("source"), F.col(limit_col).cast("int").alias("limit"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)).alias("overlap"), F.col(text_col).alias("t")).where("limit >= 1").dropDuplicates(["source"])
    return split_ranges(stored(text_ranges(given, "source", "t", size), "ranges"), given.select("source", "limit", "overlap"))


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, size: int = RANGE * 4, halo: int = HALO * 4) -> DataFrame:
    """The pieces, as ``split`` gives them, of UTF-8 files or folders; ``source`` is a file's URI, and no file is read whole."""
    if limit < 1:
        raise ValueError("limit below 1")
    ranges = stored(file_ranges(spark, list(dict.fromkeys(paths)), size, halo), "ranges")
    return split_ranges(ranges, ranges.where("r = 0").select("source", F.lit(limit).alias("limit"), F.lit(overlap).alias("overlap")))


def split_ranges(ranges: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of texts given by ranges only (as ``text_ranges`` and ``file_ranges`` give them); ``limits``: source, limit, overlap."""
    key = ranges.schema["source"].dataType.simpleString()
    sizes = limits.join(ranges.groupBy("source").agg(F.sum("chars").alias("total")), "source")
    cuts = placed(ranges).join(sizes, "source").select("source", "r", "left", "body", "right", "last", "char_at", "chars", "total", "limit")
    cuts = cuts.mapInPandas(_packed, f"source {key}, r int, until bigint, total bigint, limit int, at binary, kinds binary")
    pieces = stored(cuts.repartition("source").sortWithinPartitions("source", "r").mapInPandas(_pack, f"source {key}, piece int, begin bigint, end bigint"), "pieces")
    at = placed(ranges).select("source", "char_at", "chars", "body")
    parts = pieces.join(at, "source").where("char_at < end AND char_at + chars > begin")
    lo, hi = F.greatest(F.col("begin") - F.col("char_at"), F.lit(0)), F.least(F.col("end") - F.col("char_at"), F.col("chars").cast("bigint"))
    parts = parts.select("source", "piece", "begin", F.struct("char_at", F.substring("body", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s")).alias("p"))
    texts = parts.groupBy("source", "piece", "begin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "").alias("text"))
    texts = texts.withColumn("text", F.regexp_replace("text", f"^{BLANKS}+|{BLANKS}+$", "")).where("text <> ''").join(sizes.select("source", "overlap"), "source")
    w = Window.partitionBy("source").orderBy("piece")
    edge = lambda t, head: F.when(F.col("overlap") <= 0, F.lit("")).when(F.length(t) <= F.col("overlap"), t).otherwise(F.regexp_replace(F.substring(t, F.lit(1), F.col("overlap")) if head else F.substring(t, F.length(t) - F.col("overlap") + 1, F.col("overlap")), rf"(?s){BLANKS}\S*$" if head else rf"(?s)^\S*{BLANKS}+", ""))
    texts = texts.withColumn("prefix_context", F.coalesce(edge(F.lag("text").over(w), False), F.lit(""))).withColumn("suffix_context", F.coalesce(edge(F.lead("text").over(w), True), F.lit("")))
    return texts.select("source", (F.row_number().over(w) - 1).alias("piece"), "begin", "text", F.length("prefix_context").alias("overlap_with_prev"), F.length("suffix_context").alias("overlap_with_next"), "prefix_context", "suffix_context")


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for x in pdf.itertuples(index=False):
            text, n = x.left + x.body + x.right, len(x.left)
            ends = [e for e, _ in boundaries(text, whole=x.last)]
            known, marks = set(ends), [n + m.start() for m in re.finditer(rf"(?!{BLANKS})[\s\S]", x.body)]
            for chunk, at, limit in zip(x.chunks, x.ats, x.limits):
                k = at - x.ink_at
                e = marks[k - 1] + 1
                if e in known:
                    continue
                inside = e < len(text) and text[e - 1].isalnum() and text[e].isalnum()
                lo, hi = max([b for b in ends if b < e], default=None if x.left and x.r else 0), min([b for b in ends if b > e], default=None)
                fits = lo is not None and hi is not None and len(text[lo:hi].strip()) <= limit
                if inside or fits:
                    out.append((x.source, chunk))
        yield pd.DataFrame(out, columns=["source", "chunk"])


def chunk_faults(chunks: DataFrame, sections: DataFrame, presets: DataFrame) -> DataFrame:
    """(source_id, chunk_id, defect): stored chunks that are too long, badly cut or lack the overlap.

    Chunks delivered twice count once (equal source and number; of differing ones the first by text). Chunks of
    unknown sections or presets, and null keys, are no case; null texts count as empty, null contexts as missing.
    """
    p = presets.select("preset", F.col("max_chars").cast("int").alias("limit"), F.col("overlap_chars").cast("int").alias("overlap")).dropDuplicates(["preset"])
    s = sections.select(F.col("source_id").alias("source"), "preset", "content").dropDuplicates(["source"]).join(F.broadcast(p) if p.count() < 10_000 else p, "preset")
    c = chunks.select(F.col("source_id").alias("source"), F.col("chunk_id").cast("bigint").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"), "prefix_context", "suffix_context", "overlap_with_prev", "overlap_with_next").where("source IS NOT NULL AND chunk IS NOT NULL")
    c = c.join(s.select("source", "limit", "overlap"), "source")
    # One row of each number; then neighbours and prefix sums of the lengths without blanks.
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("text", "prefix_context", "suffix_context"))).where("nth = 1")
    w = Window.partitionBy("source").orderBy("chunk")
    c = c.withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w)).withColumn("at", F.sum(F.length(F.regexp_replace("text", BLANKS, ""))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = stored(c.withColumn("ends", F.col("after").isNull()), "chunks")
    good = lambda ctx, n, whole: F.coalesce((F.length(ctx) > 0) & (F.length(ctx) <= F.col("overlap")) & (F.col(n) == F.length(ctx)) & whole, F.lit(False))
    prefix = F.col("before").isNull() | good("prefix_context", "overlap_with_prev", F.endswith("before", "prefix_context"))
    suffix = F.col("after").isNull() | good("suffix_context", "overlap_with_next", F.startswith("after", "suffix_context"))
    long_ = c.where("length(text) > limit").select("source", "chunk", F.lit("too_long").alias("defect"))
    overlap = c.where(~(prefix & suffix)).select("source", "chunk", F.lit("overlap").alias("defect"))
    most = p.agg(F.max("limit")).first()[0] or 1
    ranges = placed(stored(text_ranges(s, "source", "content", halo=max(HALO, 2 * most)), "ranges"))
    ends = c.where("NOT ends").select("source", F.col("chunk"), "at", "limit").join(ranges.select("source", "r", "ink_at", "inks"), "source").where("at > ink_at AND at <= ink_at + inks")
    per = ends.groupBy("source", "r").agg(F.collect_list(F.struct("chunk", "at", "limit")).alias("e")).select("source", "r", F.col("e.chunk").alias("chunks"), F.col("e.at").alias("ats"), F.col("e.limit").alias("limits"))
    kind = c.schema["source"].dataType.simpleString()
    bad = ranges.join(per, ["source", "r"]).select("source", "r", "left", "body", "right", "last", "ink_at", "chunks", "ats", "limits").mapInPandas(_verdicts, f"source {kind}, chunk bigint").select("source", "chunk", F.lit("bad_cut").alias("defect"))
    return long_.union(overlap).union(bad).select(F.col("source").alias("source_id"), F.col("chunk").alias("chunk_id"), "defect").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_faults(*(table(spark, sf_dir, t) for t in ("chunks", "raw_sections", "chunk_presets")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "raw_sections").join(table(spark, sf_dir, "chunk_presets"), "preset")
    return split(s, "source_id", "content", "max_chars", "overlap_chars")


def p5_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each preset written to one long file, and the files cut from byte ranges; ``source`` is the preset."""
    s = table(spark, sf_dir, "raw_sections").where("preset IS NOT NULL AND content IS NOT NULL")
    out, path = None, new_path(spark, "long_files")
    s.select("preset", F.concat(F.regexp_replace("content", r"\r", ""), F.lit("\n")).alias("value"), "section_id").repartition("preset").sortWithinPartitions("preset", "section_id").select("preset", "value").write.partitionBy("preset").text(path)
    for r in table(spark, sf_dir, "chunk_presets").orderBy("preset").collect():  # a handful of presets
        d = split_files(spark, [f"{path}/preset={r['preset']}"], r["max_chars"], r["overlap_chars"])
        d = d.withColumn("source", F.lit(r["preset"]))
        out = d if out is None else out.union(d)
    return out
