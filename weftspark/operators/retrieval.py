"""Scores and rankings: full text, vectors and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FEW = 4_000_000  # queries times neighbours up to which the queries are broadcast (their number is counted); beyond, blocks meet
BLOCK = 8_192  # rows of one block


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _is(word: str):
    return lambda x: x == F.lit(word)


def fulltext(docs: DataFrame, id_col: str, text_col: str, words: list[str], limit: int = 200) -> DataFrame:
    """(id, score): the best documents that hold all words, by the words' shares of the text, each weighed by how rare it is.

    score = sum over words of (occurrences / words of the text) * ln(1 + documents / documents with the word). One pass counts the
    documents, one scores. No words, or a word that no document has, match nothing; null texts match nothing.
    """
    given = list(dict.fromkeys(w.lower() for w in words))
    d = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    if not given:
        return d.limit(0).select("id", F.lit(0.0).alias("score"))
    times = [F.size(F.filter("_w", _is(w))) for w in given]
    d = d.select("id", F.size("_w").alias("_n"), *[t.alias(f"_c{i}") for i, t in enumerate(times)])
    sizes = d.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"d{i}") for i in range(len(given))])  # one row
    for i in range(len(given)):
        d = d.where(F.col(f"_c{i}") > 0)
    score = sum((F.col(f"_c{i}") / F.col("_n") * F.log(1 + F.col("n") / F.col(f"d{i}")) for i in range(len(given))), F.lit(0.0))
    return d.crossJoin(F.broadcast(sizes)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _matrices(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: their places, and the vectors scaled to length 1 (zero vectors stay zero). Vectors with nulls are left out."""
    offs, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype("f8")
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
    out = {}
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        v = values[(offs[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
        ok = np.isfinite(v).all(1)
        norm = np.linalg.norm(v[ok], axis=1, keepdims=True)
        out[dim] = at[ok], v[ok] / np.where(norm == 0, 1, norm)
    return out


def _whole(col: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)


def _best(c: np.ndarray, limit: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``limit`` largest values, equal ones at the edge all kept, and none below ``least``."""
    if c.shape[1] > limit:
        edge = np.partition(c, c.shape[1] - limit, axis=1)[:, c.shape[1] - limit]
        return np.nonzero((c >= edge[:, None]) & (c >= least))
    return np.nonzero(c >= least)


def _pairs(qids, q: dict, ids, rows: dict, limit: int, least: float) -> pa.RecordBatch:
    a, b, s = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "f8")]
    for dim, (at, v) in rows.items():
        if dim in q:
            for i in range(0, len(q[dim][0]), 512):
                c = np.round(q[dim][1][i : i + 512] @ v.T, 12)
                x, y = _best(c, limit, least)
                a.append(qids[q[dim][0][i + x]])
                b.append(ids[at[y]])
                s.append(c[x, y])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["query_id", "id", "cosine"])


PAIRS = "query_id bigint, id bigint, cosine double"


def nearest(vectors: DataFrame, id_col: str, vec_col: str, query: DataFrame, limit: int, least: float = -2.0) -> DataFrame:
    """(query_id, id, cosine, rank): the exact ``limit`` nearest vectors of each query with a cosine of ``least`` or more; ``query``: query_id, vector.

    Ids are bigint, ties go to the smaller id, cosines are rounded to 12 digits. Few queries travel to the rows; many are cut
    into blocks that meet blocks of rows. Either way a task keeps the best of its part only. Null, empty and not finite vectors, and
    lengths that differ, never match; a zero vector has cosine 0.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("_v")).where("id IS NOT NULL AND size(_v) > 0")
    q = query.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("_v")).where("query_id IS NOT NULL AND size(_v) > 0")
    n = q.count()
    if n * limit <= FEW:
        held = q.toArrow().combine_chunks() if n else None
        if held is None:
            return q.sparkSession.createDataFrame([], PAIRS + ", rank int")
        shared = v.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(), _matrices(_whole(held["_v"]))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, qs = shared.value
            for b in batches:
                if b.num_rows:
                    yield _pairs(qids, qs, b.column(0).to_numpy(), _matrices(b.column(1)), limit, least)

        found = v.mapInArrow(scan, PAIRS)
    else:
        qn, rn = -(-n // BLOCK), max(1, -(-v.count() // BLOCK))
        left = q.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(qn)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rn - 1))))
        right = v.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(rn)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(qn - 1))))

        def meet(l: pa.Table, r: pa.Table) -> pa.Table:
            l, r = l.combine_chunks(), r.combine_chunks()
            if not l.num_rows or not r.num_rows:
                return pa.Table.from_batches([_pairs(np.empty(0, "i8"), {}, np.empty(0, "i8"), {}, limit, least)])
            return pa.Table.from_batches([_pairs(l["query_id"].to_numpy(), _matrices(_whole(l["_v"])), r["id"].to_numpy(), _matrices(_whole(r["_v"])), limit, least)])

        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, PAIRS)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fuse(text: DataFrame, vector: DataFrame, alpha: float, k: int) -> DataFrame:
    """(id, score): alpha * text / max + (1 - alpha) * vector / max over the full outer merge; a missing side is 0.

    A maximum of 0 or below gives 0 for its side.
    """
    t = text.select("id", F.col("score").alias("_t"))
    v = vector.select("id", F.col("score").alias("_v"))
    top = t.agg(F.max("_t").alias("_mt")).crossJoin(v.agg(F.max("_v").alias("_mv")))  # one row each
    side = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    s = t.join(v, "id", "full").crossJoin(F.broadcast(top)).select("id", (alpha * side("_t", "_mt") + (1 - alpha) * side("_v", "_mv")).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(k)
