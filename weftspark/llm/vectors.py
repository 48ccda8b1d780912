"""The k most similar vectors of every vector, by a hash-prefix forest (problem 1).

Each of ``trees`` trees gives every vector a 64-bit hash string (signs of random
projections) and keeps the vectors in the sorted order of these strings. A vector's
longest-prefix matches are its neighbours in that order; ascending to shorter prefixes
widens the stretch. In every tree a vector looks at the ``reach`` entries before and after
it, and takes those of the deepest prefix nodes that together hold at least ``reach``
entries: the level at which it stops is its own, not a fixed prefix length. A sorted array is cut
into ranges at quantiles of a bounded sample, so that a third of all rows with almost equal
vectors still spreads over many ranges. Vectors travel as float16; the pairs that
survive are scored again from the full vectors.

A window says little inside a dense group of similar, unequal vectors. A vector half of whose
window is near it in some tree is therefore compared with every vector that can beat its k-th best so
far: dense vectors go to pivots, the triangle inequality on angles rules out what is too far
from a pivot, and the rest is compared in blocks. That is exact, and quadratic in a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.plans.tables import stored, table

SAMPLE = 8192  # vectors that fit the range bounds, whatever the input
RANGE_ROWS = 20_000  # about so many rows in one range of a sorted array
DENSE = 0.89  # cosine from which an entry of the window counts as near
PIVOTS = 4096  # vectors that pivots of the dense ones are drawn from; bears on time alone
BLOCK = 8192  # rows on either side of one exact comparison


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec) of the rows with an id and exactly ``dim`` finite numbers that aren't all zero."""
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(~bad & F.exists("vec", lambda x: x != 0))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    offs = col.offsets
    return col.values.to_numpy(zero_copy_only=False)[offs[0].as_py() : offs[-1].as_py()].reshape(-1, dim).astype("f4")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype("f8")
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * 64), dtype="f4")


def _keys(v: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """[rows, trees] hash strings as unsigned integers, first bit highest."""
    on = np.packbits((v @ planes) > 0, axis=1).reshape(len(v), trees, 8)
    return np.ascontiguousarray(on).view(">u8")[:, :, 0].astype("u8")


def _prefix_len(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return 64 - np.bitwise_count(x).astype("i4")


def _plant(dim: int, trees: int, seed: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, bounds = _planes(dim, trees, seed), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = _unit(_matrix(b.column(1), dim))
                keys, ids, small = _keys(v, planes, trees), b.column(0), pa.array([r.tobytes() for r in v.astype("f2")], pa.binary())
                for t in range(trees):
                    k = keys[:, t]
                    part = np.searchsorted(bounds[t], k, side="right") + t * (bounds.shape[1] + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array((k ^ np.uint64(1 << 63)).view("i8")), ids, small], names=["part", "key", "id", "v"])

    return run


def _near(dim: int, reach: int, k: int, least: float):
    def scan(part, key, ids, v):
        n = len(ids)
        u = key.view("u8") ^ np.uint64(1 << 63)
        depth = np.full((n, 2 * reach), -1, "i1")
        for d in range(1, min(reach, n - 1) + 1):
            lcp = np.where(part[:-d] == part[d:], _prefix_len(u[:-d], u[d:]), -1).astype("i1")
            depth[:-d, d - 1] = lcp
            depth[d:, reach + d - 1] = lcp
        # Ascend until the node holds `reach` entries: its prefix length is the reach-th longest.
        stop = -np.partition(-depth, reach - 1, axis=1)[:, reach - 1]
        stop = np.maximum(stop, 0)
        xs, ys, cs, near = [], [], [], np.zeros(n, "i4")
        for d in range(1, min(reach, n - 1) + 1):
            ok = (depth[:-d, d - 1] >= np.minimum(stop[:-d], stop[d:]))
            i = np.flatnonzero(ok)
            c = np.einsum("ij,ij->i", v[i], v[i + d])
            good = c >= least
            near[i[c >= max(least, DENSE)]] += 1
            near[i[c >= max(least, DENSE)] + d] += 1
            xs.append(i[good])
            ys.append(i[good] + d)
            cs.append(c[good])
        x, y, c = np.concatenate(xs or [np.empty(0, "i8")]), np.concatenate(ys or [np.empty(0, "i8")]), np.concatenate(cs or [np.empty(0, "f4")])
        a, b, c = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([c, c])
        order = np.lexsort((-c, a))
        a, b, c = a[order], b[order], c[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        own = ids[near >= reach // 2]
        return np.concatenate([ids[a[keep]], own]), np.concatenate([ids[b[keep]], own]), np.concatenate([c[keep], np.full(len(own), 2, "f4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for t in batches:
            if not t.num_rows:
                continue
            data = t.column(3)
            o = np.frombuffer(data.buffers()[1], "i4")[data.offset : data.offset + len(data) + 1]
            v = np.frombuffer(data.buffers()[2], "u1")[o[0] : o[-1]].view("f2").reshape(-1, dim).astype("f4")
            cols = [t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), v]
            if kept is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(kept, cols)]
            a, b, c = scan(*cols)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype("f4"))], names=["id", "other", "approx"])
            kept = [x[-reach:].copy() for x in cols]

    return run


def _some(vectors: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` vectors, picked by their ids before anything is sent, however many partitions there are."""
    return vectors.select("vec").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, n))) < most) if n > most else vectors.select("vec")


def bounds_of(vectors: DataFrame, dim: int, trees: int, seed: int, ranges: int, n: int) -> np.ndarray:
    """[trees, ranges-1] quantiles of the trees' hash strings in a sample of about SAMPLE of the ``n`` vectors."""
    sample = _some(vectors, n, SAMPLE).toPandas()["vec"]
    if not len(sample) or ranges < 2:
        return np.empty((trees, 0), "u8")
    keys = np.sort(_keys(_unit(np.stack(sample.to_list()).astype("f4")), _planes(dim, trees, seed), trees), axis=0)
    return np.ascontiguousarray(keys[(np.arange(1, ranges) * len(keys)) // ranges].T)


def _float32(col: pa.Array, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, "f4") for x in col.to_pylist()]) if len(col) else np.empty((0, dim), "f4")


def _to_pivot(dim: int, shared):
    """(p, id, v, most): a dense vector at its nearest pivot, and how far from the pivot what beats its k-th best can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _unit(_matrix(b.column(2), dim))
                c = v @ shared.value.T
                p = c.argmax(1)
                most = np.arccos(np.clip(c[np.arange(len(v)), p], -1, 1)) + np.arccos(np.clip(b.column(1).to_numpy(), -1, 1)) + 2e-3
                yield pa.RecordBatch.from_arrays([pa.array(p.astype("i4")), b.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(most.astype("f8"))], names=["p", "id", "v", "most"])

    return run


def _in_sight(dim: int, shared):
    """(p, id, v): a vector at every pivot of whose dense vectors it may be a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, most = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = _unit(_matrix(b.column(1), dim))
                i, p = np.nonzero(np.arccos(np.clip(v @ pivots.T, -1, 1)) <= most)
                small = pa.array([r.tobytes() for r in v], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(p.astype("i4")), b.column(0).take(pa.array(i)), small.take(pa.array(i))], names=["p", "id", "v"])

    return run


def _compare(dim: int, k: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        v, w = _float32(left["v"], dim), _float32(right["v"], dim)
        xs, ys, cs = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "f4")]
        for at in range(0, len(v) if len(w) else 0, 512):
            c = v[at : at + 512] @ w.T
            c[ids[at : at + 512, None] == others] = -3
            top = np.argpartition(-c, min(k, c.shape[1]) - 1, axis=1)[:, :k]
            c = np.take_along_axis(c, top, 1)
            i, j = np.nonzero(c >= max(least, -2))
            xs.append(ids[at + i])
            ys.append(others[top[i, j]])
            cs.append(c[i, j])
        return pa.table({"id": np.concatenate(xs), "other": np.concatenate(ys), "approx": np.concatenate(cs).astype("f4")})

    return run


def _pivots(dense: DataFrame, dim: int) -> np.ndarray:
    """Vectors of a bounded sample of the dense ones, none within 0.45 radians of another."""
    n = dense.count()
    few = _some(dense, n, PIVOTS).toPandas()["vec"].to_list() or dense.select("vec").limit(1).toPandas()["vec"].to_list()
    sample = _unit(np.stack(few).astype("f4").reshape(-1, dim))
    out: list[np.ndarray] = []
    while len(sample):
        out.append(sample[0])
        sample = sample[1:][sample[1:] @ sample[0] < 0.9]
    return np.stack(out)


def _refined(classes: DataFrame, best: DataFrame, dim: int, k: int, spare: int, least: float) -> DataFrame | None:
    """(id, other): the nearest of all vectors for each dense one (a row of ``best`` with itself); None without any."""
    spark = classes.sparkSession
    if not best.where("id = other").head(1):
        return None
    # The k-th best so far bounds the search; 0.002 allows for float16.
    floor = best.where(F.col("r") <= k + 1).groupBy("id").agg(F.max(F.col("id") == F.col("other")).alias("dense"), F.count("*").alias("n"), F.min("approx").alias("c")).where("dense")
    floor = floor.select("id", F.when(F.col("n") > k, F.greatest(F.col("c") - 0.002, F.lit(least))).otherwise(F.lit(least)).cast("double").alias("floor"))
    dense = stored(floor.join(classes, "id").select("id", "floor", "vec"), "dense")
    pivots = _pivots(dense, dim)
    q = stored(dense.mapInArrow(_to_pivot(dim, spark.sparkContext.broadcast(pivots)), "p int, id bigint, v binary, most double"), "dense")
    most = np.full(len(pivots), -1.0)
    size = q.groupBy("p").agg(F.max("most").alias("most"), F.count("*").alias("nq")).toPandas()
    most[size["p"]] = size["most"]
    t = stored(classes.select("id", "vec").mapInArrow(_in_sight(dim, spark.sparkContext.broadcast((pivots, most))), "p int, id bigint, v binary"), "in_sight")
    size = size.merge(t.groupBy("p").agg(F.count("*").alias("nt")).toPandas(), on="p")
    blocks = [(int(p), -(-int(a) // BLOCK), -(-int(b) // BLOCK)) for p, a, b in zip(size["p"], size["nq"], size["nt"])]
    blocks = F.broadcast(spark.createDataFrame(blocks, "p int, qn int, tn int"))  # at most PIVOTS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = q.join(blocks, "p").select("p", part("qn").alias("i"), spread("tn").alias("j"), "id", "v")
    right = t.join(blocks, "p").select("p", spread("qn").alias("i"), part("tn").alias("j"), "id", "v")
    near = left.groupBy("p", "i", "j").cogroup(right.groupBy("p", "i", "j")).applyInArrow(_compare(dim, k + spare, least), "id bigint, other bigint, approx float")
    w = Window.partitionBy("id").orderBy(F.desc("approx"), "other")
    return stored(near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + spare).select("id", "other"), "nearest")


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, trees: int = 16, reach: int = 32, min_cosine: float = -1.0, spare: int = 3, seed: int = 7) -> DataFrame:
    """(id, other, cosine, rank): up to ``k`` most similar other records of every usable vector.

    Nearest first, equal cosines by smaller id. Records with equal vectors form one class:
    a member's nearest are the other members with the smallest ids. With ``min_cosine`` only
    pairs that reach it come out. Approximate: recall falls with the neighbours' cosine, see README for
    measured figures, but vectors in dense groups are searched exactly; the cosines themselves are exact. Unusable vectors (null, wrong length, not finite,
    all zero) have no row; an empty table gives no row; repeated ids count once.
    """
    spark = df.sparkSession
    every = stored(usable(df, id_col, vec_col, dim).withColumn("same", F.xxhash64(F.transform("vec", lambda x: x + F.lit(0.0).cast("float")))), "vectors")
    classes = every.groupBy("same").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.any_value("vec").alias("vec"))
    classes = stored(classes, "classes")
    n = classes.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    bounds = spark.sparkContext.broadcast(bounds_of(classes, dim, trees, seed, ranges, n))
    planted = classes.select("id", "vec").mapInArrow(_plant(dim, trees, seed, bounds), "part int, key bigint, id bigint, v binary")
    # Ranges are dealt out by number, not by hash, so that no task gets several more than another.
    tasks = min(trees * ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), trees * ranges // 8))
    planted = planted.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "key")
    least = min_cosine - 0.01 if min_cosine > -1 else -2.0
    pairs = planted.mapInArrow(_near(dim, reach, k + spare, least), "id bigint, other bigint, approx float").groupBy("id", "other").agg(F.max("approx").alias("approx"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("approx"), "other"))).where(F.col("r") <= k + spare + 1)
    best = stored(best, "neighbours")
    exact = _refined(classes, best, dim, k, spare, least)
    best = best.where("id <> other").select("id", "other")
    best = best if exact is None else best.union(exact)
    v = classes.select("id", "vec")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))
    half = best.where("id < other").union(best.where("id > other").select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    scored = half.join(v.select("id", F.col("vec").alias("x")), "id").join(v.select(F.col("id").alias("other"), F.col("vec").alias("y")), "other").select("id", "other", (dot / (norm("x") * norm("y"))).alias("cosine"))
    scored = scored.union(scored.select(F.col("other").alias("id"), F.col("id").alias("other"), "cosine")).where(F.col("cosine") >= min_cosine)
    copies = classes.where("last <> id").select("same", F.col("id").alias("cls"))
    if not copies.head(1):
        out = scored
    else:
        # Copies: the k+1 smallest members stand for a class; partial aggregates keep the group out of one task.
        members = every.join(copies, "same").select("cls", F.col("id").alias("member")).distinct()
        few = members.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(64)))
        for keys in (["cls", "salt"], ["cls"]):
            few = few.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).where(F.col("r") <= k + 1)
        few = few.select("cls", "member")
        own = members.join(few.withColumnRenamed("member", "other"), "cls").where("member <> other").select(F.col("member").alias("id"), "other", F.lit(1.0).alias("cosine"))
        left = scored.join(members.withColumnRenamed("cls", "id"), "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "cosine")
        both = left.join(few.select(F.col("cls").alias("other"), F.col("member").alias("m")), "other", "left").select("id", F.coalesce("m", "other").alias("other"), "cosine")
        out = own.union(both)
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for tbl in ("translations", "knowledge"):
        near = similar_vectors(table(spark, sf_dir, tbl), "id", "embedding", min_cosine=0.9)
        d = near.select(F.lit(tbl).alias("tbl"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
        out = d if out is None else out.union(d)
    return out
