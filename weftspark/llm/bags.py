"""Texts as word bags, and all pairs of bags that share enough words.

A bag is the multiset of a text's words; its likeness to another is the number of words in
common over the larger word count. Repeats are told apart by mixing a word's occurrence
number into its hash, so that a bag becomes a set and its overlaps plain intersections.

``near_pairs`` finds *every* pair at or above the threshold:

1. Routing. Tokens are ordered by rising document frequency (a count sketch over all
   documents, broadcast: as many counters as the counted tokens ask for, at most ``SKETCH``;
   a counter's size is kept on a logarithmic scale and never clipped). Two bags that reach
   the threshold share a token among the first ``n - ceil(t*n) + 1`` of either, so each bag
   is hung below the root node of each of these tokens. Bags below a root are counted; a root
   with more than ``HOT`` is split into as many blocks as it needs, each pair of blocks being a root.
2. Signature trees. Below each root, bags sorted by size form leaves of ``FAN`` entries and
   inner nodes of ``FAN`` leaves, with the OR of their token bitmaps and their range of
   sizes. Node pairs are traversed together from the top and dropped as soon as
   the largest overlap they allow is below the threshold; all trees of a batch
   are walked at once as numpy frontiers. Where both inner nodes are full, their leaves would
   prune nothing: all their entries are compared at once by folded bitmaps, of which the
   differing bits are never more than the words that the two bags don't share.
3. Pairs that reach the bottom are compared exactly on their token sets in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.plans.bitfilter import may_match
from weftspark.plans.tables import stored

SKETCH = 1 << 22  # most counters of the frequency sketch: 16 MB to broadcast
SCALE = 4096  # steps of the logarithmic scale within a doubling
HOT = 16_384  # bags below one root before it is split into blocks
FAN = 8
BITS = 512
SLICE = 150_000  # node pairs held at once
DENSE = 400  # pairs of entries below two inner nodes from which these are compared as a block


def words(text: Column | str) -> Column:
    """Longest runs of letters and digits, lower case; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("toks")
        lists = b.column(at)
        offs = lists.offsets.to_numpy().astype("i8")
        v = lists.values.to_numpy()[offs[0] : offs[-1]].view("u8")
        offs = offs - offs[0]
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        x = v + (np.arange(len(v)) - first).astype("u8") * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x = (x >> np.uint64(32)).astype("u4").view("i4")
        cols = list(b.columns)
        cols[at] = pa.ListArray.from_arrays(pa.array(offs.astype("i4")), pa.array(x))
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)


def bag_rows(df: DataFrame, id_col: str, text_col: str, keep: Iterable[str] = (), min_words: int = 12) -> DataFrame:
    """(id, n, bag, toks, *keep) for each row with an id and at least ``min_words`` words.

    ``bag`` is equal for equal bags. Rows with a null id or text, or fewer words, are left
    out: they are defined to be like nothing.
    """
    keep = list(keep)
    d = df.select(F.col(id_col).cast("bigint").alias("id"), *keep, words(text_col).alias("w")).where(F.col("id").isNotNull() & (F.size("w") >= min_words))
    d = d.select("id", *keep, F.size("w").alias("n"), F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("toks"))
    d = d.withColumn("bag", F.xxhash64("toks", "n"))
    out = ", ".join(f"{c} {t}" for c, t in d.dtypes).replace("toks array<bigint>", "toks array<int>")
    return d.mapInArrow(_as_sets, out)


def token_counts(classes: DataFrame) -> DataFrame:
    """(s, n): how many bags hold a token with ``token & (SKETCH-1) = s``; at most SKETCH rows."""
    return classes.select(F.explode("toks").alias("t")).groupBy(F.expr(f"t & {SKETCH - 1}").alias("s")).agg(F.count("*").alias("n"))


def levels(counts: DataFrame) -> np.ndarray:
    """log2 of the bags that hold a token, in steps of 1/SCALE, by ``token & (len-1)``; an upper estimate."""
    rows = counts.toPandas()
    size = min(SKETCH, max(1 << 12, 1 << (4 * len(rows)).bit_length()))
    out = np.bincount(rows["s"].to_numpy("i8") & (size - 1), weights=rows["n"].to_numpy("f8"), minlength=size)
    return np.round(np.log2(1 + out) * SCALE).astype("u4")  # 64 doublings are below 2^18 steps


def sketch(classes: DataFrame) -> np.ndarray:
    return levels(token_counts(classes))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x.astype("u8") + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD) ^ y.astype("u8") * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _bitmaps(row: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    on = np.zeros((n, BITS), bool)
    on[row, (v * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(BITS)))] = True
    return np.packbits(on, axis=1).view("u8")


def _prefixes(b: pa.RecordBatch, freq: np.ndarray, thr: float):
    """cls, n of a batch; then of each token in a prefix its row, rank, hash and root; and all tokens with their rows."""
    cls, n, route = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cls", "n", "route"))
    lists = b.column(b.schema.get_field_index("toks"))
    offs = lists.offsets.to_numpy().astype("i8")
    v = lists.values.to_numpy()[offs[0] : offs[-1]].view("u4")
    offs = offs - offs[0]
    row = np.repeat(np.arange(len(cls)), np.diff(offs))
    key = (row.astype("u8") << np.uint64(50)) | (freq[v & np.uint32(len(freq) - 1)].astype("u8") << np.uint64(32)) | v
    key.sort()
    rank = np.arange(len(v)) - offs[row]
    left = n - np.ceil(thr * n - 1e-9).astype("i8") + 1
    pick = rank < left[row]
    tok = (key[pick] & np.uint64(0xFFFFFFFF)).astype("u4")
    return cls, n, row[pick], rank[pick], tok, _mix(tok, route[row[pick]]), v, row


def _roots(shared, thr: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                cls, n, row_, rank, _, root, v, row = _prefixes(b, freq, thr)
                lo, hi, comp = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("lo", "hi", "comp"))
                bits = np.ascontiguousarray(_bitmaps(row, v, len(cls))[row_])
                m = len(root)
                if m:
                    data = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * BITS // 8, BITS // 8, dtype="i4")), pa.py_buffer(bits)])
                    yield pa.RecordBatch.from_arrays([pa.array(root.view("i8")), pa.array(np.zeros(m, "i1")), pa.array(cls[row_]), pa.array(n[row_].astype("i4")), pa.array(rank.astype("i4")), pa.array(lo[row_].astype("i4")), pa.array(hi[row_].astype("i4")), pa.array(comp[row_]), data], names=["root", "side", "cls", "n", "rank", "lo", "hi", "comp", "bits"])

    return run


def _crowds(shared, thr: float, hot: int):
    """(root, n) of the batch's roots whose token may be in more than ``hot`` bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        least = np.log2(1 + hot) * SCALE
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                *_, tok, root, _, _ = _prefixes(whole.slice(at, 4096), freq, thr)
                u, c = np.unique(root[freq[tok & np.uint32(len(freq) - 1)] >= least].view("i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], names=["root", "n"])

    return run


def _blocks(shared):
    """Postings of hot roots once for each pair of blocks that theirs is in; the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = shared.value
        for b in batches:
            root, cls = b.column(0).to_numpy().view("u8"), b.column(2).to_numpy()
            at = np.minimum(np.searchsorted(hot, root), len(hot) - 1)
            g = np.where(hot[at] == root, count[at], 1)
            if (g == 1).all():
                yield b
                continue
            again = np.repeat(np.arange(len(root)), g)
            j = np.arange(len(again)) - np.repeat(np.cumsum(g) - g, g)
            mine = (_mix(cls[again], np.full(len(again), 7)) % g[again].astype("u8")).astype("i8")
            side = np.where(mine == j, 0, np.where(mine < j, 1, 2)).astype("i1")
            pair = np.where(g[again] > 1, (np.minimum(mine, j) << 32) + np.maximum(mine, j) + 1, 0)
            new = np.where(pair > 0, _mix(root[again], pair), root[again]).view("i8")
            cols = [c.take(pa.array(again)) for c in b.columns]
            cols[0], cols[1] = pa.array(new), pa.array(side)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def _expand(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (child of a, child of b); of a node with itself each pair once, with equal ends kept."""
    ca, cb = end[a] - start[a], end[b] - start[b]
    total = ca * cb
    which = np.repeat(np.arange(len(a)), total)
    k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    x, y = start[a][which] + k // cb[which], start[b][which] + k % cb[which]
    keep = (a != b)[which] | (x <= y)
    return x[keep], y[keep]


class _Level:
    """Nodes over consecutive children: OR of bitmaps, size range, how far tokens outnumber bits, range of components."""

    def __init__(self, starts: np.ndarray, total: int, bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.start, self.end = starts, np.append(starts[1:], total)
        self.bits = np.bitwise_or.reduceat(bits, starts, axis=0)
        self.low, self.high, self.slack = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts)
        self.first, self.last = np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where all entries of both nodes are in one component already."""
        return (self.first[a] != self.last[a]) | (self.first[b] != self.last[b]) | (self.first[a] != self.first[b])

    def may(self, a: np.ndarray, b: np.ndarray, thr: float) -> np.ndarray:
        need = np.ceil(thr * np.maximum(self.low[a], self.low[b]) - 1e-9)
        most = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype="i4") + np.minimum(self.slack[a], self.slack[b])
        return (np.minimum(most, np.minimum(self.high[a], self.high[b])) >= need) & self.apart(a, b)


def _walk(root, side, cls, n, rank, lo, hi, comp, bits, thr: float) -> tuple[np.ndarray, np.ndarray]:
    m = len(root)
    new = np.ones(m, bool)
    new[1:] = root[1:] != root[:-1]
    begin = np.flatnonzero(new)
    place = np.arange(m) - np.repeat(begin, np.diff(np.append(begin, m)))
    slack = n - np.bitwise_count(bits).sum(1, dtype="i4")
    leaf_at = np.flatnonzero(place % FAN == 0)
    leaves = _Level(leaf_at, m, bits, n, n, slack, comp, comp)
    inner_at = np.flatnonzero(place[leaf_at] % (FAN * FAN) == 0)
    inner = _Level(inner_at, len(leaf_at), leaves.bits, leaves.low, leaves.high, leaves.slack, leaves.first, leaves.last)
    tree = root[leaf_at[inner_at]]
    head = leaf_at[inner_at]
    tail = np.append(head[1:], m)
    fold = np.zeros((2, m + FAN * FAN), "u8")
    for i in range(bits.shape[1]):
        fold[i % 2, :m] ^= bits[:, i]
    # A bag may miss as many words of any partner's; 128 differing bits are the most there are.
    spare = np.zeros(m + FAN * FAN, "u1")
    spare[:m] = np.minimum(n - np.ceil(thr * n - 1e-9), BITS // 8 * 2 - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(x: np.ndarray, y: np.ndarray) -> None:
        need = np.ceil(thr * np.maximum(n[x], n[y]) - 1e-9)
        ok = (cls[x] != cls[y]) & (comp[x] != comp[y]) & ((side[x] == 0) & (side[y] == 0) | (side[x] + side[y] == 3))
        ok &= (np.minimum(n[x], n[y]) >= need) & (1 + np.minimum(n[x] - rank[x], n[y] - rank[y]) - 1 >= need)
        ok &= np.minimum(lo[x], lo[y]) < np.maximum(hi[x], hi[y])
        x, y, need = x[ok], y[ok], need[ok]
        both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype="i4")
        # each bit of one that the other lacks is at least one word that the other lacks
        most = np.minimum(slack[x], slack[y]) + both
        ok = most >= need
        found.append((cls[x[ok]], cls[y[ok]]))

    def dense(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of entries below each node of a and that of b, of which the folded bitmaps differ in no more bits than both may miss words."""
        x, y = head[a][:, None] + np.arange(FAN * FAN), head[b][:, None] + np.arange(FAN * FAN)
        apart = np.bitwise_count(fold[0][x][:, :, None] ^ fold[0][y][:, None, :])
        apart += np.bitwise_count(fold[1][x][:, :, None] ^ fold[1][y][:, None, :])
        k, i, j = np.nonzero(apart <= spare[x][:, :, None] + spare[y][:, None, :])
        x, y = x[k, i], y[k, j]
        ok = (x < tail[a][k]) & (y < tail[b][k]) & ((a != b)[k] | (x < y))
        return x[ok], y[ok]

    def sliced(a: np.ndarray, b: np.ndarray, step: int):
        for i in range(0, len(a), step):
            yield a[i : i + step], b[i : i + step]

    d = 0
    while d < len(tree):
        a = np.flatnonzero(tree[: len(tree) - d] == tree[d:])
        if not len(a):
            break
        b = a + d
        ok = inner.may(a, b, thr) if d else inner.apart(a, b)
        a, b = a[ok], b[ok]
        full = (tail[a] - head[a]) * (tail[b] - head[b]) >= DENSE
        for p, q in sliced(a[full], b[full], 16):
            rows(*dense(p, q))
        a, b = a[~full], b[~full]
        for p, q in sliced(a, b, SLICE // FAN**2):
            x, y = _expand(p, q, inner.start, inner.end)
            ok = np.where(x == y, leaves.apart(x, y), leaves.may(x, y, thr))
            for r, s in sliced(x[ok], y[ok], SLICE // FAN**2 * 8):
                rows(*_expand(r, s, leaves.start, leaves.end))
        d += 1
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    x, y = (np.concatenate(z) for z in zip(*found))
    return np.minimum(x, y), np.maximum(x, y)


def _trees(thr: float):
    names = ["root", "side", "cls", "n", "rank", "lo", "hi", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        seen: set[int] = set()

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _walk(*cols, thr)
            if len(a):
                u = np.unique(np.stack([a, b], 1), axis=0)
                a, b = u[:, 0], u[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for t in batches:
            cols = [t.column(t.schema.get_field_index(c)).to_numpy() for c in names]
            data = t.column(t.schema.get_field_index("bits"))
            offs = np.frombuffer(data.buffers()[1], "i4")[data.offset : data.offset + len(data) + 1]
            cols.append(np.frombuffer(data.buffers()[2], "u1")[offs[0] : offs[-1]].reshape(-1, BITS // 8).view("u8"))
            if kept is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(kept, cols)]
            root = cols[0]
            if not len(root):
                continue
            cut = int(np.searchsorted(root, root[-1]))
            kept = [c[cut:].copy() for c in cols]
            if cut:
                yield out([c[:cut] for c in cols])
        if kept is not None:
            yield out(kept)

    return run


PARTS = 8  # parts of a token set whose equality ties near copies


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, k) of each part with three tokens or more; k sums the tokens' hashes, so order plays no role."""
    for b in batches:
        cls, route, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        offs = lists.offsets.to_numpy().astype("i8")
        v = lists.values.to_numpy()[offs[0] : offs[-1]].view("u4")
        row = np.repeat(np.arange(len(cls)), np.diff(offs))
        h = _mix(v, np.full(len(v), 11, "u8"))
        at = row * PARTS + (h >> np.uint64(60)).astype("i8") % PARTS
        total, n = np.zeros(len(cls) * PARTS, "u8"), np.bincount(at, minlength=len(cls) * PARTS)
        np.add.at(total, at, h)
        own, part = np.repeat(np.arange(len(cls)), PARTS), np.tile(np.arange(PARTS), len(cls))
        key = _mix(_mix(total, n), route[own].astype("i8") * PARTS + part)
        keep = n >= 3
        yield pa.RecordBatch.from_arrays([pa.array(cls[own[keep]]), pa.array(key[keep].view("i8"))], names=["cls", "k"])


def star_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness): a part of all near pairs, linear in the rows: it ties masses of near copies together.

    Token sets are cut into PARTS by hash; classes with an equal part of at least three tokens
    are compared with the smallest class of that part only. That class comes from partial aggregates; it is then
    joined to the part's members, one row against many, which a skewed key lets the session split at will.
    """
    k = classes.select("cls", "route", "toks").mapInArrow(_parts, "cls bigint, k bigint")
    heads = k.groupBy("k").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("k", "a")
    stars = k.join(heads, "k").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    return compared(stored(stars, "stars"), classes, threshold)


POSTS = "root bigint, side tinyint, cls bigint, n int, rank int, lo int, hi int, comp bigint, bits binary"


def _share(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def postings(classes: DataFrame, freq: np.ndarray, threshold: float) -> DataFrame:
    """The blocking-key table: one row for each root that a class hangs below."""
    if "comp" not in classes.columns:
        classes = classes.withColumn("comp", F.col("cls"))
    return classes.select("cls", "n", "toks", "route", "lo", "hi", "comp").mapInArrow(_roots(_share(classes, freq), threshold), POSTS)


def crowded(classes: DataFrame, freq: np.ndarray, threshold: float) -> DataFrame | None:
    """(root, n) of the roots with more than HOT bags, counted over all; None where no token is in so many."""
    if freq.max(initial=0) < np.log2(1 + HOT) * SCALE:
        return None
    return classes.select("cls", "n", "toks", "route").mapInArrow(_crowds(_share(classes, freq), threshold, HOT), "root bigint, n bigint").groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)


def tree_pairs(posts: DataFrame, threshold: float, crowds: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: candidates of the signature trees below all roots; ``crowds`` are those to split (at most one in HOT postings)."""
    hot = crowds.orderBy("root").toPandas() if crowds is not None else None
    if hot is not None and len(hot):
        root = hot["root"].to_numpy("i8").view("u8")
        order = np.argsort(root)
        posts = posts.mapInArrow(_blocks(_share(posts, (root[order], -(-hot["n"].to_numpy("i8")[order] // HOT)))), POSTS)
    posts = posts.repartition("root").sortWithinPartitions("root", F.when(F.col("comp") != F.col("cls"), F.col("comp")), "n")
    return posts.mapInArrow(_trees(threshold), "a bigint, b bigint").distinct()


def compared(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose likeness, from the whole token sets, reaches the threshold.

    Only classes that are in a pair travel: the others are sieved out before the joins.
    """
    sets = may_match(classes.select("cls", "n", "toks"), "cls", pairs.select(F.explode(F.array("a", "b"))))
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("common") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9).select("a", "b", (F.col("common") / F.greatest("na", "nb")).alias("likeness"))


def near_pairs(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: all pairs of classes with likeness >= threshold and the same route.

    ``classes``: cls bigint unique, n int, toks array<int> (a set), route int, lo int, hi int.
    A pair counts only if the smaller lo is below the larger hi, and, with a column comp bigint, if
    comp differs. Read it from a written table: it is scanned more than once.
    """
    freq = sketch(classes)
    pairs = tree_pairs(postings(classes, freq, threshold), threshold, crowded(classes, freq, threshold))
    return compared(stored(pairs, "candidates"), classes, threshold)
