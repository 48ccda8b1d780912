"""New batches against everything accepted before (problem 4).

The accepted history is a folder that any later session can reopen with ``History(spark, path)``:

* ``entries``: one row for each word bag, target and batch, with its smallest id,
* ``keys``: the entries' blocking keys with their signatures,
* ``reps``: cluster member -> representative,
* ``counts``: the token counts that fix the order of keys for good,
* ``manifest``: which segments of these tables are live; the newest one counts, so a call that dies leaves no trace.

Entries and keys are partitioned by a hash of their key. Segments are merged as they grow (the last two, as soon
as the newer holds as much as the older), so that there are only a logarithm of them and a
plan after fifty batches is as large as after five. A call with new batches

1. makes entries and keys of the new rows only,
2. probes: of the persisted keys the partitions that new keys fall into are read, and in them only what a bit filter of
   the new keys lets pass; roots that have become hot since are split by the counts of the day,
3. compares candidates field by field and scores them with Fellegi-Sunter weights learned
   by expectation-maximization from the counts of agreement profiles,
4. unites clusters by a union-find over the representatives that the new links touch,
5. appends segments and a manifest.

Batches may come singly or several at once; rows of one call are checked against earlier
batches of the same call as well, so the results are the same either way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.bags import HOT, bag_rows, compared, crowded, levels, postings, token_counts, tree_pairs
from weftspark.operators.components import connected_components
from weftspark.plans.bitfilter import may_match
from weftspark.plans.tables import new_path, stored, table

PARTS = 16  # partitions of the persisted entries and keys; more of them let a small batch read less
REPS = "node bigint, root bigint, v int"
MATCHES = "id {}, batch int, match_id bigint, likeness double, score double"
MANIFEST = "version int, name string, path string, n bigint, fields string"

FIELDS = {"same_hash": 2, "same_lang": 2, "same_context": 2, "close": 3}  # levels of each compared field


def learned_weights(profiles: list[tuple[tuple[int, ...], int]], rounds: int = 40) -> tuple[list[np.ndarray], float]:
    """Log2 weights by field and level, and the prior's log-odds, by EM over counted agreement profiles.

    ``profiles`` has at most the product of all levels; no profiles give zero weights.
    """
    levels = list(FIELDS.values())
    if not profiles:
        return [np.zeros(k) for k in levels], 0.0
    x = np.array([p for p, _ in profiles])
    c = np.array([n for _, n in profiles], "f8")
    p = 0.7
    m = [np.linspace(1, 3, k) / np.linspace(1, 3, k).sum() for k in levels]
    u = [v[::-1].copy() for v in m]
    for _ in range(rounds):
        lm = np.log(p) + sum(np.log(m[f][x[:, f]]) for f in range(len(levels)))
        lu = np.log(1 - p) + sum(np.log(u[f][x[:, f]]) for f in range(len(levels)))
        g = 1 / (1 + np.exp(np.clip(lu - lm, -500, 500)))
        p = float(np.clip((g * c).sum() / c.sum(), 1e-3, 1 - 1e-3))
        for f, k in enumerate(levels):
            for at, w in ((m, g * c), (u, (1 - g) * c)):
                v = np.bincount(x[:, f], weights=w, minlength=k) + 0.5
                at[f] = v / v.sum()
    return [np.log2(a / b) for a, b in zip(m, u)], float(np.log2(p / (1 - p)))


def _part(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(PARTS)).cast("int")


def _newest(reps: DataFrame) -> DataFrame:
    """Of each node the row of the latest version."""
    return reps.groupBy("node").agg(F.max_by("root", "v").alias("root"), F.max("v").alias("v"))


class History:
    """Accepted batches in a folder shared by all executors; an existing folder is continued."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.8, min_words: int = 12):
        self.spark, self.path, self.threshold, self.min_words = spark, path or new_path(spark, "history"), threshold, min_words
        self.version, self.step, self.live, self.fields = 0, 0, {"entries": [], "keys": [], "reps": []}, {}
        self._freq: np.ndarray | None = None
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if path and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect()  # a few rows a call
            self.version = max(r["version"] for r in rows)
            for r in rows:
                if r["version"] == self.version:
                    self.live[r["name"]].append((r["path"], r["n"]))
                    self.fields[r["name"]] = r["fields"]

    def _segment(self, name: str, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.fields[name]}, part int").option("basePath", path).parquet(path)

    def _read(self, name: str, fields: str, parts: DataFrame | None = None) -> DataFrame:
        """The live rows of a table; with ``parts`` (column part) only of these partitions."""
        if not self.live[name]:
            return self.spark.createDataFrame([], fields)
        some = [r["part"] for r in parts.distinct().collect()] if parts is not None else None  # at most PARTS
        out = None
        for p, _ in self.live[name]:  # a logarithm of them
            d = self._segment(name, p)
            d = (d if some is None else d.where(F.col("part").isin(some))).drop("part")
            out = d if out is None else out.union(d)
        return out

    def _write(self, name: str, df: DataFrame, key: str) -> tuple[str, int]:
        """A segment on disk, live once a manifest names it: its path and rows."""
        self.step += 1
        path = f"{self.path}/{name}/{self.version + 1}-{self.step}"
        self.fields[name] = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        # As many tasks as the session's shuffles have: a partition is several files once there are more tasks than partitions.
        split = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)
        df.withColumn("part", _part(key)).repartition("part", F.pmod(F.xxhash64(key, F.lit(3)), F.lit(split))).write.mode("overwrite").partitionBy("part").parquet(path)
        return path, self._segment(name, path).count()

    def _add(self, name: str, segment: tuple[str, int], key: str) -> None:
        """A new segment; the last two are merged while the newer holds as much as the older."""
        held = self.live[name]
        if segment[1]:
            held.append(segment)
        while len(held) > 1 and held[-1][1] >= held[-2][1]:
            both = [self._segment(name, held.pop()[0]).drop("part") for _ in range(2)]
            both = both[0].union(both[1])
            held.append(self._write(name, _newest(both) if name == "reps" else both, key))

    def freq(self, entries: DataFrame) -> np.ndarray:
        """The order of keys: fixed by the first call's token counts, read back by later sessions."""
        if self._freq is None:
            if not self.version:
                token_counts(entries).write.mode("overwrite").parquet(f"{self.path}/counts")
            self._freq = levels(self.spark.read.schema("s bigint, n bigint").parquet(f"{self.path}/counts"))
        return self._freq

    def link(self, df: DataFrame, id_col: str = "id", text_col: str = "source_text", batch_col: str = "batch_no", target_col: str = "target_lang", hash_col: str = "hash", lang_col: str = "source_lang", context_col: str = "context") -> DataFrame:
        """(id, batch, match_id, likeness, score) of each new row that repeats a row of an earlier batch.

        match_id is the smallest id among the rows of earlier batches with the same target
        and a likeness of at least the threshold; likeness and score belong to the best link of
        the row's entry. Rows with a null id, text, batch or target, and texts under
        ``min_words`` words, repeat nothing; repeated rows count once; hash, language and
        context may be null and then agree with nothing. The rows are accepted afterwards.
        """
        keep = {"batch": F.col(batch_col).cast("int"), "target": F.col(target_col), "h": F.lower(hash_col), "lang": F.lower(lang_col), "ctx": F.col(context_col)}
        d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in keep.items()]).where("batch IS NOT NULL AND target IS NOT NULL")
        rows = stored(bag_rows(d, "id", "text", keep, self.min_words), "arrivals")
        by = ["bag", "target", "batch"]
        entries = rows.groupBy(*by).agg(F.min("id").alias("cls"), F.min_by("h", "id").alias("h"), F.min_by("lang", "id").alias("lang"), F.min_by("ctx", "id").alias("ctx"), F.any_value("n").alias("n"), F.any_value("toks").alias("toks"))
        entries = entries.select("cls", *by, "h", "lang", "ctx", "n", "toks", F.hash("target").alias("route"), F.col("batch").alias("lo"), F.col("batch").alias("hi"))
        new_entries, first = self._write("entries", entries, "cls"), not self.version
        if not new_entries[1]:
            return self.spark.createDataFrame([], MATCHES.format(rows.schema["id"].dataType.simpleString()))
        entries = self._segment("entries", new_entries[0]).drop("part")
        new_keys = self._write("keys", postings(entries, self.freq(entries), self.threshold), "root")
        keys = self._segment("keys", new_keys[0]).drop("part")
        # hi = -1 keeps accepted entries from being paired among themselves again.
        if first and len(entries.select("batch").distinct().take(2)) < 2:
            pairs = self.spark.createDataFrame([], "a bigint, b bigint")  # there is nothing earlier
        else:
            roots = keys.select("root").distinct()
            held = self._read("keys", self.fields["keys"], roots.select(_part("root").alias("part")))
            probed = may_match(held, "root", roots).select(*[F.lit(-1).alias(c) if c == "hi" else c for c in keys.columns])
            both = probed.union(keys)
            often = both.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
            pairs = stored(tree_pairs(both, self.threshold, often), "candidates")
        touched = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        old = self._read("entries", self.fields["entries"], touched.select(_part("cls").alias("part")))
        every = old.union(entries)
        near = compared(pairs, every, self.threshold)
        side = lambda p: every.select(F.col("cls").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("batch", "h", "lang", "ctx")])
        agree = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)).cast("int")
        near = stored(near, "near")
        every = may_match(every.drop("toks"), "cls", near.select(F.explode(F.array("a", "b"))))
        near = near.join(side("a"), "a").join(side("b"), "b")
        near = near.select("a", "b", "batch_a", "batch_b", "likeness", agree("h").alias("same_hash"), agree("lang").alias("same_lang"), agree("ctx").alias("same_context"), F.when(F.col("likeness") >= 0.95, 2).when(F.col("likeness") >= 0.88, 1).otherwise(0).alias("close"))
        near = stored(near, "compared")
        counted = [(tuple(r[f] for f in FIELDS), r["count"]) for r in near.groupBy(*FIELDS).count().collect()]
        weights, prior = learned_weights(counted)
        score = F.lit(prior)
        for f, w in zip(FIELDS, weights):
            score = score + F.array(*[F.lit(float(v)) for v in w])[F.col(f)]
        turned = F.col("batch_a") > F.col("batch_b")
        links = near.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("earlier"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("cls"), "likeness", score.alias("score"))
        best = links.groupBy("cls").agg(F.min("earlier").alias("match_id"), F.max("likeness").alias("likeness"), F.max("score").alias("score"))
        hits = entries.select("cls", *by).join(best, "cls")
        out = stored(rows.select("id", *by).join(hits.drop("cls"), by).where("match_id < id").select("id", "batch", "match_id", "likeness", "score").distinct(), "matches")
        self._accept(new_entries, new_keys, links)
        return out

    def _accept(self, entries: tuple[str, int], keys: tuple[str, int], links: DataFrame) -> None:
        known = self.reps()
        joined = links.join(known.select(F.col("node").alias("earlier"), F.col("root").alias("ra")), "earlier", "left").join(known.select(F.col("node").alias("cls"), F.col("root").alias("rb")), "cls", "left")
        moved = stored(connected_components(joined.select(F.coalesce("ra", "earlier").alias("a"), F.coalesce("rb", "cls").alias("b"))), "moved")
        # Only affected members are written: those of the representatives that moved, and the ends of the new links.
        old = known.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root").select("node", F.col("to").alias("root"))
        version = self.version + 1
        reps = self._write("reps", old.union(moved).distinct().withColumn("v", F.lit(version)), "node")
        for name, segment, key in (("entries", entries, "cls"), ("keys", keys, "root"), ("reps", reps, "node")):
            self._add(name, segment, key)
        self.version = version
        rows = [(version, name, p, n, self.fields[name]) for name, held in self.live.items() for p, n in held]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def reps(self) -> DataFrame:
        """(node, root): the representative of each clustered entry; a later row of a node replaces an earlier one."""
        return _newest(self._read("reps", REPS)).select("node", "root")


ARRIVALS = ("batch_no < 1", "batch_no >= 1")  # what p4_found hands over at a time; the rows don't depend on it


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path, out = table(spark, sf_dir, "translations"), new_path(spark, "history"), None
    for these in ARRIVALS:
        d = History(spark, path).link(t.where(these)).select(F.col("match_id").alias("id_a"), F.col("id").alias("id_b"))
        out = d if out is None else out.union(d)
    return out
