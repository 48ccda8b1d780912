"""Mixing sources to target shares of tokens (problem 9).

Documents get a soft membership in the target sources: their own label where it names one
(spelling variants folded), else the posterior of a naive Bayes classifier fitted on a bounded sample
of the labelled table. Rates r_d, between 0 and the cap, are fitted by projected-gradient
least squares so that the expected token totals match the targets: with the multipliers
``lam`` of the sources, r_d is the projection of <membership_d, lam> on [0, cap_d], and lam
follows the negative gradient of the squared misfit, each round a distributed aggregate over membership
profiles. Rates become whole numbers of uses by systematic sampling in salted
strata ordered by size, which keeps every source's tokens within about one document of
its expectation in each stratum.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.llm.sampling import drawn
from weftspark.plans.tables import stored, table

# Fixed value: the published splitting expression of this vocabulary.
SPLITTER = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAMPLE = 400  # labelled documents of each source that the classifier is fitted on
STRATUM = 20_000  # documents of a salted stratum


@lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession, path: str):
    """A vocabulary file (base64 token, rank) read on the driver and broadcast, about a megabyte: executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_counts(df: DataFrame, text: str, tokenizer: str, out: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text``; null counts 0."""
    ranks = vocabulary(df.sparkSession, tokenizer)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(ranks.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return df.withColumn(out, count(F.col(text)))


def folded(source: Column) -> Column:
    """One spelling of a source name: case, outer blanks, and hyphens or blanks for underscores don't matter."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def _features(text: str | None, lang: str | None, section: str | None) -> list[str]:
    return [f"lang={lang}", f"section={section}", *{w for w in re.findall(r"[^\W\d_]{3,}", (text or "").lower())}]


class Domains:
    """Multinomial naive Bayes over words, language and section type."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.names = sorted({r[0] for r in rows})
        counts = {n: Counter() for n in self.names}
        for s, t, lang, sec in rows:
            counts[s].update(_features(t, lang, sec))
        seen = Counter()
        for c in counts.values():
            seen.update(c)
        self.index = {w: i for i, w in enumerate(w for w, n in seen.items() if n >= 5)}
        self.logp = np.zeros((len(self.names), len(self.index)))
        for k, n in enumerate(self.names):
            v = np.array([counts[n][w] for w in self.index], "f8") + 0.5
            self.logp[k] = np.log(v / v.sum())

    def posterior(self, text, lang, section) -> np.ndarray:
        at = [self.index[f] for f in _features(text, lang, section) if f in self.index]
        s = self.logp[:, at].sum(1) / max(1.0, math.sqrt(len(at)))  # words are not independent
        e = np.exp(s - s.max())
        return e / e.sum()


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", section: str = "section_type", total_tokens: float | None = None, min_posterior: float = 0.0, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: doc_id, source, copies (1 to the source's max_repeats), tokens. shares: a row for each
    target: source, target_share, actual_share, tokens, records, uses, fitted_share.

    Without ``total_tokens`` the mixture is the largest in which every source that has text can give
    its share. A target without text gets 0 and the rest keep their proportions.
    Documents of sources that are no target, of null id or with empty text are not chosen; unlabelled ones belong to all sources
    by their posteriors (in hundredths), to none if the largest is below ``min_posterior``; a repeated id counts once.
    The fit ends when every source is within a millionth of the total of its target, or when a round brings no more.
    """
    spark = docs.sparkSession
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy(folded(F.col("source")).alias("s")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("double").alias("cap"))
    goal = {r["s"]: (r["share"], r["cap"]) for r in t.orderBy("s").collect()}
    names = sorted(goal)
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), folded(F.col(source)).alias("s"), F.col(lang).alias("lang"), F.col(section).alias("section")).where("doc IS NOT NULL AND text <> ''")
    d = d.withColumn("known", F.coalesce(F.col("s") != "", F.lit(False)))
    labelled = d.where(F.col("s").isin(names)) if names else d.limit(0)
    sample = drawn(labelled.select("doc", "s", "text", "lang", "section"), "doc", ["text"], SAMPLE, F.col("s")).toPandas().sort_values(["s", "text"])
    ranks = vocabulary(spark, tokenizer)
    shared = spark.sparkContext.broadcast(Domains(list(sample.itertuples(index=False, name=None))) if len(sample) else None)

    def member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, model = _encoding(ranks.value), shared.value
        for pdf in batches:
            out = []
            for doc, txt, s, la, sec, known in pdf.itertuples(index=False):
                if known:
                    names_, p = [s], [1.0]
                else:
                    post = model.posterior(txt, la, sec) if model else np.zeros(0)
                    if not len(post) or post.max() < min_posterior:
                        continue
                    at = np.flatnonzero(post >= 0.005)
                    p = np.round(post[at] / post[at].sum(), 2).tolist()
                    names_ = [model.names[i] for i in at]
                out.append((doc, names_, p, len(enc.encode_ordinary(txt)), names_[int(np.argmax(p))]))
            yield pd.DataFrame(out, columns=["doc", "names", "p", "tokens", "source"])

    kind = d.schema["doc"].dataType.simpleString()
    use = d.where(~F.col("known") | F.col("s").isin(names)).select("doc", "text", "s", "lang", "section", "known") if names else d.limit(0).select("doc", "text", "s", "lang", "section", "known")
    m = use.mapInPandas(member, f"doc {kind}, names array<string>, p array<double>, tokens int, source string").where("tokens > 0")
    members = stored(m, "members")
    profiles = stored(members.groupBy("names", "p", "source").agg(F.sum("tokens").cast("double").alias("tokens")), "profiles")
    have = {r["source"]: r["tokens"] for r in profiles.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    live = [n for n in names if have.get(n)]
    scale = sum(goal[n][0] for n in live)
    total = total_tokens or (min(goal[n][1] * have[n] / (goal[n][0] / scale) for n in live) if live else 0.0)
    want = {n: total * goal[n][0] / scale for n in live}
    lam = {n: 0.0 for n in live}
    number = lambda v: F.create_map(*[F.lit(x) for kv in v.items() for x in kv])
    cap = number({n: goal[n][1] for n in live}) if live else None

    def rate() -> Column:
        lams = number(lam)
        dot = F.aggregate(F.zip_with("names", "p", lambda n, p: F.coalesce(lams[n], F.lit(0.0)) * p), F.lit(0.0), lambda a, x: a + x)
        return F.least(F.greatest(dot, F.lit(0.0)), cap[F.col("source")])

    fitted: dict[str, float] = {}
    before = math.inf
    for _ in range(rounds if live else 0):
        now = profiles.select((F.col("tokens") * rate()).alias("x"), "tokens", F.explode(F.map_from_arrays("names", "p")).alias("s", "p")).groupBy("s").agg(F.sum(F.col("x") * F.col("p")).alias("have"), F.sum(F.col("tokens") * F.col("p") * F.col("p")).alias("curve"))
        got = {r["s"]: (r["have"], r["curve"]) for r in now.collect()}
        fitted = {n: got[n][0] for n in live}
        miss = max(abs(fitted[n] - want[n]) for n in live)
        if miss <= 1e-6 * total or miss >= before * 0.999:
            break
        before = miss
        for n in live:
            lam[n] -= (fitted[n] - want[n]) / got[n][1]
    chosen = members.withColumn("rate", rate() if live else F.lit(0.0))
    strata = max(1, members.count() // STRATUM)
    w = Window.partitionBy("source", F.pmod(F.xxhash64("doc"), F.lit(strata))).orderBy("tokens", "doc")
    part = F.col("rate") - F.floor("rate")
    run = F.round(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)
    chosen = chosen.withColumn("part", part).withColumn("run", run)
    start = F.pmod(F.xxhash64("source"), F.lit(1000)) / 1000.0
    chosen = chosen.withColumn("copies", (F.floor("rate") + F.floor(F.col("run") + start) - F.floor(F.round(F.col("run") - F.col("part"), 9) + start)).cast("int"))
    chosen = stored(chosen.where("copies > 0").select(F.col("doc").alias("doc_id"), "source", "copies", "tokens").dropDuplicates(["doc_id"]), "chosen")
    sums = chosen.groupBy("source").agg(F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count("*").alias("records"), F.sum("copies").alias("uses"))
    everything = sums.agg(F.sum("tokens")).first()[0] or 1
    rows = [(n, float(goal[n][0]), float(fitted.get(n, 0.0) / total) if total else 0.0) for n in names]
    base = spark.createDataFrame(rows, "source string, target_share double, fitted_share double")
    shares = base.join(sums, "source", "left").select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(everything)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("uses", F.lit(0)).alias("uses"), "fitted_share")
    return chosen, shares


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # the registered queries' parameter


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)[1]
