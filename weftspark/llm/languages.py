"""Languages of documents and of their sentences (problem 6).

For each language an interpolated Kneser-Ney model over four characters is estimated from the distinct texts of
all labelled rows, twice: the second time without the sentences that the first models contradict. Executors count the
n-grams; the driver gets each distinct one once, which an alphabet bounds, not the rows. All n-grams seen in any language are kept in one sorted array of hashes
with a column of log probabilities for each language, so that a text is scored for all
languages by one binary search per character; unseen n-grams are backed off exactly. Letters of no
known language are one more character, so they cost every model dearly. A sentence
gets the language with the lowest cross-entropy per character, or none if that exceeds the language's limit
(rejection) or if it has too few letters to tell.

Limit and confidence are calibrated on a fifth of the labelled texts, by hash, that the final models haven't seen. Their entropies are all
counted, in steps of 1/FINE nat. The limit lies above
all but REFUSED of a language's own held-out sentences, by half the narrowest gap that any model leaves between these and
all but REFUSED of the other languages' sentences. The confidence is the logistic of the lead
over the second-best language in nats, at the temperature under which the held-out sentences are likeliest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.plans.tables import stored, table

LANGS = ("ru", "en", "fr", "de")
HELD = 5  # one in so many labelled texts is held out
FEWEST = 50  # sentences of a language below which the held-out ones are learned too
FINE = 10_000  # steps of a nat in which entropies are counted
HEATS = np.geomspace(2, 60, 18)
LETTERS = 14  # a sentence with fewer letters has no language of its own
D = 0.75
REFUSED = 0.001  # share of a language's own sentences that rejection may cost, and of others' that it may let in, on held-out texts
# Codes that name a language.
CODES = {"rus": "ru", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de"}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäæçéèêëîïôöœùûüÿßñабвгдежзийклмнопрстуфхцчшщъыьэюяё’"
BASE = 128
_CODE = np.zeros(0x3000, "i4")
for _i, _c in enumerate(ALPHABET, 1):
    for _v in (_c, _c.upper()):
        if len(_v) == 1:
            _CODE[ord(_v)] = _i
_CODE[ord("'")] = _CODE[ord("’")]
OTHER = len(ALPHABET) + 1
_CODE[[i for i in range(0x3000) if not _CODE[i] and chr(i).isalpha() and chr(i) not in "ªº"]] = OTHER
_END = np.zeros(0x3000, bool)
_END[[ord(c) for c in ".!?…"]] = True
_UPPER = np.zeros(0x3000, bool)
_UPPER[[i for i in range(0x3000) if chr(i).isupper()] + [ord(c) for c in "«„“\"([—–-"]] = True
_BLANK = np.zeros(0x3000, bool)
_BLANK[[i for i in range(0x3000) if chr(i).isspace()]] = True
_CLOSE = np.zeros(0x3000, bool)
_CLOSE[[ord(c) for c in "»”“\")]’'"]] = True


def label_of(col: Column) -> Column:
    """The language code that a label names: case, region and three letters don't matter; else null."""
    c = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for kv in (CODES | {x: x for x in LANGS}).items() for x in kv])
    return F.element_at(known, c)


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts joined by newlines, and of each sentence the text, start and end.

    A sentence ends after . ! ? or … (and closing marks) when blanks and a capital, opening mark or
    newline follow, and at the end of a line.
    """
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "u4")
    small = np.where(cp < 0x3000, cp, 0).astype("i4")
    n = len(cp)
    line = cp == 10
    # The next character that is neither blank nor closing mark decides whether a stop ends a sentence.
    skip = _BLANK[small] | _CLOSE[small]
    nxt = np.where(~skip, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    after = np.append(nxt[1:], n)
    follow = np.where(after < n, small[np.minimum(after, n - 1)], 65)
    gap = np.zeros(n, bool)
    gap[:-1] = _BLANK[small[1:]] | _CLOSE[small[1:]]
    stop = _END[small] & gap & _UPPER[follow]
    # Closing marks stay with the sentence before them.
    at = np.flatnonzero(stop)
    if len(at):
        open_ = np.where(~_CLOSE[small], np.arange(n), n)
        open_ = np.minimum.accumulate(open_[::-1])[::-1]
        at = np.minimum(open_[np.minimum(at + 1, n - 1)], n) - 1
    ends = np.unique(np.concatenate([at + 1, np.flatnonzero(line) + 1]))
    starts = np.append(0, ends[:-1])
    lens = np.fromiter((len(t) + 1 for t in texts), "i8", len(texts))
    owner = np.searchsorted(np.cumsum(lens), starts, side="right")
    return cp, owner, starts, ends


def _codes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks, and where they stood."""
    c = np.where(cp < 0x3000, _CODE[np.where(cp < 0x3000, cp, 0)], np.where(cp < 0x10000, OTHER, 0))  # above: CJK and the like; emoji say nothing
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    at = np.flatnonzero(keep)
    return c[at], at


def _grams(c: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """The four characters that end at each; with ``text`` (to which text each belongs) those of another text count as blanks."""
    p = np.concatenate([np.zeros(3, "i4"), c])
    before = [p[:-3], p[1:-2], p[2:-1]]
    if text is not None:
        own = np.concatenate([np.full(3, -1), text])
        before = [np.where(own[k : k - 3] == text, x, 0) for k, x in enumerate(before)]
    return ((before[0] * BASE + before[1]) * BASE + before[2]) * BASE + c


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[i] == want, values[i], 0)


class KneserNey:
    """One language's model; ``prob`` is the interpolated probability of any n-gram's last character."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray | None = None):
        """``counts`` of ``grams``, if these are distinct and sorted; else each counts as one."""
        u, c = np.unique(grams, return_counts=True) if counts is None else (grams, counts)
        self.grams, self.context = {4: (u, c)}, {}
        for o in (4, 3, 2):
            u, c = self.grams[o]
            h, start = np.unique(u // BASE, return_index=True)
            self.context[o] = h, np.add.reduceat(c, start), np.diff(np.append(start, len(u)))
            self.grams[o - 1] = np.unique(u % BASE ** (o - 1), return_counts=True)
        self.total = self.grams[1][1].sum()

    def prob(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        if order == 1:
            return (_look(*self.grams[1], keys) + 0.5) / (self.total + 0.5 * len(ALPHABET))
        lower = self.prob(keys % BASE ** (order - 1), order - 1)
        h, tot, kinds = self.context[order]
        t, k = _look(h, tot, keys // BASE), _look(h, kinds, keys // BASE)
        c = _look(*self.grams[order], keys)
        return np.where(t > 0, (np.maximum(c - D, 0) + D * k * lower) / np.maximum(t, 1), lower)


class Models:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = [x for x in LANGS if x in counts and len(counts[x][0])]
        self.own = [KneserNey(*counts[x]) for x in self.langs]
        self.keys = np.unique(np.concatenate([m.grams[4][0] for m in self.own])) if self.own else np.zeros(1, "i4")
        self.logp = np.stack([np.log(m.prob(self.keys)) for m in self.own], 1).astype("f4") if self.own else np.zeros((1, 0), "f4")
        self.worst, self.heat = np.full(len(self.langs), np.inf), 5.0

    def calibrate(self, counted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], heats: np.ndarray) -> None:
        """``counted``: (0, j) of language j's own held-out sentences and (1, j) of others', sorted steps of entropy and how many;
        ``heats``: log likelihood of all at each of HEATS."""
        k = len(self.langs)

        def quantile(kind: int, j: int, q: float) -> float:
            steps, n = counted.get((kind, j), (np.zeros(0), np.zeros(0, "i8")))
            return (steps[np.searchsorted(np.cumsum(n), q * n.sum())] + 0.5) / FINE if n.sum() > 20 else np.inf

        own = [quantile(0, j, 1 - REFUSED) for j in range(k)]
        far = [f - own[j] for j in range(k) if np.isfinite(own[j]) and np.isfinite(f := quantile(1, j, REFUSED))]
        self.worst = np.array([o + max(0.0, 0.5 * min(far)) if far else o for o in own])
        if heats.any():
            self.heat = float(HEATS[np.argmax(heats)])

    def sure(self, nats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(nats, "f8") / self.heat, 0, 500)))

    def scan(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of each sentence: text, start, end (in the joined texts), letters, best (index or -1), entropy, margin."""
        cp, owner, start, end = cut(texts)
        c, at = _codes(cp)
        keys = _grams(c, owner[np.searchsorted(end, at, side="right")])
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        lp = self.logp[i]
        miss = self.keys[i] != keys
        if miss.any() and self.own:
            u, inv = np.unique(keys[miss], return_inverse=True)
            lp[miss] = np.stack([np.log(m.prob(u)) for m in self.own], 1).astype("f4")[inv]
        letter = c > 0
        place = np.searchsorted(at, start)
        sums = np.add.reduceat(np.concatenate([lp * letter[:, None], np.zeros((1, lp.shape[1]), "f4")]), place, axis=0)
        letters = np.add.reduceat(np.append(letter, False).astype("i8"), place)
        empty = np.append(place[1:], len(at)) == place
        letters[empty] = 0
        sums[empty] = 0
        per = -sums / np.maximum(letters, 1)[:, None]
        k = per.shape[1]
        order = np.argsort(per, axis=1) if k else np.zeros((len(per), 1), "i8")
        rows = np.arange(len(per))
        entropy = per[rows, order[:, 0]] if k else np.zeros(len(per))
        margin = per[rows, order[:, 1]] - entropy if k > 1 else np.full(len(per), 9.0)
        best = np.where((letters >= LETTERS) & (k > 0), order[:, 0], -1)
        if k:
            best = np.where((best >= 0) & (entropy <= self.worst[np.maximum(best, 0)]), best, -1)
        return {"text": owner, "start": start, "end": end, "letters": letters, "best": best, "entropy": entropy, "margin": margin, "per": per, "cp": cp}


def _told(first: Models, plain: np.ndarray, texts: list[str], j: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The scan of texts, and which sentences both the first models and the letters' frequencies give to the label j of their text.

    A model learns the sentences of other languages in its texts as well, since contexts of another script are theirs alone.
    How often each letter occurs tells them apart: they are few. So both speak when sentences are weeded out.
    """
    s = first.scan(texts)
    c, at = _codes(s["cp"])
    place = np.searchsorted(at, s["start"])
    flat = np.add.reduceat(np.concatenate([plain[:, c].T * (c > 0)[:, None], np.zeros((1, len(plain)))]), place, axis=0) / np.maximum(s["letters"], 1)[:, None]
    return s, (s["letters"] >= LETTERS) & ((s["per"] + flat).argmin(1) == j[s["text"]])


def _counted(keys: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]):
    """(k, n): how often ``keys`` of texts, labels and held gives each number; summed within a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, fresh, size = pd.Series(dtype="i8"), [], 0
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                p = pdf.iloc[at : at + 500]
                u, n = np.unique(keys(p["text"].to_list(), p["j"].to_numpy(), p["held"].to_numpy()), return_counts=True)
                fresh.append(pd.Series(n.astype("i8"), u))
                size += len(u)
                if size > 1_000_000:
                    sums, fresh, size = pd.concat([sums, *fresh]).groupby(level=0).sum(), [], 0
        sums = pd.concat([sums, *fresh]).groupby(level=0).sum()
        yield pd.DataFrame({"k": sums.index.to_numpy("i8"), "n": sums.to_numpy("i8")})

    return run


def _sums(d: DataFrame, keys) -> tuple[np.ndarray, np.ndarray]:
    rows = d.mapInPandas(_counted(keys), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    return rows["k"].to_numpy("i8"), rows["n"].to_numpy("i8")


GRAM = 32  # bits of a gram, or of a letter with the 30th set, below the label and whether it is held out
LETTER = 1 << 30


def _first_keys(texts: list[str], j: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Grams of all characters, and the letters of sentences that are long enough."""
    cp, owner, start, end = cut(texts)
    c, at = _codes(cp)
    row = np.searchsorted(end, at, side="right")
    label = j[owner[row]].astype("i8") << GRAM
    enough = (c > 0) & (np.bincount(row, c > 0, minlength=len(end)) >= LETTERS)[row]
    return np.concatenate([label | _grams(c, owner[row]), (label | LETTER | c)[enough]])


def _agreed_keys(shared):
    def run(texts: list[str], j: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Grams of the sentences that are their label's, and one LETTER for each of these."""
        s, ok = _told(*shared.value, texts, j)
        c, at = _codes(s["cp"])
        row = np.searchsorted(s["end"], at, side="right")
        label = (j[s["text"]].astype("i8") * 2 + held[s["text"]]) << GRAM
        return np.concatenate([(label[row] | _grams(c, row))[ok[row]], (label | LETTER)[ok]])

    return run


def _held_entropies(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(kind, j, k, n, v): entropies counted in steps k, or at kind 2 the log likelihood v at heat j."""
        first, plain, models = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                texts, j = pdf["text"].iloc[at : at + 500].to_list(), pdf["j"].iloc[at : at + 500].to_numpy()
                _, ok = _told(first, plain, texts, j)
                s = models.scan(texts)
                truth = np.array([models.langs.index(x) if x in models.langs else -1 for x in first.langs])[j[s["text"]]]
                ok &= truth >= 0
                per, best, truth = s["per"][ok], s["best"][ok], truth[ok]
                lead, right = (s["margin"] * s["letters"])[ok], best == truth
                p = 1 / (1 + np.exp(-np.clip(lead[:, None] / HEATS, 0, 500)))
                out = [pd.DataFrame({"kind": 2, "j": np.arange(len(HEATS)), "k": 0, "n": 0, "v": np.where(right[:, None], np.log(p), np.log1p(-np.minimum(p, 1 - 1e-12))).sum(0)})]
                for lang in range(len(models.langs)):
                    # The quick sentences of other languages that a mislabelled held-out text holds are no foreign ones: the best guess must agree.
                    for kind, mine in enumerate((truth == lang, truth != lang)):
                        u, n = np.unique((per[mine & right, lang] * FINE).astype("i8"), return_counts=True)
                        out.append(pd.DataFrame({"kind": kind, "j": lang, "k": u, "n": n, "v": 0.0}))
                yield pd.concat(out)

    return run


def fit(labelled: DataFrame) -> Models:
    """Models from (id, text, lang) rows with clean labels: all with an id are read, equal texts of a language once."""
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(LANGS) for x in (lang, i)])
    d = labelled.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(*LANGS)).select("text", number[F.col("lang")].alias("j")).distinct()
    d = stored(d.withColumn("held", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).cast("int")), "labelled")
    k, n = _sums(d, _first_keys)
    code, of = k & (LETTER - 1), k >> GRAM
    gram = (k & LETTER) == 0
    counts = {x: (code[gram & (of == i)].astype("i4"), n[gram & (of == i)]) for i, x in enumerate(LANGS)}
    first = Models(counts)
    if not first.langs:
        return first
    letters = np.full((len(first.langs), BASE), 0.5)
    for i, x in enumerate(first.langs):
        at = ~gram & (of == LANGS.index(x))
        letters[i, code[at]] += n[at]
    plain = -np.log(letters / letters.sum(1, keepdims=True))
    # From here on labels are places in first.langs.
    place = F.create_map(*[F.lit(v) for i, x in enumerate(first.langs) for v in (LANGS.index(x), i)])
    d = d.withColumn("j", place[F.col("j")])
    spread = d.sparkSession.sparkContext.broadcast
    k, n = _sums(d, _agreed_keys(spread((first, plain))))
    code, of, gram = k & (LETTER - 1), k >> GRAM, (k & LETTER) == 0
    counts = {}
    for i, x in enumerate(first.langs):
        few = n[~gram & (of >> 1 == i)].sum() < FEWEST
        at = gram & ((of >> 1 == i) if few else (of == 2 * i))
        u, inv = np.unique(code[at].astype("i4"), return_inverse=True)
        counts[x] = u, np.bincount(inv, n[at], minlength=len(u)).astype("i8")
    models = Models(counts)
    rows = d.where("held = 1").mapInPandas(_held_entropies(spread((first, plain, models))), "kind int, j int, k bigint, n bigint, v double").groupBy("kind", "j", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas().sort_values(["kind", "j", "k"])
    heats = rows[rows["kind"] == 2]
    models.calibrate({x: (g["k"].to_numpy(), g["n"].to_numpy()) for x, g in rows[rows["kind"] < 2].groupby(["kind", "j"])}, np.bincount(heats["j"].to_numpy("i8"), heats["v"].to_numpy("f8"), minlength=len(HEATS)))
    return models


def found_languages(models: Models, texts: list[str]) -> list[list[tuple[str, float]]]:
    """Of each text the languages of its sentences, by falling number of letters, with confidences."""
    s = models.scan(texts)
    out: list[dict[int, list[float]]] = [{} for _ in texts]
    ok = s["best"] >= 0
    for t, b, n, m in zip(s["text"][ok].tolist(), s["best"][ok].tolist(), s["letters"][ok].tolist(), s["margin"][ok].tolist()):
        if m * n >= 5:
            v = out[t].setdefault(b, [0, 0.0])
            v[0] += n
            v[1] += m * n
    res = []
    for v in out:
        res.append([(models.langs[b], float(models.sure(w[1]))) for b, w in sorted(v.items(), key=lambda kv: -kv[1][0])])
    return res


def _record_languages(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                langs = found_languages(shared.value, part["text"].to_list())
                rows = [(i, own, x, c, len(v)) for i, own, v in zip(part["id"], part["label"], langs) for x, c in v]
                yield pd.DataFrame(rows, columns=["id", "label", "lang", "confidence", "n_langs"])

    return run


def record_languages(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, lang, confidence, n_langs): a row for each language whose whole sentences a text holds.

    ``label`` is the code that the given label names, or null. Texts without a sentence of a known language, and
    null ids or texts, have no row. Without labelled rows there is no model and no row.
    """
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), label_of(F.col(label_col)).alias("label")).where("id IS NOT NULL AND text IS NOT NULL")
    shared = df.sparkSession.sparkContext.broadcast(fit(d.select("id", "text", F.col("label").alias("lang"))))
    return d.mapInPandas(_record_languages(shared), "id bigint, label string, lang string, confidence double, n_langs int").distinct()


def _segments(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            s = m.scan(pdf["text"].to_list())
            begin = np.append(0, np.cumsum([len(t) + 1 for t in pdf["text"]]))
            ok = s["best"] >= 0
            t = s["text"][ok]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[t], "start": (s["start"][ok] - begin[t]).astype("i4"), "end": (s["end"][ok] - begin[t]).astype("i4"), "lang": np.array([*m.langs, ""])[s["best"][ok]], "confidence": m.sure(s["margin"][ok] * s["letters"][ok])})

    return run


def language_segments(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, start, end, lang, confidence) of every sentence that has a language; offsets in code points."""
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), label_of(F.col(label_col)).alias("lang")).where("id IS NOT NULL AND text IS NOT NULL")
    shared = df.sparkSession.sparkContext.broadcast(fit(d.select("id", "text", "lang")))
    return d.select("id", "text").mapInPandas(_segments(shared), "id bigint, start int, end int, lang string, confidence double")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for tbl, text, label in (("knowledge", "content", "language"), ("translations", "source_text", "source_lang")):
        d = record_languages(table(spark, sf_dir, tbl), "id", text, label).where("label IS NULL OR label <> lang OR n_langs > 1")
        d = d.select(F.lit(tbl).alias("tbl"), F.col("id").alias("record_id"), "lang")
        out = d if out is None else out.union(d)
    return out


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "knowledge"), "id", "content", "language")
