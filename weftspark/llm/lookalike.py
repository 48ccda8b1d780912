"""One form for texts that look the same (problem 3).

Every token of a column is looked up in a trie of the column's vocabulary by an edit
automaton in which look-alikes, widths and composed or combining accents cost nothing and ignorable
characters are passed over at no cost; anything else costs 1 each. With the default budget
of 0 only spellings that look the same are reached. The canonical spelling is the most
frequent one reached that is written in one script without ignorables (ties: the smallest); a
token that reaches none is normalized by the tables. Tries are built by the token's route, an
invariant of how it looks, so that spellings that look the same meet in one trie.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.plans.tables import stored, table

# Letters of other scripts and the Latin letters that they look like.
LOOK = dict(zip("авекмнорстухіјѕһԁԛԝаАВЕКМНОРСТУХІЈЅԌԚԜ", "aвeкмнopcтyxijshdqwaABEKMHOPCTYXIJSGQW"))
LOOK |= dict(zip("ονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ovpcjABEZHIKMNOPTYXC"))
LOOK |= dict(zip("ɡɑᴏᴠᴡꜱᴢᴄυօոսհցՕՍ", "gaovwszcuonuhgOU"))
LOOK |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LOOK |= {"‐": "-", "‑": "-", "⁃": "-", "˗": "-"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
LOOK = {k: v for k, v in LOOK.items() if k != v}
SAME: dict[str, str] = {}
for _k, _v in LOOK.items():
    SAME[_v] = SAME.get(_v, _v) + _k
SAME |= {k: SAME[v] for k, v in LOOK.items()}


def ignorable(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") and not c.isspace() or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️"


def folded(c: str) -> str:
    """Ligatures, width forms, letters in mathematical styles and Roman numerals as the letters that one sees."""
    return LIGATURES.get(c) or (unicodedata.normalize("NFKC", c) if "＀" <= c <= "￯" or "Ⅰ" <= c <= "ⅿ" or "\U0001d400" <= c <= "\U0001d7ff" else c)


def opened(token: str) -> str:
    """The token without ignorables, folded, accents apart."""
    return unicodedata.normalize("NFD", "".join(folded(c) for c in token if not ignorable(c)))


def tokens(text: str) -> list[str]:
    """Pieces between blanks of any width, without pieces that only hold ignorables."""
    return [t for t in "".join(" " if c.isspace() or unicodedata.category(c) == "Zs" else c for c in text).split(" ") if any(not ignorable(c) for c in t)]


def by_table(token: str) -> str:
    return unicodedata.normalize("NFC", "".join(LOOK.get(c, c) for c in opened(token)))


def route(token: str) -> str:
    o = opened(token)
    return "".join(LOOK.get(c, c) for c in o[:6]) + str(len(o))


def clean(token: str) -> bool:
    """Written in one script, composed, without ignorables: fit to be a canonical spelling."""
    if unicodedata.normalize("NFC", opened(token)) != token:
        return False
    return len({unicodedata.name(c, "?").split(" ")[0] for c in token if c.isalpha()}) <= 1


class Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in opened(word):
            node = node.setdefault(c, {})
        node.setdefault("", []).append(word)

    def near(self, token: str, budget: int = 0) -> dict[str, int]:
        """Vocabulary words within ``budget`` paid edits of ``token``, with their costs."""
        text = opened(token)
        found: dict[str, int] = {}
        todo, seen = [(self.root, 0, 0)], {}
        while todo:
            node, i, cost = todo.pop()
            if seen.get((id(node), i), budget + 1) <= cost:
                continue
            seen[id(node), i] = cost
            if i == len(text):
                for w in node.get("", ()):
                    found[w] = min(cost, found.get(w, cost))
            else:
                for c in SAME.get(text[i], text[i]):
                    if c in node:
                        todo.append((node[c], i + 1, cost))
            if cost < budget:
                if i < len(text):
                    todo.append((node, i + 1, cost + 1))
                for c, child in node.items():
                    if c:
                        todo.append((child, i, cost + 1))
                        if i < len(text):
                            todo.append((child, i + 1, cost + 1))
        return found


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(r, k, t, route(t)) for r in pdf["raw"] for k, t in enumerate(tokens(r))]
        yield pd.DataFrame(out, columns=["raw", "at", "token", "route"])


def _spell(often: dict[str, int]) -> list[tuple[str, str]]:
    trie = Trie()
    for t in often:
        if clean(t):
            trie.add(t)
    out = []
    for t in often:
        near = trie.near(t)
        out.append((t, min(near, key=lambda w: (near[w], -often[w], w)) if near else by_table(t)))
    return out


def _spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One trie for each route; rows come sorted by route, so only the route at hand is held."""
    route_, often = None, {}
    for pdf in batches:
        out = []
        for r, t, n in zip(pdf["route"], pdf["token"], pdf["often"]):
            if r != route_:
                out += _spell(often)
                route_, often = r, {}
            often[t] = n
        yield pd.DataFrame(out, columns=["token", "spelling"])
    yield pd.DataFrame(_spell(often), columns=["token", "spelling"])


def visual_forms(texts: DataFrame) -> DataFrame:
    """(raw, form) of each distinct text of column ``raw``: forms are equal where texts look the same.

    Null texts have no row; a text of blanks and ignorables only has the form ''. Works on
    distinct texts and distinct tokens, so copies cost nothing beyond a partial aggregate.
    """
    raws = texts.select("raw").where("raw IS NOT NULL").distinct()
    parts = stored(raws.mapInPandas(_tokens, "raw string, at int, token string, route string"), "tokens")
    spelt = parts.select("route", "token").groupBy("route", "token").agg(F.count("*").alias("often")).repartition("route").sortWithinPartitions("route").mapInPandas(_spellings, "token string, spelling string")
    forms = parts.join(stored(spelt, "spellings"), "token").groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spelling"))), lambda x: x["spelling"]), " ").alias("form"))
    return raws.join(forms, "raw", "left").select("raw", F.coalesce("form", F.lit("")).alias("form"))


def look_same(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same but differ in their characters.

    Variants are paired first and rows joined to them, so copies of one spelling are never
    compared with each other. Null ids and texts are in no pair; texts without visible characters are not compared.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("raw")).where("id IS NOT NULL AND raw IS NOT NULL").distinct()
    v = stored(visual_forms(rows).where("form <> ''"), "forms")
    pairs = v.select("form", F.col("raw").alias("p")).join(v.select("form", F.col("raw").alias("q")), "form").where("p < q").select("p", "q")
    left, right = rows.select(F.col("id").alias("x"), F.col("raw").alias("p")), rows.select(F.col("id").alias("y"), F.col("raw").alias("q"))
    return pairs.join(left, "p").join(right, "q").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, out = table(spark, sf_dir, "glossary"), None
    for field in ("ru", "en", "fr"):
        d = look_same(g, "entry_id", field).select(F.lit(field).alias("field"), "id_a", "id_b")
        out = d if out is None else out.union(d)
    return out
