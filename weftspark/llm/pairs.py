"""Defective prompt and response pairs (problem 7).

Each answer is put through, in this order: emptiness, a refusal grammar, greedy string tiling against the source,
the language models of its sentences against the target, and a truncation parser: a
pushdown automaton over fences, brackets, quotations, emphasis, markup and table rows tells what is left open;
the last word pair is looked up among word pairs that end sentences; sentence counts, lengths and
names or numbers of the source tell what is missing.

A refusal is a sentence, one of the first two, in which the speaker's inability or unwillingness meets the act that was
asked for (translating, helping, answering a request), a rule meets the text that breaks it, or a
plea meets the text to translate; a source that says the same itself makes its answer none.

Common words, sentence endings and length ratios are counted over all pairs by distributed aggregates; only the
language models are fitted on a bounded sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.languages import LETTERS, Models, fit, label_of
from weftspark.plans.tables import table

SHARE = 1_000  # a word is common if one in SHARE pairs has it; so a pair's words bound how many there are
RARE = 100_000  # a word pair is known to end sentences if it ends one in RARE of them; below that many all are
WORD = re.compile(r"[^\W_]+")
# The word classes of the refusal grammar, in en, fr, de, ru, es and it.
OPENING = r"(?:so |very |vraiment )?(?:sorry|unfortunately|apologi[sz]e|apologies|désolée?s?|excuses|malheureusement|tut mir leid|entschuldigung|bedaure|leider|к сожалению|увы|извините|простите|прошу прощения|lo siento|mi dispiace|purtroppo)"
MACHINE = r"(?:as an? (?:ai|(?:large )?language model|assistant)|en tant qu(?:e modèle|'ia|'assistant)|als (?:ki|sprachmodell|assistent)|как (?:ии|языковая модель|ассистент))"
UNABLE = (
    r"(?:\b(?:i|we)(?: am| are|'m|'re)? ?(?:cannot|can ?not|can't|could not|couldn't|won't|will not|would rather not|unable|not able|not allowed|not permitted|do not feel comfortable|don't feel comfortable|not comfortable|(?:must|have to) (?:decline|refuse)|decline|refuse)\b|\b(?:unable|not able|not possible|impossible) (?:for me )?to\b"
    r"|\b(?:je|nous) (?:ne |n')(?:peux|puis|pouvons|saurais|suis|sommes|veux)\b|\b(?:dois|devons) (?:refuser|décliner)\b|\bje (?:refuse|décline)\b|\bimpossible d(?:e |')|\bincapacité d(?:e |')|\bpas en mesure d(?:e |')"
    r"|\b(?:ich|wir) (?:kann|können|darf|dürfen|werde|möchte)\b.*\bnicht\b|\b(?:kann|darf|möchte) ich\b.*\bnicht\b|\bmuss\b.*\bablehnen\b|\bnicht (?:möglich|in der lage|imstande|gestattet)\b|\blehne\b.*\bab\b"
    r"|\bне (?:могу|можем|смогу|вправе|буду|имею права|в состоянии|готова?)\b|\bотказа(?:ть|ться)\b|\bотказываюсь\b|\bне (?:удаётся|удается|удалось|получается)\b|\bневозможно\b"
    r"|\bno (?:puedo|podemos)\b|\bnon (?:posso|possiamo)\b)"
)
ACT = r"(?:\btranslat\w*|\bhelp\b|\bassist\w*|\banswer\w*|\brespond\b|\bcomply\b|\bfulfil\w*|\b(?:this|that|your) request\b|\btradui\w+|\btraduction\b|\baider\b|\brépondre\b|\bdemande\b|\brequête\b|\bübersetz\w*|\bhelfen\b|\bweiterhelfen\b|\bbeantwort\w*|\banfrage\b|\bперевест\w+|\bперевод\w*|\bпомо(?:чь|гать)\b|\bответить\b|\bотвечать\b|\bзапрос\w*|\bпросьб\w*|\btraduc\w+|\bayudar\w*|\btradu\w+|\baiutar\w*)"
TEXT = r"(?:text|content|passage|sentence|source|request|texte|contenu|phrase|demande|inhalt|abschnitt|satz|anfrage|текст\w*|содержан\w+|фрагмент\w*|запрос\w*|материал\w*)"
BREACH = rf"\b{TEXT}\b.*(?:\bgoes? against\b|\bviolat\w+|\bcontrary to\b|\bcontraires? à|\benfrei\w+|\bva à l'encontre\b|\bviole\b|\bverstößt\b|\bwiderspricht\b|наруша\w+|противореч\w+).*(?:guideline|polic|rule|règle|politique|richtlinie|regel|правил|политик|услови)"
PLEA = rf"^(?=.*(?:\bplease\b|\bkindly\b|\bcould you\b|\bcan you\b|\bveuillez\b|\bmerci de\b|\bpourriez-vous\b|\bbitte\b|\bkönnten sie\b|\b(?:пришлите|предоставьте|отправьте|дайте|вставьте|укажите)\b))(?=.*(?:\bprovide\b|\bsend\b|\bshare\b|\bpaste\b|\bgive\b|\bsupply\b|\bfournir\b|\benvoyer\b|\btransmettre\b|\bcoller\b|\bsenden\b|\bschicken\b|\bgeben\b|\bbereitstellen\b|\beinfügen\b|\b(?:пришлите|предоставьте|отправьте|дайте|вставьте|укажите)\b))(?=.*\b{TEXT}\b)(?:.*(?:translat\w*|traduire|traduction|übersetz\w*|перев\w+)|.*\b{TEXT}$)"
UNABLE_, ACT_, BREACH_, PLEA_, OPENING_, MACHINE_ = (re.compile(x) for x in (UNABLE, ACT, BREACH, PLEA, OPENING, "^" + MACHINE))
ABORT = re.compile(rf"{OPENING}[^.!?]*{UNABLE}\W*$")
#: A cheap test that every refusal passes: one of the words without which none of the above can match.
MAYBE = re.compile(r"can'?t|cannot|can not|could|couldn|won't|will not|would rather|unable|able|allowed|permitted|comfortable|declin|refus|possible|impossible|peux|puis|pouv|saurais|suis|somm|veux|incapacit|mesure|nicht|ablehn|lehne|не |отказ|невозможно|puedo|podemos|posso|possiamo|against|violat|contra|enfrei|encontre|viole|verst|widersp|наруш|противореч|please|kindly|veuillez|merci|pourriez|bitte|könnten|пришлите|предоставьте|отправьте|дайте|вставьте|укажите|as an?|en tant|als|как ")
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“", "“": "”"}
CLOSERS = {v: k for k, v in PAIRS.items()} | {"”": "“"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}
TOKENS = re.compile(r"```|\*\*|</?[A-Za-z][^<>\n]*>|[()\[\]{}«»„“”\"]")
INVISIBLE = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x10000) if unicodedata.category(chr(i)) in ("Cf", "Cc") and not chr(i).isspace()) + "]")


def plain(text: str) -> str:
    return " ".join(INVISIBLE.sub("", text).replace("’", "'").split())


def refusal(text: str) -> bool:
    """Whether one of the first two sentences declines, or asks for the text."""
    low = text.lower()
    if not MAYBE.search(low):
        return False
    if MACHINE_.match(re.sub(r"^\W+", "", low)):
        return True
    for s in re.split(r"(?<=[.!?…])\s+", low.strip("[]()\"«»„“” "))[:2]:
        s = s.strip().rstrip(".!?…])»” ")
        if (UNABLE_.search(s) and ACT_.search(s)) or BREACH_.search(s) or PLEA_.search(s) or ABORT.search(s):
            return True
    return False


def tiled(a: list[str], b: list[str], least: int = 3) -> float:
    """Share of the longer word list that greedy string tiling covers with common runs of ``least`` words or more."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    ua, ub, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, tiles = least - 1, []
        starts: dict[tuple, list[int]] = {}
        for j in range(len(b) - least + 1):
            if not any(ub[j : j + least]):
                starts.setdefault(tuple(b[j : j + least]), []).append(j)
        for i in range(len(a) - least + 1):
            if any(ua[i : i + least]):
                continue
            for j in starts.get(tuple(a[i : i + least]), ()):
                k = least
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k > best:
                    best, tiles = k, [(i, j, k)]
                elif k == best:
                    tiles.append((i, j, k))
        if not tiles:
            return covered / max(len(a), len(b))
        for i, j, k in tiles:
            if not any(ua[i : i + k]) and not any(ub[j : j + k]):
                ua[i : i + k] = ub[j : j + k] = [True] * k
                covered += k


def left_open(text: str) -> list[str]:
    """What a pushdown parser still has on its stack at the end: fences, brackets, quotations, emphasis, markup, an empty list item, a cut table row.

    A closer pops what it closes and what was left open inside it; a closer without an opener is passed over.
    """
    stack: list[str] = []
    for m in TOKENS.finditer(text):
        t = m.group()
        if stack and stack[-1] == "```":
            if t == "```":
                stack.pop()
            continue
        if t == '"':
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if '"' in stack:
                del stack[stack.index('"') :]
            elif (not before or before.isspace() or before in "([{") and after.strip():
                stack.append('"')
        elif t in ("```", "**"):
            if t in stack:
                del stack[stack.index(t) :]
            else:
                stack.append(t)
        elif t[0] == "<":
            name = re.match(r"</?([A-Za-z][\w-]*)", t).group(1).lower()
            if t[1] == "/":
                if f"<{name}>" in stack:
                    del stack[stack.index(f"<{name}>") :]
            elif name not in VOID and not t.endswith("/>"):
                stack.append(f"<{name}>")
        elif t == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif t in PAIRS:
            stack.append(t)
        else:
            opener = CLOSERS[t]
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener) :]
            elif t == "”" and "„" in stack:
                del stack[stack.index("„") :]
    last = text.rstrip().rpartition("\n")[2].strip()
    if re.fullmatch(r"[-*•]|\d+[.)]", last) and "\n" in text.strip():
        stack.append("item")
    if last.startswith("|") and not last.endswith("|"):
        stack.append("row")
    return stack


def more_open(answer: str, source: str) -> bool:
    """Whether the answer leaves something open that the source doesn't leave open too."""
    mine = left_open(answer)
    return bool(mine) and bool(Counter(mine) - Counter(left_open(source)))


STOP = re.compile(r"[.!?…]+[»”“\")\]]*(?=\s+\D|\s*$)")
SHORT = re.compile(r"\b(?:env|ca|approx|прибл|nr|no|bzw|см|etc|z\. ?b)$")


def sentences(text: str) -> list[str]:
    """Sentences by stops before blanks and a capital (any letter in texts without capitals), and by blank lines."""
    anycase = text.lower() == text
    out, at = [], 0
    for m in STOP.finditer(text):
        nxt = text[m.end() : m.end() + 4].lstrip()
        first = next((c for c in nxt[:3] if c.isalpha()), "")
        if nxt and not anycase and not first.isupper():
            continue
        if SHORT.search(text[max(at, m.start() - 12) : m.start()].lower()):
            continue
        out.append(text[at : m.end()].strip())
        at = m.end()
    if text[at:].strip():
        out.append(text[at:].strip())
    return out


def ending(words: list[str], common: set[str]) -> tuple[str, str]:
    kind = lambda w: "0" if w[0].isdigit() else w if w in common else "@"
    return (kind(words[-2]) if len(words) > 1 else "", kind(words[-1])) if words else ("", "")


def counted_endings(answer: str, common: set[str], every: Counter, final: Counter) -> None:
    for x in sentences(plain(answer)):
        w = WORD.findall(x.lower())
        if w:
            k = ["0" if v[0].isdigit() else v if v in common else "@" for v in w]
            pairs = list(zip(["", *k], k))
            every.update(set(pairs))
            if x[-1] in ".!?)»”\"" and not x.endswith("..."):
                final[pairs[-1]] += 1


class Habits:
    """Counted over all pairs: common words, the share of a word pair's sentences that it ends, and length ratios."""

    def __init__(self, common: set[str], ends: dict[tuple[str, str], float], ratio: dict[tuple, float]):
        self.common, self.ends, self.ratio = common, ends, ratio

    def may_end(self, words: list[str]) -> float:
        """Share of the word pair's occurrences that end a sentence; 0 if hardly one does."""
        return self.ends.get(ending(words, self.common), 0.0)

    def anchors(self, words: list[str]) -> list[str]:
        """Names and numbers: words that a translation keeps."""
        return [w for w in words if w[0].isdigit() or len(w) > 2 and w not in self.common]


def truncated(source: str, answer: str, s: str, t: str, ws: list[str], wt: list[str], habits: Habits, a: str | None, b: str | None) -> bool:
    """``s``, ``t``: both texts plain; ``ws``, ``wt``: their words in lower case."""
    if more_open(answer.strip(), source):
        return True
    core = t.rstrip("»”“\"' ")
    if not core:
        return False
    if core[-1] in ",;:-–—(/&" or (core.endswith(("…", "...")) and not s.rstrip("»”“\"' ").endswith(("…", "..."))):
        return True
    ratio = habits.ratio.get((a, b), 1.0)
    whole = len(t) / max(1.0, ratio * len(s))
    if whole < 0.62:
        return True
    ss, st = sentences(s), sentences(t)
    have = Counter(habits.anchors(wt))

    def lacking(x: str) -> bool:
        """More than a third of the sentence's names and numbers are missing (one alone may be a misspelt word)."""
        kept = habits.anchors(WORD.findall(x.lower()))
        return sum(not have[w] for w in kept) * 3 > len(kept)

    if len(st) < len(ss):
        if whole < 0.9 and (lacking(ss[-1]) or not habits.anchors(WORD.findall(ss[-1].lower()))):
            return True
        if whole < 0.75:
            return True
    last = len(st[-1]) / max(1.0, ratio * len(ss[-1])) if len(st) == len(ss) and ss else 1.0
    if core[-1] in ".!?)":
        return last < 0.45 and lacking(ss[-1])
    if wt and wt[-1] not in habits.common and not wt[-1][0].isdigit():
        if wt[-1] not in ws or len(wt[-1]) < 3:
            return True
    elif wt and wt[-1][0].isdigit() and wt[-1] not in ws:
        return True
    ends = habits.may_end(wt)
    if ends < 0.2:  # more often inside a sentence: only complete if nothing else is missing
        return ends == 0 or last < 0.86 or lacking(ss[-1])
    return last < 0.72 or (lacking(ss[-1]) and last < 0.9)


def defects(models: Models, habits: Habits, pairs: list[tuple]) -> list[str | None]:
    """The first defect of each (source, answer, source language, target language), or None."""
    out: list[str | None] = [None] * len(pairs)
    check, kept = [], []
    for i, (s, t, _, _) in enumerate(pairs):
        if t is None or not any(c.isalnum() for c in t):
            out[i] = "empty"
            continue
        ps, pt = plain(s or ""), plain(t)
        if refusal(pt) and not refusal(ps):
            out[i] = "refusal"
            continue
        ws, wt = WORD.findall(ps.lower()), WORD.findall(pt.lower())
        letters = sum(len(w) for w in ws if w.isalpha() and len(w) > 1)
        if ws and (letters < LETTERS or (len(ws) < 12 and sum(w[0].isdigit() for w in ws) * 2 >= len(ws))):
            if wt != ws and len(wt) < len(ws) and ("".join(ws)).startswith("".join(wt)):
                out[i] = "truncated"
            continue
        if ws and (ws == wt or (len(set(ws) & set(wt)) * 2 >= len(set(ws)) and sum((Counter(ws) & Counter(wt)).values()) >= 0.6 * max(len(ws), len(wt)) and tiled(ws, wt) >= 0.8)):
            out[i] = "copy"
        else:
            check.append(i)
            kept.append((ps, pt, ws, wt))
    if check:
        s = models.scan([pairs[i][1] for i in check])
        ok = (s["best"] >= 0) & (s["margin"] * s["letters"] >= 5)
        foreign: set[int] = set()
        for k, b in zip(s["text"][ok].tolist(), s["best"][ok].tolist()):
            want = pairs[check[k]][3]
            if want is not None and models.langs[b] != want:
                foreign.add(k)
        for k, i in enumerate(check):
            src, t, a, b = pairs[i]
            if k in foreign:
                out[i] = "wrong_lang"
            elif truncated(src or "", t, *kept[k], habits, a, b):
                out[i] = "truncated"
    return out


def _rows(pdf: pd.DataFrame, *cols: str) -> Iterator[tuple]:
    return zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in cols))


def _judge(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, habits = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                p = pdf.iloc[at : at + 1000]
                got = defects(models, habits, list(_rows(p, "source", "answer", "a", "b")))
                yield pd.DataFrame([(i, d) for i, d in zip(p["id"], got) if d], columns=["id", "defect"])

    return run


def _endings(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for pdf in batches:
            every, final = Counter(), Counter()
            for t in pdf["answer"]:
                counted_endings(t, common, every, final)
            yield pd.DataFrame([(*k, n, final[k]) for k, n in every.items()], columns=["x", "y", "every", "final"])

    return run


def learned_habits(d: DataFrame) -> Habits:
    """From all rows (source, answer, a, b) that have both texts. What reaches the driver is bounded by SHARE, RARE and the language pairs."""
    full = d.where("source IS NOT NULL AND answer IS NOT NULL").select("source", "answer", "a", "b")
    word = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.concat_ws(" ", "source", "answer"), r"\p{Cf}+", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    ratio = (F.length("answer") / F.greatest(F.lit(1), F.length("source"))).alias("r")
    sizes = full.select("a", "b", ratio).groupBy("a", "b").agg(F.count("*").alias("n"), F.percentile_approx("r", 0.5, 1000).alias("r")).collect()
    n = sum(r["n"] for r in sizes)
    often = full.select(F.explode(word).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(3, n // SHARE))
    common = set(often.select("w").toPandas()["w"])
    shared = d.sparkSession.sparkContext.broadcast(common)
    ends = full.select("answer").mapInPandas(_endings(shared), "x string, y string, every bigint, final bigint")
    ends = ends.groupBy("x", "y").agg(F.sum("every").alias("every"), F.sum("final").alias("final")).where(F.col("final") >= max(1, n // RARE)).toPandas()
    return Habits(common, {(x, y): f / e for x, y, e, f in ends.itertuples(index=False)}, {(r["a"], r["b"]): r["r"] for r in sizes if r["n"] >= 20})


def defective_pairs(df: DataFrame, id_col: str, source_col: str, answer_col: str, source_lang: str, target_lang: str) -> DataFrame:
    """(id, defect): 'empty', 'refusal', 'copy', 'wrong_lang' or 'truncated', the first that fits.

    A null answer is empty; a null source can't be copied or missed, so only the answer's own form counts; an unknown target is
    never wrong. Null ids have no row; repeated rows count once. Long texts are judged whole.
    """
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.col(answer_col).alias("answer"), label_of(F.col(source_lang)).alias("a"), label_of(F.col(target_lang)).alias("b")).where("id IS NOT NULL")
    models = fit(d.select("id", F.col("source").alias("text"), F.col("a").alias("lang")))
    shared = df.sparkSession.sparkContext.broadcast((models, learned_habits(d)))
    return d.mapInPandas(_judge(shared), "id bigint, defect string").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "translations"), "id", "source_text", "translated_text", "source_lang", "target_lang")
