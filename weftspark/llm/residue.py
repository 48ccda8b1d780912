"""Template residue, filler, error pages and script notices (problem 10).

A text is cut into passages: its sentences and lines, and the delimited spans in it. Two multinomial
naive Bayes models, one for sentences and one for spans, are learned from positive and
unlabelled passages by expectation-maximization until no posterior moves. The positive class starts from
trusted passages: spans in the syntax of template languages, and sentences that are, word by word, a known error,
notice or filler phrase (``SEEDS``). The other passages of a record that trusted ones make up by a third or
more start as residue by that share, all others by the share of trusted passages among all. Trusted passages seed the models and do
nothing else: what a document is, the learned scores alone decide.

The models are fitted on a bounded sample, about ``SAMPLE`` documents drawn by id, and the seeds. Every document is then
scored whole.

A document is residue if one of its spans is an unfilled placeholder, or if passages that
read as filler, error or notice make up at least half of the words outside its headings.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.sampling import drawn
from weftspark.plans.tables import table

SAMPLE = 8_000  # documents that the models are fitted on
# The delimiters of template languages and mail merges, and words that ask to be filled in.
TRUSTED_SPAN = re.compile(
    r"^(?:\{\{.*\}\}|\$\{.*\}|<%.*%>|\{%.*%\}|%\(.*\)s|__\w+__|<<.*>>|\[\[.*\]\]|@@\w+@@|##\w+##|\*\|.*\|\*|%[^\W\d]\w+%|\$[^\W\d]\w*_\w+|([XxХх_?])\1{3,}|\{ ?[^\W\d_]{3,}(?:_[^\W\d_]+)* ?\}|<[^\W\d_]{3,}(?:[ _][^\W\d_]+)*>|\[[A-ZÀ-ÞА-ЯЁ_]{3,}\]"
    r"|[\[<{](?i:todo|tbd|insert|enter|your|fill in|votre|insérer|indiquer|ihr|bitte|ваш\w*|вставьте|укажите|введите)\b.*|[\[<{].*\b(?i:here|ici|einfügen|eintragen|сюда)[\]>}])$",
    re.S,
)
# Known phrases of error pages, script notices and filler; the status texts of HTTP among them.
SEEDS = """
bad request. unauthorized. forbidden. not found. page not found. access denied. request timeout. too many requests. internal server error. bad gateway. service unavailable. service temporarily unavailable. gateway timeout. fatal error. fatal error: uncaught exception in index php on line. fatal error: uncaught error in page php on line.
an error occurred. something went wrong. your session has expired. please try again later. could not connect to the database. the requested url was not found on this server. the page you are looking for could not be found. the page you were looking for does not exist. the address does not exist or has been moved. back to home.
requête incorrecte. accès refusé. accès interdit. page introuvable. page non trouvée. trop de requêtes. erreur interne du serveur. service indisponible. une erreur est survenue. votre session a expiré. veuillez réessayer plus tard. la page demandée n'existe pas. connexion à la base de données impossible. retour à l'accueil.
ungültige anfrage. zugriff verweigert. seite nicht gefunden. zu viele anfragen. interner serverfehler. dienst nicht verfügbar. ein fehler ist aufgetreten. ihre sitzung ist abgelaufen. bitte versuchen sie es später erneut. die angeforderte seite existiert nicht. keine verbindung zur datenbank. zur startseite.
неверный запрос. доступ запрещён. страница не найдена. слишком много запросов. внутренняя ошибка сервера. сервис недоступен. произошла ошибка. ваш сеанс истёк. попробуйте позже. запрошенная страница не существует. нет соединения с базой данных. вернуться на главную.
please enable javascript. you need to enable javascript to run this app. this page requires javascript. javascript is required to view this site. your browser does not support scripts. enable scripts and reload the page. please turn on javascript. this page does not work without javascript.
veuillez activer javascript. ce site nécessite javascript. votre navigateur ne prend pas en charge les scripts. activez les scripts puis rechargez la page. cette page ne fonctionne pas sans javascript.
bitte aktivieren sie javascript. diese seite benötigt javascript. ihr browser unterstützt keine skripte. erlauben sie skripte und laden sie die seite neu. ohne javascript funktioniert diese seite nicht.
включите javascript. для работы сайта нужен javascript. ваш браузер не поддерживает скрипты. разрешите выполнение скриптов и обновите страницу. без javascript страница не работает.
lorem ipsum dolor sit amet. consectetur adipiscing elit. sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam. quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident. sunt in culpa qui officia deserunt mollit anim id est laborum.
text goes here. your text here. content goes here. content coming soon. coming soon. under construction. sample text. sample paragraph. dummy text. placeholder text. this is placeholder text. insert text here. to be announced. blah blah blah. asdf asdf.
texte à venir. contenu à venir. votre texte ici. texte de remplissage. ceci est un faux texte. exemple de texte. exemple de paragraphe. bla bla bla. page en construction.
hier steht ihr text. inhalt folgt. blindtext. platzhaltertext. dies ist ein blindtext. beispieltext. beispielabsatz. seite im aufbau.
здесь будет текст. текст появится позже. здесь ваш текст. пример текста. пример абзаца. это текст рыба. тестовая запись. страница в разработке. бла бла бла.
"""
SPAN = re.compile(
    r"\{\{[^{}]*\}\}|\$\{[^{}]*\}|\{%[^{}]*%\}|<%[^<>]*%>|%\([^()]*\)s|<<[^<>]*>>|\[\[[^\[\]]*\]\]|\*\|[^|\n]*\|\*|\[[^\[\]]*\]|<[^<>\n]*>|\{[^{}\n]*\}|(?<!\w)%[^\W\d]\w*%(?!\w)|(?<![\w$])\$[^\W\d]\w+|(?<!\w)__[^\W_]+(?:_[^\W_]+)*__(?!\w)|(?<!\w)@@\w+@@|(?<!\w)##\w+##|(?<!\w)([XxХх_?])\1{3,}(?!\w)"
)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+|\d+")
OPENS = re.compile(r"[\[{<$%_@#*?]|(?<!\w)[XxХх]{4}")
EDGE = re.compile(r"^\W+|\W+s?$")


def plain(s: str) -> str:
    """The words of a sentence without a status code before them."""
    w = [x.lower() for x in WORD.findall(s)]
    while w and (w[0] in ("http", "error") and len(w) > 1 and w[1].isdigit() or w[0].isdigit()):
        w = w[1:]
    return " ".join(w)


_SEEDS = {plain(x): x.strip() for x in re.split(r"[.\n]", SEEDS) if x.strip()}


def trusted_sentence(s: str) -> bool:
    w = plain(s)
    return w in _SEEDS or w.startswith("lorem ipsum ")


def trusted_span(s: str) -> bool:
    return bool(TRUSTED_SPAN.match(s))


def spans(text: str) -> list[str]:
    """Delimited spans, and those inside them; a double delimiter is no span within a span."""
    out, at = [], 0
    for o in OPENS.finditer(text):
        if o.start() >= at and (m := SPAN.match(text, o.start())):
            s, at = m.group(), m.end()
            out.append(s)
            inner = s[1:-1]
            if s[0] in "[{<" and OPENS.search(inner) and inner[:1] not in "[{<%":
                out += spans(inner)
    return out


def span_features(s: str, again: bool = False) -> list[tuple[str, str | None]]:
    """Its shape (delimiter, and whether it holds digits, stops, one letter, one word, a name), and the beginnings of its words."""
    inner = EDGE.sub("", s)
    left = re.match(r"\W*", s).group().replace(" ", "")[:2] or ("_" if s[0] == "_" else "run" if len(set(s)) == 1 else "")
    letters = [c for c in inner if c.isalpha()]
    form = "few letters" if len(letters) < 3 else "capitals" if inner.upper() == inner else "name" if "_" in inner else "word" if re.fullmatch(r"[^\W\d_]+", inner) else "words"
    digits, stops = "digits" if any(c.isdigit() for c in inner) else "no digits", "stops" if re.search("[,.;*]", inner) else "no stops"
    return [(f"{left} {form} {digits} {stops}", form)] + [(f"w:{w.lower()[:4]}", None) for w in re.findall(r"[^\W\d_]+", inner)]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE.split(text) if s and s.strip()]


def sentence_features(s: str, again: bool = False) -> list[tuple[str, str | None]]:
    """Word pairs, edges included, each with the word to fall back on where the pair is rare; a status code at the beginning; whether the record says it three times or more."""
    found = WORD.findall(s)
    words = ["^", *["0" if w.isdigit() else w.lower() for w in found], "$"]
    out = [(f"{a} {b}", b if b != "$" else None) for a, b in zip(words, words[1:])]
    if any(re.fullmatch(r"[45]\d\d", w) for w in found[:2]):
        out.append(("status", None))
    if again:
        out.append(("again", None))
    return out


def heading(s: str) -> bool:
    return len(s) <= 60 and s[-1] not in ".!?…" and not re.search(r"[45]\d\d", s)


FEATURES = {"span": span_features, "sentence": sentence_features}
TRUSTED = {"span": trusted_span, "sentence": trusted_sentence}


def own_sentences(text: str) -> list[str]:
    every = sentences(text)
    return [s for s in every if not heading(s)] or every


def _score(passage: str, kind: str, model: dict, again: bool = False) -> float:
    """Log-odds that a passage is residue; features that the model has in neither form say nothing."""
    get = model["weights"].get
    total = model["prior"]
    for a, b in set(FEATURES[kind](passage, again)):
        w = get(a)
        total += w if w is not None else get(b, 0.0)
    return total


def _fit(kind: str, records: list[list[str]], tolerance: float = 1e-3, most: int = 500) -> dict:
    """Positive-unlabelled naive Bayes by EM over the passages of records: {prior, weights, rounds, change}.

    It ends when no passage's posterior changes by ``tolerance`` or more; ``most`` only stops a fit that goes round in
    circles (``change`` tells). Without any trusted passage the model calls nothing residue.
    """
    ids: dict[str | None, int] = {None: 0}
    feats, backs = array("i"), array("i")
    ptr, rec, size, sure = [0], [], [], []
    for r, passages in enumerate(records):
        said = Counter(passages)
        for p in passages:
            for x, y in set(FEATURES[kind](p, said[p] > 2)):
                feats.append(ids.setdefault(x, len(ids)))
                backs.append(ids.setdefault(y, len(ids)))
            ptr.append(len(feats))
            rec.append(r)
            size.append(len(WORD.findall(p)) or 1)
            sure.append(TRUSTED[kind](p))
    if not feats or not any(sure):
        return {"prior": -60.0, "weights": {}, "rounds": 0, "change": 0.0}
    f, back, rec, size, sure = np.frombuffer(feats, "i4"), np.frombuffer(backs, "i4"), np.array(rec), np.array(size, "f8"), np.array(sure)
    own = np.repeat(np.arange(len(rec), dtype="i4"), np.diff(ptr))
    counted = lambda x: np.bincount(f, x, minlength=len(ids)) + np.bincount(back, x, minlength=len(ids))
    all_ = counted(np.ones(len(f)))
    known = all_ >= 2
    known[0] = False
    used = np.where(known[f], f, back)
    whole = np.bincount(rec, size)
    share = lambda g: (np.bincount(rec, size * g, minlength=len(whole)) / np.maximum(whole, 1))[rec] if kind == "sentence" else np.ones(len(rec))
    part = share(sure * 1.0)
    sure &= part >= 0.3
    # An unlabelled passage isn't a real one yet: it begins at the share of trusted passages, in a trusted record at the record's own.
    g = np.where(sure, 1.0, np.where((part >= 0.3) & (kind == "sentence"), part, sure.mean()))
    for rounds in range(1, most + 1):
        pos = counted(g[own])
        a, b = g.sum() + 1, (1 - g).sum() + 1
        # Smoothed by the classes' shares, so that a feature that says nothing weighs nothing.
        w = np.log((pos + a / (a + b)) / a) - np.log((all_ - pos + b / (a + b)) / b)
        w[~known] = 0
        score = math.log(a / b) + np.bincount(own, w[used], minlength=len(rec))
        p = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        s = share(p)
        last, g = g, np.where(sure, 1.0, p * s)
        change = float(np.abs(g - last).max())
        if change < tolerance:
            break
    return {"prior": math.log(a / b), "weights": {k: float(w[i]) for k, i in ids.items() if known[i]}, "rounds": rounds, "change": change}


def fit(texts: list[str]) -> dict:
    """Both models from sample texts; the seeds are records of their own, twice each so that their words count."""
    seeds = [[s] for s in _SEEDS.values()] * 2
    return {"span": _fit("span", [spans(t) for t in texts]), "sentence": _fit("sentence", seeds + [own_sentences(t) for t in texts])}


def judged(text: str, models: dict) -> tuple[str, float] | None:
    """('placeholder', 1.0) or ('residue', share of words), or None for real content."""
    if any(_score(s, "span", models["span"]) > 0 for s in spans(text)):
        return "placeholder", 1.0
    own = own_sentences(text)
    size = [len(WORD.findall(s)) or 1 for s in own]
    total, bad, left, said = sum(size), 0, sum(size), Counter(own)
    for s, n in zip(own, size):
        if bad + left < 0.5 * total:
            break
        left -= n
        if _score(s, "sentence", models["sentence"], said[s] > 2) > 0:
            bad += n
    return ("residue", bad / total) if own and bad >= 0.5 * total else None


def _decide(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for pdf in batches:
            got = [(i, judged(t, models)) for i, t in zip(pdf["doc"], pdf["text"])]
            yield pd.DataFrame([(i, *r) for i, r in got if r], columns=["doc", "kind", "share"])

    return run


def residue(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, kind, share): documents with an unfilled placeholder, or that consist of filler, errors or notices.

    Null ids and null or blank texts are no case; repeated rows count once. An empty table gives an empty result.
    """
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    texts = drawn(d, "doc", ["text"], SAMPLE).select("text").distinct().toPandas()["text"].to_list()
    shared = docs.sparkSession.sparkContext.broadcast(fit(sorted(texts)))
    return d.mapInPandas(_decide(shared), f"doc {d.schema['doc'].dataType.simpleString()}, kind string, share double").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()
