from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from weftspark.llm import bags, incremental, languages, leaks, lookalike, mixing, near_dups, pairs, pieces, residue, vectors
from weftspark.plans.tables import table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def likeness(a, b):
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def near_of(texts, least=12):
    """All pairs of ids with likeness of at least 0.8, by brute force."""
    w = [(i, words(t)) for i, t in texts if i is not None and len(words(t)) >= least]
    return {(min(i, j), max(i, j)) for n, (i, a) in enumerate(w) for j, b in w[:n] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and likeness(a, b) >= 0.8 - 1e-9}


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def variants():
    out = [(1, " ".join(BASE)), (2, " ".join(reversed(BASE))), (3, " ".join(BASE[:-1] + ["other"])), (4, " ".join(BASE[:12])), (5, " ".join(BASE[:11])), (6, None), (None, " ".join(BASE)), (7, ""), (8, "word " * 15), (9, "word " * 12), (10, "word " * 20), (1, " ".join(BASE)), (11, " ".join(BASE[3:] + ["p", "q", "r"])), (12, " ".join(BASE[4:] + ["p", "q", "r", "s"]))]
    return out


# Problem 1


def cosines(ids, v):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return s


def test_similar_vectors_recall(spark, data):
    got = {(a, b) for _, a, b in rows(vectors.p1_found(spark, data).where("tbl = 'translations'"))}
    t = table(spark, data, "translations").select("id", "embedding").toPandas()
    ok = [(i, np.array(x, "f8")) for i, x in zip(t["id"], t["embedding"]) if x is not None and len(x) == 64 and np.isfinite(np.array(x, "f8")).all() and np.any(np.array(x))]
    ids, s = [i for i, _ in ok], cosines(None, np.stack([x for _, x in ok]))
    want = {tuple(sorted((ids[r], ids[c]))) for r in range(len(ids)) for c in np.argsort(-s[r])[:5] if s[r, c] >= 0.9}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) == 0


def test_similar_vectors_edge_cases(spark):
    one, two = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    near = [0.999, 0.02] + [0.0] * 62
    data = [(i, one) for i in range(1, 9)] + [(20, near), (30, two), (40, None), (41, [0.0] * 64), (42, [float("nan")] * 64), (43, [1.0] * 32), (None, one), (1, one)]
    d = spark.createDataFrame([(i, v, "x", 3) for i, v in data], "id int, embedding array<float>, same string, rank int")
    got = rows(vectors.similar_vectors(d, "id", "embedding", min_cosine=0.9).select("id", "other", "rank"))
    per = defaultdict(list)
    for i, o, r in sorted(got, key=lambda x: (x[0], x[2])):
        per[i].append(o)
    assert per[1] == [2, 3, 4, 5, 6] and per[8] == [1, 2, 3, 4, 5] and per[20] == [1, 2, 3, 4, 5] and set(per) == {*range(1, 9), 20}
    assert rows(vectors.similar_vectors(d.limit(0), "id", "embedding")) == []


def test_similar_vectors_in_one_dense_group(spark, monkeypatch):
    # One cluster of unequal vectors (median cosine about 0.975) beside unrelated ones; several blocks.
    monkeypatch.setattr(vectors, "BLOCK", 1500)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal(64) + 0.16 * rng.standard_normal((4000, 64)), rng.standard_normal((500, 64))]).astype("f4")
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, embedding array<float>")
    got = {(r.id, r.other) for r in vectors.similar_vectors(d, "id", "embedding", min_cosine=0.9).collect()}
    s = cosines(None, v.astype("f8"))
    want = {(r, int(c)) for r in range(len(v)) for c in np.argsort(-s[r])[:5] if s[r, c] >= 0.9}
    assert len(want) == 20_000 and len(got & want) >= 0.999 * len(want)


# Problems 2 and 4


def test_near_groups_edge_cases(spark):
    d = spark.createDataFrame([(i, t, "c", 5, "b") for i, t in variants()], "id int, text string, cls string, n int, bag string")
    parent = {i: i for i, _ in variants() if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(near_of({i: t for i, t in variants() if i is not None}.items())):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    sizes = Counter(find(i) for i in parent)
    want = sorted((find(i), i) for i in parent if sizes[find(i)] > 1)
    assert rows(near_dups.near_duplicate_groups(d, "id", "text")) == sorted(want, key=repr)
    assert rows(near_dups.near_duplicate_groups(d.limit(0), "id", "text")) == []


def test_near_groups_match_brute_force(spark, data):
    got = {(a, b) for t, a, b in rows(near_dups.p2_found(spark, data)) if t == "translations"}
    t = table(spark, data, "translations").select("id", "source_text").toPandas()
    near = near_of(zip(t["id"], t["source_text"]))
    parent = {i: i for i in t["id"]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    assert got == {(find(i), i) for i in parent if find(i) != i}


def test_hot_roots_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join([f"w{j}" for j in range(16)] + [f"x{i % 9}", f"y{rng.integers(40)}", f"z{rng.integers(40)}", f"v{i}"])) for i in range(90)]
    monkeypatch.setattr(bags, "HOT", 8)
    d = spark.createDataFrame(texts, "id bigint, t string")
    r = bags.bag_rows(d, "id", "t")
    classes = r.select(F.col("id").alias("cls"), "n", "toks", F.lit(0).alias("route"), F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    classes.write.mode("overwrite").parquet(p := str(spark.sparkContext.getConf().get("spark.checkpoint.dir")) + "/hot")
    got = {(a, b) for a, b, _ in rows(bags.near_pairs(spark.read.parquet(p), 0.8))}
    assert got == near_of(texts)


def history(spark, data):
    return table(spark, data, "translations")


def test_batches_singly_or_together(spark, data):
    t = history(spark, data)
    one = incremental.History(spark)
    singly = []
    for b in (0, 1, 2, 3):
        singly += rows(one.link(t.where(F.col("batch_no") == b)).select("match_id", "id"))
    two = incremental.History(spark)
    two.link(t.where("batch_no = 0"))
    together = rows(two.link(t.where("batch_no BETWEEN 1 AND 3")).select("match_id", "id"))
    p = t.where("batch_no <= 3").select("id", "batch_no", "target_lang", "source_text").toPandas().set_index("id")
    want = defaultdict(set)
    for a, b in near_of(zip(p.index, p["source_text"])):
        if p.target_lang[a] == p.target_lang[b] and p.batch_no[a] != p.batch_no[b]:
            x, y = (a, b) if p.batch_no[a] < p.batch_no[b] else (b, a)
            want[y].add(x)
    want = sorted(((min(v), k) for k, v in want.items() if min(v) < k), key=repr)
    assert sorted(singly, key=repr) == want and together == want
    a, b = dict(rows(one.reps())), dict(rows(two.reps()))
    assert a == b and all(r <= n for n, r in a.items())


def test_history_is_reopened_and_stays_small(spark, data, monkeypatch):
    monkeypatch.setattr(incremental, "PARTS", 4)
    t = history(spark, data).where("id <= 250")
    path = incremental.new_path(spark, "reopened")
    got, plans = [], []
    for b in range(9):
        h = incremental.History(spark, path)  # as a new session would
        d = h.link(t.where(F.col("batch_no") == b))
        got += rows(d.select("match_id", "id"))
        plans.append(max(len(v) for v in h.live.values()))
    together = incremental.History(spark)
    want = rows(together.link(t).select("match_id", "id"))
    assert sorted(got, key=repr) == want and len(want) > 5
    assert max(plans) <= 5 and dict(rows(incremental.History(spark, path).reps())) == dict(rows(together.reps()))


def test_batches_edge_cases(spark):
    text = " ".join(BASE)
    data = [(1, 0, "en", text), (2, 1, "en", text), (3, 1, "fr", text), (4, None, "en", text), (5, 2, None, text), (6, 2, "en", None), (None, 2, "en", text), (7, 2, "en", "short text"), (8, 2, "en", text), (8, 2, "en", text)]
    d = spark.createDataFrame([(*r, None, None, None, 1) for r in data], "id int, batch_no int, target_lang string, source_text string, hash string, source_lang string, context string, cls int")
    h = incremental.History(spark)
    assert rows(h.link(d).select("match_id", "id")) == [(1, 2), (1, 8)]
    assert rows(h.link(d.limit(0)).select("match_id", "id")) == []


# Problem 3


def test_lookalikes(spark):
    base = "нить Кедуто, 2 вм. лиц."
    texts = {1: base, 2: base.replace("о", "o"), 3: base.replace(" ", " "), 4: "﻿" + base + "  ", 5: base.upper(), 6: base.replace("2", "２"), 7: base.replace("-", " ") + "!", 8: None, 9: "", 10: "​", 11: "café", 12: "café", 13: "cafe", 14: "й", 15: "й", 16: "ёж", 17: "еж", 18: base, 19: "ﬁl", 20: "fil", 23: "ɡɑuɡe", 24: "gauge", 25: "Ⅷ", 26: "VIII", 21: "x" * 5000, 22: "х" * 5000}
    d = spark.createDataFrame([(i, t, "r", "f") for i, t in texts.items()] + [(1, base, "r", "f"), (None, base, "r", "f")], "entry_id int, ru string, raw string, form string")
    same = [[1, 2, 3, 4, 6, 18], [11, 12], [14, 15], [19, 20], [21, 22], [23, 24], [25, 26]]
    want = sorted({(a, b) for g in same for a in g for b in g if a < b and texts[a] != texts[b]}, key=repr)
    assert rows(lookalike.look_same(d, "entry_id", "ru")) == want
    assert rows(lookalike.look_same(d.limit(0), "entry_id", "ru")) == []


def test_trie_budget():
    t = lookalike.Trie()
    for w in ("gauge", "gusset"):
        t.add(w)
    assert t.near("gаuge") == {"gauge": 0} and t.near("guage") == {} and t.near("gauges", 1) == {"gauge": 1}


# Problem 5


def test_split_and_faults(spark):
    text = "Intro\n\n" + " ".join(f"Sentence number {i} goes on a little." for i in range(40)) + "\n\n" + "x" * 700 + "\n\nEnd 🧶."
    d = spark.createDataFrame([("a", text, 200, 30, 1), ("b", "short", 200, 30, 1), ("c", None, 200, 30, 1), ("d", "  \n ", 200, 30, 1), ("e", text, None, 30, 1), ("a", text, 200, 30, 1), (None, text, 200, 30, 1)], "source_id string, content string, m int, o int, piece int")
    for size in (50, 10_000):
        got = pieces.split(d, "source_id", "content", "m", "o", size).toPandas().sort_values(["source", "piece"])
        assert set(got["source"]) == {"a", "b"}
        a = got[got["source"] == "a"]
        assert "".join("".join(a["text"]).split()) == "".join(text.split()) and a["text"].str.len().max() <= 200
        assert (a["prefix_context"].str.len() <= 30).all() and (a["prefix_context"].str.len() == a["overlap_with_prev"]).all()
        for p, q in zip(a["text"], a["prefix_context"][1:]):
            assert p.endswith(q)
    sections = spark.createDataFrame([("a", text, "x"), ("z", None, "x")], "source_id string, content string, preset string")
    presets = spark.createDataFrame([("x", 200, 30)], "preset string, max_chars int, overlap_chars int")
    c = pieces.split(d.where("source_id = 'a'"), "source_id", "content", "m", "o").select(F.col("source").alias("source_id"), F.col("piece").alias("chunk_id"), "text", "prefix_context", "suffix_context", "overlap_with_prev", "overlap_with_next", F.lit("clash").alias("at"))
    assert [r for r in rows(pieces.chunk_faults(c.union(c), sections, presets)) if r[2] != "bad_cut"] == []
    worse = c.withColumn("prefix_context", F.when(F.col("chunk_id") == 2, "nothing").otherwise(F.col("prefix_context")))
    assert ("a", 2, "overlap") in rows(pieces.chunk_faults(worse, sections, presets))
    assert rows(pieces.chunk_faults(c.limit(0), sections, presets)) == []


def test_bad_cuts(spark):
    content = "One sentence here. Another one follows and ends. " + "long " * 60 + "end. Last one."
    parts = ["One sentence", "here. Another one follows and ends.", ("long " * 30).strip(), ("long " * 30).strip() + " e", "nd.", "Last one."]
    chunks = [("s", i, p, "", "", 0, 0) for i, p in enumerate(parts)]
    c = spark.createDataFrame(chunks, "source_id string, chunk_id int, text string, prefix_context string, suffix_context string, overlap_with_prev int, overlap_with_next int")
    s = spark.createDataFrame([("s", content, "p")], "source_id string, content string, preset string")
    p = spark.createDataFrame([("p", 200, 20)], "preset string, max_chars int, overlap_chars int")
    got = {(i, d) for _, i, d in rows(pieces.chunk_faults(c, s, p)) if d != "overlap"}
    assert got == {(0, "bad_cut"), (3, "bad_cut")}


def test_file_ranges(spark, tmp_path):
    text = ("Ein Satz über Wolle. " * 50 + "\n\n") * 8
    (tmp_path / "f.txt").write_text(text, encoding="utf-8")
    r = pieces.file_ranges(spark, [str(tmp_path / "f.txt")], size=997, halo=64)
    assert "".join(x["body"] for x in r.orderBy("r").collect()) == text
    small, big = pieces.boundary_table(r), pieces.boundary_table(pieces.file_ranges(spark, [str(tmp_path / "f.txt")], size=1 << 20))
    assert rows(small.select("at", "kind").where("kind <> 'blank'")) == rows(big.select("at", "kind").where("kind <> 'blank'"))


def test_split_files_over_several_ranges(spark, tmp_path):
    text = ("Ein Satz über Wolle 🧶. Noch einer für die Masche. " * 12 + "\n\n") * 6 + "x" * 900 + " Ende."
    path, empty = f"file:{tmp_path}/f.txt", f"file:{tmp_path}/e.txt"
    (tmp_path / "f.txt").write_text(text, encoding="utf-8")
    (tmp_path / "e.txt").write_text("", encoding="utf-8")
    d = spark.createDataFrame([(path, text, 300, 40)], "source string, content string, m int, o int")
    want = rows(pieces.split(d, "source", "content", "m", "o"))
    got = rows(pieces.split_files(spark, [path, empty], 300, 40, size=997, halo=1300))
    assert len(got) > 10 and got == want


# Problem 6


def test_languages(spark, data):
    k = table(spark, data, "knowledge").select("id", "content", "language").where("language IN ('ru', 'en', 'fr', 'de')")
    extra = spark.createDataFrame([(9001, None, "ru"), (9002, "", "ru"), (9003, "Sepugu 63 / 70 × 63, № 504", None), (None, "text", "en"), (9004, "Knit the sleeve until the piece measures ten centimetres. Den Ärmel stricken, bis die Breite zehn Zentimeter erreicht.", "EN-gb"), (9005, "«петля» " + "word and stitch and yarn and needle with the sleeve again. " * 200, "eng")], "id bigint, content string, language string")
    got = languages.record_languages(k.union(extra).withColumn("lang", F.lit("clash")), "id", "content", "language").toPandas()
    mine = got[got["id"] >= 9000]
    assert sorted(zip(mine["id"], mine["lang"])) == [(9004, "de"), (9004, "en"), (9005, "en")] and set(mine["label"]) == {"en"}
    assert ((got["confidence"] > 0) & (got["confidence"] <= 1)).all()
    one = got[got["n_langs"] == 1]
    assert (one["label"] == one["lang"]).mean() > 0.9
    assert rows(languages.record_languages(k.limit(0), "id", "content", "language")) == []


def test_unknown_languages_are_rejected(spark, data):
    k = table(spark, data.replace("0.001", "0.01"), "knowledge").select("id", F.col("content").alias("text"), languages.label_of(F.col("language")).alias("lang"))
    m = languages.fit(k)
    s = m.scan(["Українська мова є державною мовою і належить до слов'янської групи її носіїв.", "Българският език е индоевропейски език от групата на южнославянските езици."])
    assert (s["best"] == -1).all()


def test_models_count_every_labelled_text(spark):
    """F8: 2,000 labelled texts, each more than once, a rare word in few: all that aren't held out are learned, equal ones once."""
    texts = [f"The sleeve and the band are {'zqzq' if i % 400 == 0 else 'joined'} with the long thread number {i}." for i in range(2000)]
    d = spark.createDataFrame([(i, texts[i % 2000], "en") for i in range(4500)] + [(None, "The zqzq of no id is not learned at all here.", "en")], "id bigint, text string, lang string")
    held = {r["text"]: r["h"] for r in d.where("id IS NOT NULL").select("text", (F.pmod(F.xxhash64("text"), F.lit(languages.HELD)) == 0).alias("h")).distinct().collect()}
    m = languages.fit(d)

    def count(gram):
        u, c = m.own[0].grams[4]
        at = np.flatnonzero(u == languages._grams(languages._codes(np.frombuffer(gram.encode("utf-32-le"), "u4"))[0])[-1])
        return int(c[at].sum())

    assert m.langs == ["en"] and len(held) == 2000 and any(held.values())
    assert count("slee") == sum(not h for h in held.values())
    assert count("zqzq") == sum(not h for t, h in held.items() if "zqzq" in t)
    # What a text before it ends with plays no role for a text's sentences.
    long = lambda x: x["per"][x["letters"] >= languages.LETTERS]
    one = np.concatenate([long(m.scan(["Knit x", t])) for t in texts[1:4]])
    assert len(one) == 3 and np.allclose(one, long(m.scan(texts[1:4])), atol=1e-5)


def test_kneser_ney_sums_to_one():
    codes, _ = languages._codes(np.frombuffer(("knit one purl two " * 30).encode("utf-32-le"), "u4"))
    m = languages.KneserNey(languages._grams(codes))
    h = int(languages._grams(codes)[10]) // languages.BASE * languages.BASE
    every = np.arange(h, h + len(languages.ALPHABET) + 2)
    assert abs(m.prob(every).sum() - 1) < 0.02


# Problem 7


def test_pair_defects(spark, data):
    t = table(spark, data, "translations").select("id", "source_text", "translated_text", "source_lang", "target_lang")
    src = "Нитью Tavubo провязать карман из пряжи Gimuto по линии сгиба, чтобы избежать дыр. Жилет Bugofu выглядит одинаково с двух сторон, когда образец уже отдохнул."
    good = "With the Tavubo strand, knit the pocket in Gimuto yarn along the fold line so that no holes appear. The Bugofu vest looks the same from both sides, once the swatch has rested."
    cases = [(9001, src, None, "empty"), (9002, src, " ​…", "empty"), (9003, src, "I'm sorry, but I can't translate this text.", "refusal"), (9004, src, "Je dois refuser cette traduction.", "refusal"), (9005, src, src.upper().replace(",", ""), "copy"), (9006, src, good, None), (9007, src, good[:-1], None), (9008, src, good[:75], "truncated"), (9009, src, good.split(". ")[0] + ".", "truncated"), (9010, src, good.split(". ")[0] + ". Der Pullover sieht von beiden Seiten gleich aus, sobald die Maschenprobe geruht hat.", "wrong_lang"), (9011, "Sepugu 63 / 70 × 63, № 504", "Sepugu 63 / 70 × 63, № 504", None), (9012, None, good, None)]
    extra = spark.createDataFrame([(i, s, a, "ru", "en") for i, s, a, _ in cases] + [(None, src, None, "ru", "en")], t.schema)
    got = dict(rows(pairs.defective_pairs(t.union(extra).withColumn("defect", F.lit(1)), "id", "source_text", "translated_text", "source_lang", "target_lang").where("id > 9000")))
    assert got == {i: d for i, _, _, d in cases if d}
    assert rows(pairs.defective_pairs(t.limit(0), "id", "source_text", "translated_text", "source_lang", "target_lang")) == []


def test_refusals_and_what_only_sounds_like_one():
    for x in ("I cannot recommend this yarn enough for the cuffs.", "I won't use acrylic for the cuffs.", "Ich kann den Ärmel in Runden stricken.", "Я не буду вязать рукав отдельно.", "Please send the finished swatch to the mill before you order.", "Bitte den Text der Anleitung beachten."):
        assert not pairs.refusal(x), x
    for x in ("Es ist mir nicht möglich, das zu übersetzen.", "I do not feel comfortable with this request.", "Désolé, impossible de traduire.", "Je suis dans l'incapacité de répondre.", "Пришлите, пожалуйста, текст для перевода.", "Unfortunately, I can't."):
        assert pairs.refusal(x), x
    assert pairs.left_open("<p>Knit the <b>row") == ["<p>", "<b>"] and pairs.left_open('He said "knit') == ['"'] and pairs.left_open("| a | b |\n| c") == ["row"] and pairs.left_open('5" wide "x"') == []
    assert pairs.more_open("neck <b> not (counted", "neck <b> not counted") and not pairs.more_open("neck <b> not counted", "col <b> non")


def test_parser_and_tiling():
    assert pairs.left_open("a (b [c]") == ["("] and pairs.left_open("„x“ «y»") == [] and pairs.left_open("```\n(") == ["```"]
    a = "one two three four five six".split()
    assert pairs.tiled(a, a) == 1 and pairs.tiled(a, a[3:] + a[:3]) == 1 and pairs.tiled(a, list("xyz")) == 0


# Problem 8


def test_phrase_leaks(spark):
    p = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, p), (2, "too short"), (3, None), (None, p), (1, p)], "item_id int, passage string")
    w = p.split()
    docs = [(1, "Start. " + ", ".join(w[5:17]).upper() + " end"), (2, " ".join(w[5:16])), (3, None), (4, ""), (5, " ".join(w[:12]) + " gap " + " ".join(w[12:30])), (None, p), (6, "the the " * 3000 + p), (1, "Start. " + ", ".join(w[5:17]).upper() + " end"), (7, " ".join("w­" + x[1:] for x in w[:13]))]
    d = spark.createDataFrame([(i, t, 1, "t") for i, t in docs], "doc_id int, text string, item int, term string")
    assert rows(leaks.phrase_leaks(d, "doc_id", "text", items, "item_id", "passage")) == [(1, 1, 12), (5, 1, 18), (6, 1, 30), (7, 1, 13)]
    assert rows(leaks.phrase_leaks(d.limit(0), "doc_id", "text", items, "item_id", "passage")) == []
    near = spark.createDataFrame([(8, " ".join(w[:6] + ["odd"] + w[6:14]))], "doc_id int, text string")
    assert rows(leaks.phrase_leaks(near, "doc_id", "text", items, "item_id", "passage")) == []


# Problem 9


def test_mix(spark, data):
    data = data.replace("0.001", "0.01")
    docs, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    chosen, shares = mixing.mix(docs.withColumn("tokens", F.lit(0)), targets, mixing.TOKENIZER)
    cap = {r["source"]: r["max_repeats"] for r in targets.collect()}
    c = chosen.toPandas()
    assert (c["copies"] >= 1).all() and all(n <= cap[s] for s, n in zip(c["source"], c["copies"])) and c["doc_id"].is_unique
    s = shares.toPandas().set_index("source")
    live = s[s["tokens"] > 0]
    assert ((live["actual_share"] - live["target_share"] / live["target_share"].sum()).abs() < 0.01).all() and set(s.index) == set(cap)
    empty, none = mixing.mix(docs.limit(0), targets, mixing.TOKENIZER)
    assert rows(empty) == [] and {r["actual_share"] for r in none.collect()} == {0.0}


def test_mix_large_sample_is_close(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("yarn"), (F.col("id") % 17 + 3).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "A-b ").when(F.col("id") % 3 == 1, "c").otherwise("unasked").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("section_type"))
    t = spark.createDataFrame([("a_b", 0.75, 2), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixing.mix(d, t, mixing.TOKENIZER)[1].collect()}
    assert abs(shares["a_b"]["actual_share"] - 0.75) < 0.005 and shares["a_b"]["uses"] == 2 * shares["a_b"]["records"]


# Problem 10


def test_residue(spark, data):
    d = table(spark, data, "documents").select("doc_id", "text")
    cases = [(90001, "The Sepugu hat {{ stitch_count }} looks lovely in two colours.", True), (90002, "404 Page not found", True), (90003, "Please enable JavaScript to view this page.", True), (90004, None, False), (90005, "", False), (90006, "Row 3: k39, *yo, k2tog; rep from * to last 20 sts, p27. Rnd 61: [p20, {k2, yo} 47 times] to marker. Neck opening <b> not counted, over the knots until the colour changes.", False), (90007, "Lorem ipsum dolor sit amet. Lorem ipsum dolor sit.", True), (90008, "On the back, join the shoulder slopes at the elbow so that the strand does not sag. " * 300, False)]
    cases += [(90009, "Access denied is the motto on the front. Knit it in intarsia.", False), (90010, "404 stitches were cast on for the blanket, worked in stocking stitch until it measures 50 cm.", False), (90011, "Dear *|FNAME|*, your shawl is ready.", True), (90012, "the page you were looking for could not be located on this server", True), (90013, "Work the [repeat] twice, then [rep] to the end.", False), (90014, "On the back, cast on XXXX stitches with the main colour.", True), (90015, "A swatch that reads lorem ipsum in one corner was knitted, so we took it off.", False)]
    extra = spark.createDataFrame([(i, t) for i, t, _ in cases] + [(None, "{{ x }}"), (90001, cases[0][1])], "doc_id bigint, text string")
    got = {r[0] for r in residue.residue(d.union(extra).withColumn("kind", F.lit("c")), "doc_id", "text").select("doc").collect() if r[0] > 90000}
    assert got == {i for i, _, bad in cases if bad}
    assert rows(residue.residue(d.limit(0), "doc_id", "text")) == []


def test_residue_em_converges():
    # Each filler shares words with the one before only: the seeds' knowledge has to travel along the chain.
    line = [a + b for a in "bcdfgh" for b in "aeiouy"]
    w = lambda k: " ".join(line[4 * k : 4 * k + 12])
    chain = [f"lorem ipsum {w(0)}." for _ in range(20)] + [f"{w(k)}." for k in range(1, 6) for _ in range(8)]
    real = [f"knit row number again with {'abcdefg'[i % 7] * 4} yarn {'hijklmnop'[i % 9] * 3}." for i in range(1500)]
    model = residue._fit("sentence", [[s] for s in chain + real])
    assert [residue._score(s, "sentence", model) > 0 for s in chain] == [True] * len(chain) and model["change"] < 1e-3 and model["rounds"] > 2
    assert not any(residue._score(s, "sentence", model) > 0 for s in real)


def test_every_query_is_registered(spark):
    from weftspark.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} | {"p9_mix"} <= set(queries.queries())


def test_mass_of_near_copies_stays_linear(spark):
    common = [f"c{j}" for j in range(40)]
    texts = [(i, " ".join(common + [f"v{i}"])) for i in range(1500)] + [(5000, "nothing alike " * 10)]
    d = spark.createDataFrame(texts, "id bigint, t string")
    g = near_dups.near_duplicate_groups(d, "id", "t")
    assert {r[0] for r in g.select("group_id").distinct().collect()} == {0} and g.count() == 1500
    r = bags.bag_rows(d, "id", "t").select(F.col("id").alias("cls"), "n", "toks", F.lit(0).alias("route"), F.lit(0).alias("lo"), F.lit(1).alias("hi"), F.lit(7).cast("bigint").alias("comp"))
    p = str(spark.sparkContext.getConf().get("spark.checkpoint.dir")) + "/mass"
    r.write.mode("overwrite").parquet(p)
    assert bags.near_pairs(spark.read.parquet(p), 0.8).count() == 0
    assert bags.star_links(spark.read.parquet(p), 0.8).count() < 8 * 1500


def test_walk_of_a_common_root_expands_few_pairs(monkeypatch):
    """below one root 3,000 bags with a word in common: the pairs are those of brute force, and entries are not spelled out pair by pair."""
    rng = np.random.default_rng(3)
    sets = [rng.choice(4000, rng.integers(50, 70), replace=False) for _ in range(2900)]
    for s in sets[:100]:  # near copies: some words fewer, some others instead
        s = s[: len(s) - rng.integers(0, 4)].copy()
        s[: rng.integers(0, 12)] += 4000
        sets.append(s)
    m, thr = len(sets), 0.8
    n = np.array([len(s) for s in sets], "i4")
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    row, v = np.repeat(np.arange(m), n), np.concatenate(sets).astype("u4")
    bits = bags._bitmaps(row, v, m)
    spelled = 0
    plain = bags._expand

    def counted(*a):
        nonlocal spelled
        x, y = plain(*a)
        spelled += len(x)
        return x, y

    monkeypatch.setattr(bags, "_expand", counted)
    cls = np.arange(m)
    zero, one = np.zeros(m, "i4"), np.ones(m, "i4")
    a, b = bags._walk(np.ones(m, "i8"), np.zeros(m, "i1"), cls, n, zero, zero, one, cls, bits, thr)
    got = set(zip(a.tolist(), b.tolist()))
    member = np.zeros((m, 8000), "f4")
    member[row, v] = 1
    common = member @ member.T
    x, y = np.nonzero(np.triu(common >= thr * np.maximum(n[:, None], n[None, :]) - 1e-6, 1))
    near = set(zip(x.tolist(), y.tolist()))
    assert len(near) >= 50 and near <= got
    both = np.bitwise_count(bits[a] & bits[b]).sum(1)
    slack = n - np.bitwise_count(bits).sum(1)
    assert (both + np.minimum(slack[a], slack[b]) >= np.ceil(thr * np.maximum(n[a], n[b]) - 1e-9)).all()
    assert spelled < m * m // 20
