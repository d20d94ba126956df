"""op3, op9: held-out accuracy, and defined results at the edges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nearwin.llm import langid, toxicity
from nearwin.llm.tables import table
from tests.conftest import DATA
from tests.llm import nasty

BIG = DATA.replace("sf0.001", "sf0.01")


def test_toxicity_on_held_out_labels(spark):
    got = toxicity.toxicity(table(spark, BIG, "documents"), table(spark, BIG, "labels"))
    assert got.count() == 1000
    marked = got.join(table(spark, BIG, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in marked)
    held = [r for r in marked if r["held_out"]]
    pairs = [(a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in held for b in held if a["toxic"] > b["toxic"]]
    assert sum(pairs) / len(pairs) > 0.8
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.9


def test_unseen_misspellings(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(40))
    texts = [plain() + (f" dreadful{rng.choice('abcdef')} horrid{rng.choice('abcdef')}" if i % 3 == 0 else "") for i in range(300)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)])
    found = model.scores([plain() + " dreadfulzz horridx" for _ in range(40)]) > 0.5
    clean = model.scores([plain() for _ in range(40)]) > 0.5
    assert "dreadfulzz" not in " ".join(texts) and sum(found) >= 24 and not any(clean)


def plain_subwords(text):
    """Runs of 3 to 6 characters of each word with an edge at either end, and the whole if longer, with repeats."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    out = []
    for w in (f" {w} " for w in words):
        out += [w[i : i + k] for k in range(3, 7) for i in range(len(w) - k + 1)] + [w] * (6 < len(w) <= 42)
    return out


def plain_bucket(gram):
    h = sum((ord(c) + 1) * pow(toxicity.BASE, i, 1 << 64) for i, c in enumerate(gram))
    return (h * toxicity.MIX % (1 << 64)) >> 44


def test_scores_against_brute_force():
    """Whole texts, longer than a slice, of words longer than a slice, with signs of many scripts."""
    rng = random.Random(4)
    alphabet = "abcXYZ äßÉ漢🙂_-.,\n09"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(30)]
    texts += [None, "", " .\n", "a", "ab", "x" * 39, "x" * 40, "x" * 41, "y" * 100, " ".join(rng.choice(texts) for _ in range(900)), "z" * (toxicity.SLICE + 50) + " end"]
    texts.append("q" * (toxicity.SLICE - 20) + " spansslices " + "r" * 10)
    values = np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32)
    got = toxicity.Toxicity(values, 0.25).scores(texts)
    for t, s in zip(texts, got, strict=True):
        grams = Counter(plain_subwords(t))
        z = 0.25 + sum(values[plain_bucket(g)] * n for g, n in grams.items()) / max(1, grams.total())
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-6
        assert sum(len(b[h]) for _, _, f in toxicity.subwords([t]) for h, b in f) == grams.total()


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    e, w, b = rng.normal(size=(9, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    docs = [(np.array([0, 2, 5]), np.array([0.5, 0.3, 0.2])), (np.array([2, 8]), np.array([0.9, 0.1])), (np.zeros(0, int), np.zeros(0))]
    y, weights = np.array([1, 0, 1]), np.array([2.0, 0.5, 1.0])
    loss = lambda: toxicity.gradients(e, w, b, docs, y, weights)[0]
    _, rows, de, dw, db = toxicity.gradients(e, w, b, docs, y, weights)
    whole = np.zeros_like(e)
    whole[rows] = de
    for x, g in ((e, whole), (w, dw), (b, db)):
        for at in np.ndindex(x.shape):
            was = x[at]
            x[at] = was + 1e-6
            up = loss()
            x[at] = was - 1e-6
            down = loss()
            x[at] = was
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_clean_only_keeps_what_is_scored_under_a_half(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    want = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("score < 0.5").collect()}
    assert sorted(r["doc_id"] for r in toxicity.clean_only(docs, labels).collect()) == sorted(want)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(1, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(nasty.frame(spark), labels).collect()
    assert len(got) == len(nasty.rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = toxicity.toxicity(nasty.frame(spark), labels.filter("doc_id < 0")).collect()
    assert all(r["score"] == 0 for r in none)
    assert toxicity.toxicity(nasty.frame(spark, []), labels).count() == 0
    assert toxicity.clean_only(nasty.frame(spark), labels).columns == nasty.frame(spark).columns


def test_langid_on_held_out_documents(spark):
    got = langid.language_of(table(spark, BIG, "documents"))
    held = got.filter("held_out").join(table(spark, BIG, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_langid_backs_off_for_unseen_words():
    model = langid.fit([("der hund und die katze ungeheuer", "de"), ("the dog and the cat thing", "en")] * 3)
    de = model.languages.index("de")
    assert "ungehalten" not in model.tables[0] and model.word("ungehalten").argmax() == de
    assert not model.word("漢").any()


def brute_language(rows, text):
    """The language by counts alone: known words, else the longest n-grams of which one is known, each by its log frequency."""
    languages = sorted({lang for _, lang in rows})
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" ")
    cut = lambda word, n: [word] if n == 0 else [x[i : i + n] for x in [f"<{word}>" if n > 1 else word] for i in range(len(x) - n + 1)]
    counts = {n: {lang: Counter(g for t, of in rows if of == lang for w in split(t) if w for g in cut(w, n)) for lang in languages} for n in range(5)}
    known = {n: {g for lang in languages for g in counts[n][lang] if sum(counts[n][x][g] for x in languages) >= 2} for n in range(5)}
    total = {n: {lang: sum(counts[n][lang][g] + 0.5 for g in known[n]) + 0.5 for lang in languages} for n in range(5)}

    def logs(n, g):
        row = [math.log((counts[n][lang][g] + 0.5) / total[n][lang]) for lang in languages]
        return [x - sum(row) / len(row) for x in row]

    sums = [0.0] * len(languages)
    for word in filter(None, split(text)):
        for n in (0, 4, 3, 2, 1):
            found = [logs(n, g) for g in cut(word, n) if g in known[n]]
            if found:
                sums = [s + sum(f[i] for f in found) / len(found) for i, s in enumerate(sums)]
                break
    top = max(sums)
    return languages[sums.index(top)], 1 / sum(math.exp(s - top) for s in sums)


def test_langid_backoff_against_counts():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    say = lambda letters: " ".join(word(letters) + rng.choice(["", ".", "7", "½", "_"]) for _ in range(rng.randrange(1, 25)))
    kinds = {"aa": "abcdeé", "bb": "cdefgh", "cc": "ghijaß漢"}
    rows = [(say(kinds[lang]), lang) for lang in kinds for _ in range(8)] + [(None, "aa"), ("", "bb")]
    model = langid.fit(rows)
    for text in [say(rng.choice([*kinds.values()])) for _ in range(60)] + ["zzz qq", "a½b", "É"]:
        total = sum(model.word(w) for w in langid.letters(text))
        p = np.exp(total - total.max())
        lang, score = brute_language(rows, text)
        assert p[model.languages.index(lang)] == 1 and abs(1 / p.sum() - score) < 1e-9


def test_numbers_are_no_letters(spark):
    got = langid.language_of(nasty.docs(spark, ["½ ² ④", "a½", "Ⅷ", "plain words", "other words"] * 4, lang=["aa", "bb", "aa", "bb", "aa"] * 4)).collect()
    assert {r["doc_id"] % 5 for r in got if r["lang_pred"] == "und"} == {0, 2}


def test_langid_edges(spark):
    got = langid.language_of(nasty.frame(spark)).collect()
    assert len(got) == len(nasty.rows())
    texts = {r[0]: r[1] for r in nasty.rows()}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        if r["doc_id"] is not None and not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert langid.language_of(nasty.frame(spark, [])).count() == 0
    unlabelled = nasty.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_of(unlabelled).collect()} == {"und"}
