"""Small tables that hold nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket int, row string, at long, fp string, score double, part string, doc string, taken long, __score double, __text string, __slot long, __at long, given string, removed int, cut string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[1], texts[1] + " tail", "", "   \n\t ", None, "é" * 7, "漢字 かな 🙂 \u0000x", "one", words(rng, 20_000)]
    out = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s1", "s1", "s2", None, "Ö"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], None, "s2", 3), (None, None, None, None, None), (7, "other text of a used id", "aa", "s1", 23)]
    return [(*r, "x", 1, "r", 2, "f", 0.5, "p", "d", 9, 0.25, "t", 3, 4, "g", 5, "c") for r in out]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def docs(spark, texts, **columns):
    """doc_id from 0 and text, with lang and source null unless given as lists."""
    lang, source = columns.get("lang", [None] * len(texts)), columns.get("source", [None] * len(texts))
    return spark.createDataFrame([(i, t, a, b, None if t is None else len(t)) for i, (t, a, b) in enumerate(zip(texts, lang, source, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
