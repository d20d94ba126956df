"""Language identification by known words, with a backoff to character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.llm.words import Kept
from nearwin.plans.shared import small_batches

#: Runs of word characters without decimal digits and underscores: letters, and rarely numbers such as fractions.
RUNS = re.compile(r"[^\W\d_]+")
#: Bound of the sample of labelled documents that a model is learned from, whole texts.
SAMPLE = 3_000
LONGEST, SHORTEST, SEEN = 4, 1, 2
#: Words summed at a time.
SLICE = 1 << 16


def letters(text: str | None) -> list[str]:
    """The runs of letters (characters for which ``isalpha`` holds) of a text in lower case."""
    found = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for word in found for alpha, run in groupby(word, str.isalpha) if alpha]


def grams(word: str, n: int) -> list[str]:
    """Runs of n characters, with the word's edges marked; single characters without marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Backoff:
    """Per-language log frequencies of words, and of character n-grams of each length with word edges marked.

    ``tables[0]`` is for words, ``tables[n]`` for n-grams of n characters; a row holds one value a language.
    """

    languages: list[str]
    tables: dict[int, dict[str, np.ndarray]]

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean over its longest n-grams of which any is known; else zeros."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, SHORTEST - 1, -1):
            of = self.tables[n]
            found = [of[g] for g in grams(word, n) if g in of]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))


def log_frequencies(counts: dict[str, Counter], languages: list[str], least: int = 1) -> dict[str, np.ndarray]:
    """Log relative frequency by language of what is seen ``least`` times in all, with add-half smoothing."""
    keys = [k for k, n in sum(counts.values(), Counter()).items() if n >= least]
    of = np.array([[counts[lang][k] for lang in languages] for k in keys], float).reshape(-1, len(languages)) + 0.5
    total = of.sum(axis=0) + 0.5
    logs = np.log(of / total)
    return dict(zip(keys, logs - logs.mean(axis=1, keepdims=True), strict=True))


def fit(rows: list[tuple[str, str]]) -> Backoff:
    """A model of (text, lang) rows; a word is known if it is seen SEEN times."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Backoff([], {n: {} for n in range(LONGEST + 1)})
    words = {lang: Counter() for lang in languages}
    for text, lang in rows:
        words[lang].update(letters(text))
    seen = {n: {lang: Counter() for lang in languages} for n in range(SHORTEST, LONGEST + 1)}
    for lang in languages:
        for word, count in words[lang].items():
            for n, of in seen.items():
                for gram in grams(word, n):
                    of[lang][gram] += count
    return Backoff(languages, {0: log_frequencies(words, languages, SEEN)} | {n: log_frequencies(of, languages, SEEN) for n, of in seen.items()})


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(rows: DataFrame, most: int, id_col: str) -> DataFrame:
    """About ``most`` rows at most, the same for the same rows: those whose hashed id is under a share of ``most`` to all."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * most / n))


def identify(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every row, beside its id and held_out. The model, learned from a bounded sample, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = sent.value
        languages = model.languages
        kept = Kept(lambda word: model.word(word).tobytes(), 200_000)
        for batch in batches:
            preds, scores = [], []
            for text in batch.column("text").to_pylist():
                found = letters(text)
                if not found or not languages:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(len(languages))
                for at in range(0, len(found), SLICE):
                    total += np.frombuffer(b"".join(map(kept.__getitem__, found[at : at + SLICE]))).reshape(-1, len(languages)).sum(axis=0)
                p = np.exp(total - total.max())
                best = int(np.argmax(p))
                preds.append(languages[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def language_of(docs: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the share of the best language) of every row.

    Learned from a bounded, fixed sample of about ``most`` rows that have a language and are not held out; id, language
    and source are no inputs of a prediction. A text that is null, empty or without letters: 'und', score 0. Ties go to
    the language that is first by code point. No labelled row: all 'und'. Repeated rows keep a row each. Other columns
    are not looked at.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col, 4, 2))
    rows = sample(labelled.select(id_col, text_col, lang_col), most, id_col).orderBy(id_col).collect()  # bounded by most
    return identify(docs, fit([(r[text_col], r[lang_col]) for r in rows]), id_col, text_col)
