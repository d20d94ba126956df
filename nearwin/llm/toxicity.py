"""Toxicity by subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.llm.langid import held_out, sample
from nearwin.llm.words import Start
from nearwin.plans.shared import small_batches

#: Bound of the sample of labelled documents that a model is trained on, whole texts.
SAMPLE = 4_000
BITS, DIMS, SHORTEST, LONGEST = 20, 8, 3, 6
BUCKETS = 1 << BITS
#: Words of at most so many characters also have a vector of their own; longer ones only those of their n-grams.
WHOLE = 40
STEPS, BATCH, RATE, SEED = 400, 64, 0.5, 7
#: Documents of the sample that must have a bucket for it to get a vector; rarer ones only count in the mean.
SEEN = 3
#: Characters whose n-grams are hashed at a time, and those looked at beyond them.
SLICE, BEYOND = 1 << 15, WHOLE + 2
#: An odd base of polynomial hashes modulo 2^64, and an odd factor that mixes them.
BASE, MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
EDGE = 32
#: Characters of texts that are scored together; a longer text is scored by itself.
TOGETHER = 1 << 19


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + BEYOND + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def _wordy() -> np.ndarray:
    """For each code point, whether it is part of a word: letters and digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first position, text of each position, [(which positions have a subword, its bucket)]) for each slice of all characters.

    Texts are lower-cased and stand one after the other between edges; all that is no letter or digit is an edge. The
    subwords of a word, which has an edge at either end, are its runs of SHORTEST to LONGEST characters, edges included,
    and the whole of it if that is longer. A prefix sum of characters times powers of BASE gives the hash of any run in
    a subtraction and a product, so a subword costs a few vector steps and no Python object.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low) + 1), [len(t) + 1 for t in low] + [1])
    for at in range(0, len(codes), SLICE):
        n = min(SLICE, len(codes) - at)
        part = codes[at : at + n + BEYOND]
        wordy = np.zeros(n + BEYOND, bool)
        wordy[: len(part)] = _wordy()[part]
        terms = np.full(n + BEYOND, EDGE + 1, np.uint64)
        np.copyto(terms[: len(part)], part + np.uint64(1), where=wordy[: len(part)])
        sums = np.zeros(n + BEYOND + 1, np.uint64)
        np.cumsum(terms * _UP[: n + BEYOND], out=sums[1:])
        bucket = lambda start, end, down: ((sums[end] - sums[start]) * down * np.uint64(MIX) >> np.uint64(64 - BITS)).astype(np.int32)  # noqa: B023, E731
        found, inside = [], wordy[1 : n + 1]
        for k in range(SHORTEST, LONGEST + 1):
            inside = inside & wordy[k - 2 : n + k - 2] if k > SHORTEST else inside
            found.append((inside, bucket(slice(0, n), slice(k, n + k), _DOWN[:n])))
        edges = np.flatnonzero(~wordy)
        long = (edges[:-1] < n) & (np.diff(edges) >= LONGEST) & (np.diff(edges) <= WHOLE + 1)
        starts = edges[:-1][long]
        has, whole = np.zeros(n, bool), np.zeros(n, np.int32)
        has[starts], whole[starts] = True, bucket(starts, edges[1:][long] + 1, _DOWN[starts])
        yield at, of[at : at + n], [*found, (has, whole)]


@dataclass
class Toxicity:
    """The trained layers folded into one value a bucket and a bias: a softmax of two classes over a mean is linear in it."""

    values: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scored a few texts at a time: an array has a place for each of their characters."""
        before = np.cumsum([0, *(len(t or "") for t in texts)])
        cuts = np.flatnonzero(np.diff(before[:-1] // TOGETHER)) + 1
        return np.concatenate([self._scored(list(part)) for part in np.split(np.array(texts, object), cuts) if len(part)] or [np.zeros(0)])

    def _scored(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts) + 1), np.zeros(len(texts) + 1)
        for _, of, found in subwords(texts):
            value, number = np.zeros(len(of)), np.zeros(len(of))
            for has, bucket in found:
                value += np.where(has, self.values[bucket], 0)
                number += has
            first = of[0]
            total[first : of[-1] + 1] += np.bincount(of - first, value)
            count[first : of[-1] + 1] += np.bincount(of - first, number)
        z = self.bias + total[:-1] / np.maximum(1, count[:-1])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's different buckets and their shares of all its subwords, repeats counted."""
    every = [bucket[has] for _, _, found in subwords([text]) for has, bucket in found]
    of, n = np.unique(np.concatenate(every), return_counts=True)
    return of, (n / max(1, n.sum())).astype(np.float32)


def gradients(e: np.ndarray, w: np.ndarray, b: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> tuple:
    """(loss, embedding rows, and the gradients of them, of w and of b) of the weighted mean cross entropy of a batch."""
    of, share = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    row = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    near = e[of] * share[:, None]
    mean = np.stack([np.bincount(row, near[:, d], len(docs)) for d in range(e.shape[1])], axis=1)
    z = mean @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    each, at = weights / len(docs), np.arange(len(docs))
    loss = float(-(each * np.log(np.maximum(p[at, labels], 1e-300))).sum())
    p[at, labels] -= 1
    p *= each[:, None]
    back = (p @ w.T)[row] * share[:, None]
    rows, inverse = np.unique(of, return_inverse=True)
    de = np.stack([np.bincount(inverse, back[:, d], len(rows)) for d in range(e.shape[1])], axis=1)
    return loss, rows, de, mean.T @ p, p.sum(axis=0)


def train(texts: list[str | None], labels: list[int]) -> Toxicity:
    """Embeddings and output layer by Adagrad on the cross entropy, in a fixed order of fixed batches.

    Each class weighs half of the loss, by its count in the training labels, so a score of 0.5 is where the text speaks
    for neither, however rare one class is.
    """
    rng, y = np.random.default_rng(SEED), np.asarray(labels, np.int64)
    docs = [bag(t) for t in texts]
    seen = np.zeros(BUCKETS, np.int32)
    for of, _ in docs:
        seen[of] += 1
    known = np.flatnonzero(seen >= min(SEEN, max(1, len(docs))))
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    docs = [(place[of[has]], share[has]) for of, share in docs for has in [place[of] >= 0]]
    weights = (len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2))))[y]
    e, w, b = rng.normal(0, 0.1, (len(known), DIMS)), rng.normal(0, 0.1, (DIMS, 2)), np.zeros(2)
    ge, gw, gb = np.full(e.shape, 1e-8), np.full(w.shape, 1e-8), np.full(2, 1e-8)
    order = np.zeros(0, np.int64)
    for _ in range(STEPS):
        order = order if len(order) else rng.permutation(len(docs))
        part, order = order[:BATCH], order[BATCH:]
        _, rows, de, dw, db = gradients(e, w, b, [docs[i] for i in part], y[part], weights[part])
        ge[rows] += de * de
        e[rows] -= RATE * de / np.sqrt(ge[rows])
        for x, g, s in ((w, dw, gw), (b, db, gb)):
            s += g * g
            x -= RATE * g / np.sqrt(s)
    values = np.zeros(BUCKETS, np.float32)
    values[known] = e @ (w[:, 1] - w[:, 0])
    return Toxicity(values, float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Toxicity | None:
    """Trained on about ``most`` labelled rows at most that are not held out; None without any."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    marks = sample(marks.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")), most, "doc_id")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(marks), F.col("__id") == F.col("doc_id"))  # bounded by most
    got = rows.select("__id", "__text", "__toxic").toArrow().to_pylist()
    got.sort(key=lambda r: (r["__id"], r["__text"] or "", r["__toxic"]))
    model = train([r["__text"] for r in got], [int(r["__toxic"] > 0) for r in got]) if got else None
    del got
    Start().once()  # the driver keeps nothing of the training but the model
    return model


def score(docs: DataFrame, model: Toxicity | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``__score``."""

    start = Start()

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.0] * len(texts), pa.float64())
        start.once()
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return small_batches(docs).withColumn("__score", of(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Trained on a bounded, fixed sample of about ``most`` labelled rows (labels: doc_id, toxic; of labels that disagree
    the larger holds) that are not held out. A score is made of the text alone. Null and empty texts, and texts without
    words, have the score of the bias. No labelled row: every score is 0. Repeated rows keep a row each. Empty table: no
    rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("__text"))
    scored = score(rows, fit(docs, labels, most, id_col, text_col), "__text")
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as they are, whatever their names.

    See ``toxicity`` for the training and for null, empty and equal texts and labels. Repeated rows stay or go together; null
    ids take part. No labelled row: every score is 0 and all rows stay. Empty table: no rows. Very long texts are scored by
    themselves, in slices.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return score(rows, fit(docs, labels, most, id_col, text_col), "text").filter("__score < 0.5").select("row.*")
