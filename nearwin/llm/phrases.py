"""Phrase mining level by level: k words count only where both runs of k - 1 words in them are frequent."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.plans.shared import small_batches, unsent, written

#: Least count of a frequent phrase, words of the longest, phrases reported of a language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A longer phrase takes a shorter one in from this share of its count on, as a fraction.
SHARE = (50, 100)
SCALE = 1_000_000
#: Bits of the table of frequent phrases that tasks get: about so many a phrase, at most 2 ** MOST_BITS (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 27
#: Bytes of text whose words are numbered at a time.
SLICE = 4 << 20
SEED, TURN = 42, np.uint64(21)
#: Upper case A-Z to lower case, tabs to spaces, all that ends a piece to a full stop, which so stands for no word.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + b",;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)


def slices(texts: list[bytes], most: int) -> Iterator[bytes]:
    """The texts one after the other, each an own piece, in parts of about ``most`` bytes that are cut between pieces."""
    held, size = [], 0
    for text in texts:
        text, at = text.translate(_TABLE), 0
        while len(text) - at > most:
            end = text.find(b".", at + most)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end
        held.append(text[at:])
        size += len(text) - at
        if size >= most:
            yield b".".join(held)
            held, size = [], 0
    if held:
        yield b".".join(held)


def hashed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with a word added."""
    return ((h << TURN) | (h >> (np.uint64(64) - TURN))) ^ word


def start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def phrases(part: bytes, k: int, base: np.uint64, bits: np.ndarray | None) -> tuple[list[bytes], np.ndarray]:
    """The different phrases of k words of a part, of which both runs of k - 1 words have their bit, and their counts."""
    tokens, number = part.replace(b".", b" . ").split(), defaultdict()
    number.default_factory = number.__len__
    number[b"."]  # number 0
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    words = list(number)
    if k == 1:
        n = np.bincount(ids, minlength=len(words))
        return words[1:], n[1:]
    of_word = word_hashes(words)
    texts, h, at = words, hashed(base, of_word), np.flatnonzero(ids)
    of, run = ids[at], ids  # the phrase that starts at each place of ``at``; ``run``: by place
    for j in range(2, k + 1):
        if j == k:  # both shorter runs must have their bits
            slot = (h & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
            has = (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            good = np.zeros(len(ids) + 1, bool)
            good[at] = has[of]
            at = at[good[at] & good[at + 1]]
        else:
            at = at[at + j - 1 < len(ids)]
            at = at[ids[at + j - 1] > 0]
        pair, inverse, n = np.unique(run[at] * len(words) + ids[at + j - 1], return_inverse=True, return_counts=True)
        left, right = pair // len(words), pair % len(words)
        texts = [texts[a] + b" " + words[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)] if j == k else _Joined(texts, words, left, right)
        h, of = hashed(h[left], of_word[right]), inverse
        run = np.zeros(len(ids), np.int64)
        run[at] = inverse
    return texts, n


class _Joined:
    """Phrases of which only those asked for are made."""

    def __init__(self, texts, words: list[bytes], left: np.ndarray, right: np.ndarray) -> None:
        self.texts, self.words, self.left, self.right = texts, words, left, right

    def __getitem__(self, i: int) -> bytes:
        return self.texts[int(self.left[i])] + b" " + self.words[int(self.right[i])]


def counted(docs: DataFrame, k: int, bits=None) -> DataFrame:
    """(lang, phrase, n): occurrences of phrases of k words; ``bits``: the broadcast table of frequent ones of k - 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by[lang].append(text or b"")
            for lang, texts in by.items():
                for part in slices(texts, SLICE):
                    found, n = phrases(part, k, start(lang), None if bits is None else bits.value)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return small_batches(docs).mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_table(frequent: DataFrame, n: int):
    """A broadcast table of bits that are set for the hashes of a written table (lang, phrase) of ``n`` phrases.

    It has 32 bits a phrase up to 2^27 (16 MB), which is its bound at any size. A bit that is set by chance lets a phrase be
    counted that is not frequent, and whose count says so: the result does not depend on the table's size.
    """
    most = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
                slots[i] = reduce(hashed, word_hashes(phrase.encode().split(b" ")), start(lang)) & np.uint64(most - 1)
            words, at = np.unique(slots >> np.uint64(6), return_inverse=True)
            values = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(values, at, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(values.view(np.int64))], names=["place", "bits"])

    got = frequent.select("lang", "phrase").mapInArrow(places, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2^21 rows
    bits = np.zeros(most // 64, np.uint64)
    bits[got.column("place").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def joined(words: Column, low: int, n: int) -> Column:
    return F.array_join(F.slice(words, low + 1, n), " ")


def cut_scores(level: DataFrame, k: int, levels: dict[int, DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of k words at the cut where the score is least, of equal ones the first."""
    out = level.select("lang", "phrase", F.col("n").alias("a"))
    for cut in range(1, k):
        words = F.split("phrase", " ")
        out = out.withColumns({"left": joined(words, 0, cut), "right": joined(words, cut, k - cut)})
        for side, name, size in (("left", f"l{cut}", cut), ("right", f"r{cut}", k - cut)):
            out = out.join(unsent(levels[size].select("lang", F.col("phrase").alias(side), F.col("n").alias(name))), ["lang", side]).drop(side)
    product = lambda x, y: f"(CAST({x} AS DECIMAL(19, 0)) * CAST({y} AS DECIMAL(19, 0)))"
    score = lambda cut: F.expr(f"{SCALE} * {product('a', 'a')} DIV {product(f'l{cut}', f'r{cut}')}")
    least = F.array_min(F.array(*(F.struct(score(cut).alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")) for cut in range(1, k))))
    return out.withColumn("best", least).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def inside(levels: dict[int, DataFrame], k: int) -> DataFrame:
    """(lang, phrase, most): of phrases of k words, the greatest count of a longer frequent phrase around each."""
    found = []
    for size in range(k + 1, max(levels) + 1):
        words = F.split("phrase", " ")
        found += [levels[size].select("lang", joined(words, low, k).alias("phrase"), "n") for low in range(size - k + 1)]
    return reduce(DataFrame.unionByName, found).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: tuple[int, int] = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z) and split into pieces at full stops, commas, semicolons, colons, exclamation and question
    marks and line ends, and pieces into words at spaces and tabs. A phrase is frequent with ``least`` occurrences within
    pieces, overlaps included. Each level reads all texts and counts phrases of k words only where both runs of k - 1 words
    are frequent; of two runs that fall on one bit of ``bit_table`` it may count more, which then are not frequent. Scores
    come from the level tables. A phrase goes if a longer frequent one around it has ``share`` of its count.

    Null language: 'und', together with texts of that language. Null and empty texts: no words. Repeated rows count each.
    Equal scores: the greater count, then the smaller phrase in UTF-8 first. Empty table or nothing frequent: no rows. Very long
    texts are counted in parts cut between pieces. Other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    every = written(counted(rows, 1))
    totals = every.groupBy("lang").agg(F.sum("n").alias("words"))
    levels = {1: every.filter(F.col("n") >= least)}
    for k in range(2, longest + 1):
        bits = bit_table(levels[k - 1], levels[k - 1].count())
        levels[k] = written(counted(rows, k, bits).filter(F.col("n") >= least))
    parts = []
    for k in range(2, longest + 1):
        of = cut_scores(levels[k], k, levels)
        if k < longest:
            up, down = share
            taken = (F.col("most") * down >= F.col("a") * up) & F.col("most").isNotNull()
            of = of.join(unsent(inside(levels, k)), ["lang", "phrase"], "left").filter(~F.coalesce(taken, F.lit(False))).drop("most")
        parts.append(of)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
