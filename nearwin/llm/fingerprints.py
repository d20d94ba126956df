"""Homomorphic multiset fingerprints of documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.plans.ordering import LOWEST, bucket_of, order_key, quantile_bounds

#: Seeds of the wide lanes: each gives 64 hash bits of a paragraph, in two lanes summed modulo 2^31.
WIDE = tuple(range(1, 9))
#: Seeds of the narrow lanes: each gives 63 sign bits of a phrase, three lanes to a long, summed modulo 2^20.
NARROW = (101, 102)
LONGS, STEP = 21, 21
#: The lowest bit of each of three fields, and each field's 20 bits; the bit above a field takes its carry.
ONES = 1 | 1 << STEP | 1 << 2 * STEP
FIELDS = ONES * ((1 << 20) - 1)
MOD, COUNT = (1 << 31) - 1, (1 << 20) - 1
#: Paragraphs end with a line; phrases are runs of up to eight words without a sentence sign between them.
PHRASE = r"(?:[^\s.,;:!?|]+[^\S\n]*){1,8}"


def _total(values: Column, term, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: (a + term(h)).bitwiseAND(F.lit(mask)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a lambda's argument is kept, an expression in a lambda is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))


def lanes(text: Column) -> Column:
    """The fingerprint as an array of longs: 16 wide lanes, 42 longs of three narrow lanes, and the number of phrases.

    A text is the multiset of its paragraphs, and each paragraph a wide vector: hash bits of the whole paragraph for
    equality, and sums of sign bits over its phrases for likeness. The fingerprint is the sum of its paragraphs' vectors,
    each lane modulo its power of two. So the order of paragraphs doesn't matter, and lanes of added or taken paragraphs
    can be added or taken (``combine``). Each lane is masked after each sum: no lane flows into the next.
    """
    some = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(some, "\n"), lambda p: p != "")
    phrases = F.transform(F.regexp_extract_all(some, F.lit(PHRASE), F.lit(0)), lambda p: F.trim(p))
    halves = lambda h: F.array(_total(h, lambda x: x.bitwiseAND(F.lit(MOD)), MOD), _total(h, lambda x: F.shiftrightunsigned(x, 33), MOD))
    wide = let(paragraphs, lambda p: F.concat(*(let(_hashes(p, seed), halves) for seed in WIDE)))
    signs = lambda h: F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), _signs(h))
    count = lambda p: F.array(F.size(p).cast("long").bitwiseAND(F.lit(COUNT)))
    narrow = let(phrases, lambda p: F.concat(*(let(_hashes(p, seed), signs) for seed in NARROW), count(p)))
    return F.concat(wide, narrow)


def _signs(hashes: Column):
    return lambda j: _total(hashes, lambda x: F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(ONES)), FIELDS)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of ``a`` with the paragraphs of ``b`` added (sign 1) or taken away (sign -1)."""
    lit = lambda x: F.lit(x).cast("long")
    masks = F.concat(F.array_repeat(lit(MOD), 2 * len(WIDE)), F.array_repeat(lit(FIELDS), LONGS * len(NARROW)), F.array(lit(COUNT)))
    units = F.concat(F.array_repeat(lit(1), 2 * len(WIDE)), F.array_repeat(lit(ONES), LONGS * len(NARROW)), F.array(lit(1)))
    if sign < 0:
        b = F.zip_with(F.zip_with(masks, b, lambda m, q: m - q), units, lambda x, one: x + one)
    return F.zip_with(F.zip_with(a, b, lambda p, q: p + q), masks, lambda x, m: x.bitwiseAND(m))


def text_form(fp: Column) -> Column:
    """Lanes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _centered(fp: Column) -> Column:
    """Signed counts of the narrow lanes: twice the phrases with the bit, less all phrases."""
    n = F.element_at(fp, -1)
    narrow = F.slice(fp, 2 * len(WIDE) + 1, LONGS * len(NARROW))
    at = lambda shift: F.transform(narrow, lambda x: (F.shiftright(x, shift).bitwiseAND(F.lit(COUNT)) * 2 - n).cast("double"))
    return F.concat(*(at(k * STEP) for k in range(3)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the cosine of the centered narrow lanes, from 0 to 1.

    Its mean is the share of phrases in common (their inner product over the geometric mean of the two multisets'), its
    spread 1 / sqrt(126 lanes).
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cosine = lambda x, y: let(F.sqrt(dot(x, x) * dot(y, y)), lambda norm: F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(let(_centered(a), lambda x: let(_centered(b), lambda y: cosine(x, y))))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, fp (its lanes) and next_text, next_fp of the next row by id; after the last comes the first.

    Rows go to quantile buckets of their ids; a row that starts a bucket is copied to the bucket before, and the first
    of all to the last, so every bucket's window is whole by itself and each text is shuffled once (bucket starts twice).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("fp", lanes(F.col("text")))
    key = order_key("doc_id")
    bounds = quantile_bounds(docs, order_key(id_col))
    least = docs.agg(F.min(order_key(id_col))).first()[0]
    least = LOWEST if least is None else least
    starts = F.from_json(F.lit(str(bounds)), "array<bigint>")
    here = F.struct(F.col("home").alias("bucket"), F.lit(0).alias("ghost"))
    before = F.struct((F.col("home") - 1).alias("bucket"), F.lit(1).alias("ghost"))
    around = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("ghost"))
    to = F.when(key == F.lit(least), F.array(here, around)).when(F.get(starts, F.col("home") - 1) == key, F.array(here, before)).otherwise(F.array(here))
    dealt = rows.withColumn("home", bucket_of(key, bounds)).select("doc_id", "text", "fp", F.inline(to))
    order = Window.partitionBy("bucket").orderBy("ghost", order_key("doc_id"), F.crc32(F.col("text").cast("binary")), "text")
    return dealt.select("doc_id", "text", "fp", "ghost", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).filter("ghost = 0").drop("ghost")


def edited(text: Column, after: Column) -> Column:
    """The text with its last quarter (floor) of code points replaced by the first as many of ``after``, or all of it."""
    n = F.char_length(text)
    q = F.floor(n / F.lit(4)).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - q).cast("int")), F.substring(after, F.lit(1), q))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Null text counts as empty: the fingerprint of no paragraphs, all zeros; two such are alike (1). Equal ids (null ids
    first) are ordered by crc32 of the text, then by the text; repeated rows keep a row each and follow each other. The
    only row of a table is its own next. Empty table: no rows. Other columns are not looked at.
    """
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", lanes(F.col("edited")).alias("efp"))
    return rows.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
