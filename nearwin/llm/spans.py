"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.llm.words import Start
from nearwin.plans.shared import small_batches

#: The signs that end a sentence in any script (Unicode's Sentence_Terminal), as ranges of code points.
TERMINALS = (
    (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x589, 0x589), (0x61D, 0x61F), (0x6D4, 0x6D4), (0x700, 0x702), (0x7F9, 0x7F9),
    (0x837, 0x837), (0x839, 0x839), (0x83D, 0x83E), (0x964, 0x965), (0x104A, 0x104B), (0x1362, 0x1362), (0x1367, 0x1368),
    (0x166E, 0x166E), (0x1735, 0x1736), (0x17D4, 0x17D5), (0x1803, 0x1803), (0x1809, 0x1809), (0x1944, 0x1945),
    (0x1AA8, 0x1AAB), (0x1B5A, 0x1B5B), (0x1B5E, 0x1B5F), (0x1C3B, 0x1C3C), (0x1C7E, 0x1C7F), (0x203C, 0x203D),
    (0x2047, 0x2049), (0x2E2E, 0x2E2E), (0x2E3C, 0x2E3C), (0x3002, 0x3002), (0xA4FF, 0xA4FF), (0xA60E, 0xA60F),
    (0xA6F3, 0xA6F3), (0xA6F7, 0xA6F7), (0xA876, 0xA877), (0xA8CE, 0xA8CF), (0xA92F, 0xA92F), (0xA9C8, 0xA9C9),
    (0xAA5D, 0xAA5F), (0xAAF0, 0xAAF1), (0xABEB, 0xABEB), (0xFE52, 0xFE52), (0xFE56, 0xFE57), (0xFF01, 0xFF01),
    (0xFF0E, 0xFF0E), (0xFF1F, 0xFF1F), (0xFF61, 0xFF61),
)
_ENDS = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if b > a else re.escape(chr(a)) for a, b in TERMINALS)
#: A sentence ends with its signs and the white space after them, if any, or with a line; all sentences joined are the text.
SENTENCE = re.compile(rf"[^{_ENDS}\n]*(?:[{_ENDS}]+|\n)\s*|[^{_ENDS}\n]+")
#: Sentences in a span, and words that it has at least; a shorter run is a span if it has LONG words.
RUN, LEAST, LONG = 3, 8, 14
#: Bytes that count as a word where there are fewer spaces, as in scripts that have none.
WORD_BYTES = 12


def spans(text: str, run: int = RUN, least: int = LEAST, long: int = LONG) -> tuple[list[str], list[tuple[int, int, bytes]]]:
    """The sentences of a text, and (first sentence, number of sentences, 16-byte hash) of each span.

    A run of consecutive sentences is long enough with ``run`` sentences or more and ``least`` words, or with ``long``
    words. The spans are the shortest such run from each sentence on and the shortest up to each sentence: a run that is
    long enough, of any length, is covered by the spans inside it. Sentences count without the white space around them,
    and blank ones not at all.
    """
    parts = SENTENCE.findall(text)
    said = [(i, s) for i, s in enumerate(map(str.strip, parts)) if s]
    raw = [s.encode(errors="replace") for _, s in said]
    words = [0]
    for (_, s), r in zip(said, raw, strict=True):
        words.append(words[-1] + max(s.count(" ") + 1, len(r) // WORD_BYTES))
    found, start = {}, 0
    for end in range(1, len(said) + 1):
        was = start
        while start < end and ((n := words[end] - words[start]) >= long or (end - start >= run and n >= least)):
            found[start, end] = None  # the shortest from this start, unless an earlier end gave one
            start += 1
        if start > was:
            continue
        if start and (start - 1, end) not in found:
            low = start - 1
            found[low, end] = None  # the shortest up to this end
    out = [(k, end - k, xxhash.xxh3_128_digest(b"\n".join(raw[k:end]))) for k, end in found]
    return parts, [(said[k][0], said[k + n - 1][0] - said[k][0] + 1, h) for k, n, h in out]


def identity(id_col: str, text_col: str) -> Column:
    """The document's place in the order: its id; a null id comes before all, by a hash of its text."""
    some = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 61))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - some)


def span_table(docs: DataFrame, id_col: str, text_col: str, **shape: int) -> DataFrame:
    """(a, b, doc): each document's different spans, hashes in two longs."""

    start = Start()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start.once()
        for batch in batches:
            keys, counts = [], []
            for text in batch.column("text").to_pylist():
                found = {h for _, _, h in spans(text, **shape)[1]} if text else ()
                keys.extend(found)
                counts.append(len(found))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            doc = batch.column("doc").to_numpy().repeat(counts)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(doc)], names=["a", "b", "doc"])

    return small_batches(docs).select(identity(id_col, text_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(emit, "a long, b long, doc long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shape: int) -> DataFrame:
    """(row, sentences, removed, text): each row as it is, and its text without sentences that a non-first repeated span covers.

    A span's first place is in the document with the smallest id (null ids first), and there at its first sentence. All
    documents' span hashes are grouped with a partial minimum and count; hashes seen in one document only end there. The
    rest are joined back, so a span in very many documents is a skewed join, which AQE splits, and each document gets
    the list of its own spans that are first elsewhere. Texts are split anew where they are read, not kept.

    Rows equal in id count as one document between them (a span is not repeated by them). Null text: stays null, no
    sentences. Text without a span: stays as it is. Empty table: no rows.
    """
    names, start = docs.columns, Start()
    found = span_table(docs, id_col, text_col, **shape)
    first = found.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("a", "b", "first")
    later = found.join(first, ["a", "b"]).filter("doc > first").select("doc", "a")
    later = later.groupBy("doc").agg(F.collect_list("a").alias("__later"))

    @F.arrow_udf("struct<sentences:int,removed:int,text:string>")
    def cut(texts: pa.Array, later: pa.Array) -> pa.Array:
        start.once()
        out = []
        for text, known in zip(texts.to_pylist(), later.to_pylist(), strict=True):
            if text is None:
                out.append({"sentences": 0, "removed": 0, "text": None})
                continue
            parts, every = spans(text, **shape)
            known, seen, gone = set(known or ()), set(), set()
            for at, n, h in every:
                if h in seen or int.from_bytes(h[:8], "little", signed=True) in known:
                    gone.update(range(at, at + n))
                seen.add(h)
            out.append({"sentences": len(parts), "removed": len(gone), "text": "".join(p for i, p in enumerate(parts) if i not in gone) if gone else text})
        return pa.array(out, pa.struct([("sentences", pa.int32()), ("removed", pa.int32()), ("text", pa.string())]))

    rows = docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("given"), identity(id_col, text_col).alias("place"))
    joined = rows.join(later, rows["place"] == later["doc"], "left").withColumn("cut", cut("given", "__later"))
    return joined.select("row", F.col("cut.sentences").alias("sentences"), F.col("cut.removed").alias("removed"), F.col("cut.text").alias("text"))


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_removed and text (what is left) of every row of ``docs``; see without_repeats."""
    cut = without_repeats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return cut.select("row.doc_id", F.col("sentences").alias("n_sentences"), F.col("removed").alias("n_removed"), "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what is left of the texts; documents of which nothing is left go, those that had nothing stay.

    An n_chars column follows the text. Columns may have any names. See without_repeats for nulls, ties, repeated rows and
    empty tables; very long texts are taken whole.
    """
    cut = without_repeats(docs, id_col, text_col).filter((F.col("removed") == 0) | (F.trim("text") != ""))
    given = lambda c: F.col("row").getField(c)
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(given("n_chars"))
    return cut.select(*(new.get(c, given(c)).alias(c) for c in docs.columns))
