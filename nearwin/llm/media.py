"""Media columns: texts as progressive JPEG files, and full-resolution RGB tensors of such files."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.llm.jpeg import Batch, encode, payload
from nearwin.plans.shared import small_batches, written

#: Bytes of payloads or files coded at a time; a larger one is coded by itself.
AT_A_TIME = 1 << 21
STORED = "doc_id long, n_bytes long, media binary"


def groups(sizes: list[int], most: int = AT_A_TIME) -> Iterator[slice]:
    """Consecutive slices of about ``most`` bytes."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the file that holds the text's UTF-8 bytes filled up to a positive multiple of 64.

    Null and empty texts: 64 zero bytes. Equal texts have equal files. Repeated rows keep a row each, and so does a null id.
    Very long texts are coded by themselves; payloads over about 2^31 pixels of picture (some hundred MB) don't fit the
    format and fail. Empty table: no rows. Other columns are not looked at.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column("text").to_pylist()]
            for part in groups([len(t) for t in raw]):
                files = encode([padded(t) for t in raw[part]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], pa.array([len(t) for t in raw[part]], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(put, STORED)


def tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width and rgb (height x width x 3 bytes) of every file of a media column.

    A null file: all but doc_id null. Equal files have equal tensors, repeated rows a row each. A file that is no progressive
    JPEG of 8-bit samples is an error. Empty table: no rows. Other columns are not looked at.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            for part in groups([len(f or b"") for f in files]):
                some = [f for f in files[part] if f is not None]
                decoded, i, rows = Batch(some), 0, []
                for f in files[part]:
                    rows.append(None if f is None else decoded.tensor(i))
                    i += f is not None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part.start : part.stop], *(pa.array([None if t is None else t.shape[k] for t in rows], pa.int32()) for k in (0, 1)), pa.array([None if t is None else t.tobytes() for t in rows], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    return small_batches(media).select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(look, "doc_id long, height int, width int, rgb binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(rgb) -> str:
    """The tensor's shape and crc32, and the sum of each channel."""
    r, g, b = rgb.sum(axis=(0, 1), dtype="int64").tolist()
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{zlib.crc32(rgb.tobytes()):08x}:{r}:{g}:{b}"


def read_back(media: DataFrame) -> DataFrame:
    """Digests of what the files of a table of ``stored`` hold: their payloads, themselves, and their tensors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            for part in groups([len(f) for f in files]):
                decoded, rows = Batch(files[part]), []
                for i, (doc, n, f) in enumerate(zip(ids[part], sizes[part], files[part], strict=True)):
                    raw = payload(decoded, i)
                    rows.append((doc, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(decoded.tensor(i))))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return small_batches(media).mapInArrow(look, READ)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every row.

    A text becomes a file of a media column of a table in the shared folder; all but n_bytes is taken from the file that is
    read back from there. Null and empty texts: a payload
    of 64 zero bytes. Equal texts have equal files. Repeated rows keep a row each. Empty table: no rows. Other columns
    are not looked at. Payloads over about 2^31 pixels of picture (some hundred MB) don't fit the format and fail.
    """
    return read_back(written(stored(docs, id_col, text_col), compression="zstd"))
