"""Token ids as Arrow stream files of equal-length sequences."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.llm.tokens import encoder
from nearwin.plans.ordering import order_key
from nearwin.plans.shared import shared_dir, small_batches

#: Ids in a sequence, and sequences in a batch.
LENGTH, ROWS = 1024, 256
FILES = "part int, path string, n_docs long, n_tokens long"
PLACES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a shared folder; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class StreamWriter:
    """Writes one run of ids as fixed-size lists: ``ids`` (sequences of LENGTH) and ``mask`` (true where an id is real).

    Only the last sequence is padded. Every record batch but the last holds ROWS sequences, uncompressed, so sequence
    i lies in batch i // ROWS at row i % ROWS and a reader maps it without copying.
    """

    def __init__(self, sink, dtype: pa.DataType, length: int = LENGTH, rows: int = ROWS) -> None:
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"length": str(length), "rows": str(rows)})
        self.out, self.held, self.n = pa.ipc.new_stream(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        size = self.length * self.rows
        if self.n >= size:
            all_ids = np.concatenate(self.held)
            whole = len(all_ids) // size * size
            for at in range(0, whole, size):
                self._put(all_ids[at : at + size], size)
            self.held, self.n = [all_ids[whole:].copy()], len(all_ids) - whole

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype.to_pandas_dtype())
        if len(ids):
            self._put(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()


class Sequences:
    """Random access to the sequences of a stream file in ``buffer`` (a memory map or bytes); nothing is copied."""

    def __init__(self, buffer: pa.Buffer) -> None:
        reader = pa.ipc.open_stream(buffer)
        self.length, self.rows = (int(reader.schema.metadata[k]) for k in (b"length", b"rows"))
        self.batches = list(reader)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _flat(self, column: int, i: int) -> tuple[pa.Array, int]:
        values = self.batches[i // self.rows].column(column)
        return values.values, (values.offset + i % self.rows) * self.length

    def ids(self, i: int) -> np.ndarray:
        values, at = self._flat(0, i)
        return values.to_numpy(zero_copy_only=True)[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        values, at = self._flat(1, i)
        return values[at : at + self.length].to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the run; a view if they lie in one batch."""
        size, parts = self.length * self.rows, []
        while n > 0:
            b, at = divmod(start, size)
            part = self.batches[b].column(0).values.to_numpy(zero_copy_only=True)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_streams(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes ids in ascending id order; returns a row (part, path, n_docs, n_tokens) a file, in that order.

    One range partition of ids makes one file of ids and one index file (doc_id, start in the file, n_tokens). A file
    is written under a name of its own attempt and counts only through the row that the finished task returns, so a
    lost executor leaves at most an unused file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        tokens, index, n = encoder(tokenizer), [], 0
        with fs.open_output_stream(f"{root}/{name}.ids.arrow") as sink:
            out = StreamWriter(sink, pa.from_numpy_dtype(tokens.dtype))
            for batch in batches:
                counts, flat = tokens.encode(batch.column("text").to_pylist(), end_id)
                out.add(flat)
                index.append(pa.record_batch([batch.column("doc_id"), pa.array(n + np.cumsum(counts) - counts), pa.array(counts)], names=["doc_id", "start", "n_tokens"]))
                n += len(flat)
            out.close()
        if not index:
            fs.delete_file(f"{root}/{name}.ids.arrow")
            return
        with fs.open_output_stream(f"{root}/{name}.index.arrow") as sink, pa.ipc.new_stream(sink, index[0].schema) as out:
            for x in index:
                out.write_batch(x)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [sum(x.num_rows for x in index)], "n_tokens": [n]})

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ordered = rows.repartitionByRange(order_key("doc_id"), F.crc32(F.coalesce("text", F.lit(b"")))).sortWithinPartitions(order_key("doc_id"), F.crc32(F.coalesce("text", F.lit(b""))))
    return sorted(ordered.mapInArrow(write, FILES).collect())  # a row a file


def read_streams(spark, files: list) -> DataFrame:
    """Each document's place and checksum, from the written files alone; a task reads one file at a time."""
    starts, at = [], 0
    for f in files:
        starts.append((f["part"], f["path"], at))
        at += f["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, root = open_folder(path)
                with fs.open_input_file(f"{root}.index.arrow") as source:
                    index = pa.ipc.open_stream(source).read_all()
                ids = Sequences(pa.memory_map(f"{root}.ids.arrow").read_buffer() if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{root}.ids.arrow").readall())
                start, n = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(ids.span(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(start + before), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not starts:
        return spark.createDataFrame([], PLACES)
    table = spark.createDataFrame(starts, "part int, path string, before long")
    return table.repartition(len(starts)).select("path", "before").mapInArrow(read, PLACES)


def token_places(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes whole texts, writes Arrow stream files in ascending id order, and reads each document back from them.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). Files hold the narrowest unsigned type that fits the vocabulary. Null or
    empty text: the end id alone. Equal ids are ordered by crc32 of the text; null ids come first. Empty table: no
    files, no rows. Repeated rows keep a row each. Other columns are not looked at.
    """
    return read_streams(docs.sparkSession, write_streams(docs, tokenizer, end_id, shared_dir(docs.sparkSession), id_col, text_col))
