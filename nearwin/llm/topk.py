"""Exact top-k search by inner product: postings of blocks of rows, scored one term at a time for blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.plans.shared import small_batches, written

#: Rows of an index block and queries of a query block; a partition's last block may be smaller.
BLOCK, ASKED = 4096, 512
INDEX = "ids array<bigint>, terms array<int>, ends array<int>, places array<int>, weights array<bigint>"
ASKING = "block long, ids array<bigint>, ends array<int>, terms array<int>, weights array<bigint>"
FOUND = "block long, place int, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """The vector is there, and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def units(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit whole numbers; one that doesn't fit is an error."""
    whole = np.floor(np.asarray(values, np.float64) * scale)
    if len(whole) and np.abs(whole).max() >= 2.0**63:
        raise OverflowError("a component times the scale takes more than 64 bits")
    return whole.astype(np.int64)


def sparse(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components that are not 0, by row and term."""
    n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = units(pc.list_flatten(vectors).to_numpy(zero_copy_only=False), scale)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(n) - n, n)
    some = weight != 0
    return row[some], term[some], weight[some]


def postings(ids: pa.Array, vectors: pa.Array, scale: float) -> list:
    """A block: ids in order (nulls last), and for each term that occurs the places of its rows, ascending, and their weights."""
    order = pc.sort_indices(ids, null_placement="at_end")
    row, term, weight = sparse(vectors.take(order), scale)
    at = np.argsort(term, kind="stable")
    terms, n = np.unique(term, return_counts=True)
    return [ids.take(order).to_pylist(), terms, np.cumsum(n), row[at], weight[at]]


def cut(rows: DataFrame, size: int, kinds: str, block: Callable[[int, pa.Array, pa.Array], list]) -> DataFrame:
    """One row for each ``size`` rows (id, v) of a partition, which ``block`` makes of its number, the ids and the vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.int64() if k.endswith(" long") else pa.list_(pa.int64() if "bigint" in k else pa.int32()) for k in kinds.split(", ")]

        def made(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = (table.column(c).combine_chunks() for c in ("id", "v"))
            values = block(number, ids, vectors)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, size))
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    return written(small_batches(rows).mapInArrow(pack, kinds))


def index(rows: DataFrame, scale: float, size: int = BLOCK) -> DataFrame:
    """The inverted index of (id, v): a written table of a row a block, see ``postings``."""
    return cut(rows, size, INDEX, lambda _, ids, vectors: postings(ids, vectors, scale))


def asking(rows: DataFrame, scale: float, size: int = ASKED) -> DataFrame:
    """The queries (id, v) as blocks of sparse rows, a written table."""

    def block(number: int, ids: pa.Array, vectors: pa.Array) -> list:
        row, term, weight = sparse(vectors, scale)
        return [number, ids.to_pylist(), np.cumsum(np.bincount(row, minlength=len(ids))), term, weight]

    return cut(rows.repartition(-(-max(1, rows.count()) // size)), size, ASKING, block)


def kind_of(most: int, other: int, terms: int) -> type:
    """A type in which every partial sum of ``terms`` products is exact."""
    bound = most * other * max(1, terms)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores by partition, of equal ones the first; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def scored(block: dict, asked: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of each query's k best rows of a block, those with its own id left out.

    For each term of a query its posting list, times the query's weight, is added into an array with a score a row. A
    list that has all rows needs no places.
    """
    n, ids = len(block["ids"]), block["ids"]
    known = n - ids.null_count  # ids are in order, nulls last
    values = ids.slice(0, known).to_numpy(zero_copy_only=False)
    weights, own = (x["weights"].to_numpy(zero_copy_only=False) for x in (block, asked))
    kind = kind_of(*(int(max(-int(w.min()), int(w.max()))) if len(w) else 0 for w in (weights, own)), len(block["terms"]))
    weights = weights.astype(kind)
    lists, low, places = {}, 0, block["places"].to_numpy(zero_copy_only=False)
    for term, high in zip(block["terms"].to_pylist(), block["ends"].to_pylist(), strict=True):
        lists[term] = (None if high - low == n else places[low:high], weights[low:high])
        low = high
    terms, mine, low, out = asked["terms"].to_pylist(), own.astype(kind).tolist(), 0, []
    for q, (qid, high) in enumerate(zip(asked["ids"].to_pylist(), asked["ends"].to_pylist(), strict=True)):
        scores = np.zeros(n, kind)
        for term, weight in zip(terms[low:high], mine[low:high], strict=True):
            if (found := lists.get(term)) is not None:
                at, of = found
                if at is None:
                    scores += of * weight if kind is object else np.multiply(of, kind(weight))
                else:
                    scores[at] += of * weight if kind is object else np.multiply(of, kind(weight))
        low = high
        first, last = np.searchsorted(values, [qid, qid + 1]) if qid < (1 << 63) - 1 else (np.searchsorted(values, qid), known)
        others = np.delete(np.arange(n), slice(int(first), int(last))) if last > first else None
        kept = best(scores if others is None else scores[others], k)
        kept = kept if others is None else others[kept]
        out.append((np.full(len(kept), q), kept, scores[kept]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, int),) * 3


def search(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the merged k best of all blocks.

    Every block of the index meets every block of queries, block pairs streaming through tasks: no side is sent to all.
    A block gives k rows a query, of which each task keeps k before they are shuffled by query.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block = {c: row[c].values for c in ("ids", "terms", "ends", "places", "weights")}
                asked = {c: row[f"q_{c}"].values for c in ("ids", "terms", "ends", "weights")}
                q, at, score = scored(block, asked, k)
                numbers = pa.array(np.full(len(q), row["q_block"].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(q, pa.int32()), asked["ids"].take(pa.array(q, pa.int64())), block["ids"].take(pa.array(at, pa.int64())), pa.array(score.tolist(), pa.int64())], names=[c.split()[0] for c in FOUND.split(", ")])

    met = small_batches(blocks).join(queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).hint("shuffle_replicate_nl"))
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return met.mapInArrow(look, FOUND).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows with the highest inner products with each row of ``queries``.

    A component x counts as floor(scale * x). Rows with the query's own id are not met. Equal scores: the smaller id
    first, a null id last. Vectors that are null or hold a null or a component that isn't finite take no part; an empty
    one has score 0 with all; of vectors of different lengths the common components count. Repeated rows count each: a
    repeated query is answered for each of its rows. Queries without an id are left out, rows without one are met. Fewer
    than k rows: all of them. Empty tables: no rows. Other columns are not looked at. A component or score that takes more
    than 64 bits is an error.
    """
    slim = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    return search(index(slim(rows), scale), asking(slim(queries).filter("id IS NOT NULL"), scale), k)
