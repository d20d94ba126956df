"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.llm.tokens import KEPT, encoder
from nearwin.plans.ordering import running_total
from nearwin.plans.shared import small_batches, written

CAPACITY = 4096
#: Knapsacks that price the program's columns; a price falls by exp(-ETA x) as the share x of a length is covered.
ROUNDS, ETA = 64, 2.0
#: Prices are blurred by so much before a knapsack, and a column is taken if its value is as near to the best.
BLUR = 0.02
#: A column waits for the next prices when one of its lengths has under this part of the share that all lengths have left.
HELD = 0.5
SEED = 11
#: Pieces of a length that are ranked in one slice, about.
SLICE = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Program:
    """A fractional solution of the configuration program.

    ``columns``: sequences of each configuration, a sorted tuple of lengths. ``open``: how much of each length no column
    has. ``bound``: no packing has fewer sequences, by the best prices found (the dual program's value).
    """

    columns: dict[tuple[int, ...], float]
    open: dict[int, float]
    bound: float


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value that fits into each room up to ``capacity``, and the length to put there first (0: leave one free)."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value = best[room - lengths[: upto[room]]] + prices[: upto[room]]
        at = int(value.argmax()) if len(value) else 0
        found = len(value) and value[at] > best[room - 1]
        best[room], first[room] = (value[at], lengths[at]) if found else (best[room - 1], 0)
    return best, first


def through(lengths: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """For each length, a row with it and what fills the rest of a sequence best; zeros stand for room left free."""
    room, columns = capacity - lengths, [lengths]
    while (room > 0).any():
        item = first[room]
        columns.append(item)
        room = room - np.where(item > 0, item, np.minimum(room, 1))
    return np.stack(columns, axis=1)


def program(counts: dict[int, int], capacity: int = CAPACITY) -> Program:
    """The covering program over all lengths below ``capacity``, solved by multiplicative weights.

    A length's price is its share of a sequence times a weight that falls exponentially as the length gets covered. One
    dynamic program over all lengths prices every room, and so gives the best configuration through each length. Those
    near the best of all are taken for half of what their scarcest length has left, in fractions. Prices that no
    configuration exceeds bound the program from below: each price vector does, scaled by its knapsack's value.
    """
    lengths = np.array(sorted(k for k, n in counts.items() if n and k < capacity), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], float)
    whole = counts.get(capacity, 0)
    found = Program({(capacity,): float(whole)} if whole else {}, {}, float(whole))
    if not len(lengths):
        return found
    rng, total, place = np.random.default_rng(SEED), float((n * lengths).sum()), {k: i for i, k in enumerate(lengths.tolist())}
    left, columns = n.copy(), defaultdict(float)
    for turn in range(ROUNDS):
        share = float((left * lengths).sum()) / total
        prices = lengths / capacity * np.exp(ETA * (left / n - share)) * rng.uniform(1 - BLUR * (turn > 0), 1, len(lengths))
        best, first = knapsack(lengths, prices, capacity)
        found.bound = max(found.bound, whole + float((prices * n).sum()) / best[capacity])
        value = prices + best[capacity - lengths]
        rows = through(lengths, first, capacity)
        for at in np.argsort(-value, kind="stable"):
            if value[at] < (1 - BLUR) * best[capacity]:
                break
            uses = [(place[k], c) for k, c in Counter(x for x in rows[at].tolist() if x).items()]
            if any(left[i] < HELD * share * n[i] or left[i] <= 0 for i, _ in uses):
                continue
            times = min(left[i] / c for i, c in uses) / 2
            for i, c in uses:
                left[i] -= c * times
            columns[tuple(sorted(x for x in rows[at].tolist() if x))] += times
    found.columns |= columns
    found.open = {k: float(x) for k, x in zip(lengths.tolist(), left, strict=True)}
    return found


def configurations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: copies in each}) that hold every length of ``counts`` as often as it occurs.

    The program's columns are rounded from the most frequent on, each to whole sequences with what the ones before have
    lost, as far as there are pieces left and the sequences are nearly full. What remains is packed by best fit.
    """
    left, out, carry = Counter({k: n for k, n in counts.items() if n}), [], 0.0
    for column, times in sorted(program(counts, capacity).columns.items(), key=lambda c: (-c[1], c[0])):
        uses, carry = Counter(column), carry + times
        whole = min(math.floor(carry + 1e-6), *(left[k] // c for k, c in uses.items()))
        carry -= math.floor(carry + 1e-6)
        if whole and sum(column) >= capacity - capacity // 64:
            out.append((whole, dict(uses)))
            left.subtract({k: c * whole for k, c in uses.items()})
    return out + best_fit({k: n for k, n in left.items() if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest first, on groups of sequences with equal contents, so its work doesn't grow with the counts."""
    groups: dict[int, list[list]] = defaultdict(list)  # room: [number, contents]
    rooms = np.zeros(capacity + 1, np.int64)

    def put(number: int, contents: dict[int, int], room: int) -> None:
        if number:
            groups[room].append([number, contents])
            rooms[room] += 1

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                per = capacity // length
                put(n // per, {length: per}, capacity - per * length)
                put(int(n % per > 0), {length: n % per}, capacity - n % per * length)
                break
            room = length + int(fit[0])
            group = groups[room][-1]
            per = min(room // length, n)
            number = min(group[0], n // per)
            group[0] -= number
            if not group[0]:
                groups[room].pop()
                rooms[room] -= 1
            put(number, {**group[1], length: group[1].get(length, 0) + per}, room - per * length)
            n -= number * per
    return [(number, contents) for at in groups.values() for number, contents in at]


def places(configs: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, first offset): where the ranks of each length go."""
    used, sequence, out = defaultdict(int), 0, []
    for times, config in configs:
        offset = 0
        for length, copies in sorted(config.items(), reverse=True):
            out.append((length, used[length], used[length] + copies * times, sequence, copies, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, kept: int = KEPT) -> DataFrame:
    """Each document's ids with ``end_id``, cut every ``capacity`` ids; a document without a place to cut is one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, kept)
        for batch in batches:
            counts, flat = tokens.encode(batch.column("text").to_pylist(), end_id)
            numbers = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), numbers)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            wide = flat.astype("<u4")
            crc = [zlib.crc32(wide[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``docs``.

    The histogram has ``capacity`` lengths at most, however many documents there are; the program is solved on it, and
    each piece takes the place of its rank among the pieces of its length. Ranks are running counts over slices of a
    hash, so a length that a third of all pieces share is many tasks' work. Null and empty texts: one piece, the end id
    alone. Repeated rows keep their pieces each. Empty table: no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, kept))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slices = F.from_json(F.lit(json.dumps([max(1, -(-counts.get(n, 0) // SLICE)) for n in range(capacity + 1)])), "array<bigint>")
    rows = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(slices, F.col("length").cast("int"))).cast("int"))
    ranked = running_total(rows, ["length"], "slice", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], {}, "rank")
    to = spark.createDataFrame(places(configurations(counts, capacity)), "len long, low long, high long, first long, copies int, at int")
    # at most ROUNDS columns a length and a best fit of capacity lengths: megabytes, for any number of documents
    put = ranked.join(F.broadcast(to), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    inside = F.col("rank") - F.col("low")
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(inside / F.col("copies"))).alias("sequence_id"), (F.col("at") + inside % F.col("copies") * F.col("length")).cast("long").alias("offset"))
