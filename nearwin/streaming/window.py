"""Count-based windows and nearest neighbours over live streams.

Each logical stream (a key) keeps its last rows in keyed state. A query row is answered from the rows before it, then a
row is added: test, then train. Rows of a micro-batch are taken in the order of their key column, and its windows are
slices of one array, answered many at a time. A row without a value to order by takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Windows that are answered together.
TOGETHER = 256


def keyed(stream: DataFrame, key: str, order: str, *columns) -> DataFrame:
    return stream.filter(F.col(order).isNotNull()).select(F.col(key).cast("string").alias("__key"), F.col(order).cast("long").alias(order), *columns).groupBy("__key")


def windows(stream: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, order, held, first): how many rows the window has before each row, and the oldest one's order value."""

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = np.array(state.get[0] if state.exists else [], np.int64)
        new = np.sort(np.concatenate([b[order].to_numpy(np.int64) for b in batches]))
        every = np.concatenate([before, new])
        at = np.arange(len(before), len(every))
        held = np.minimum(at, size)
        state.update((every[-size:].tolist(),))
        yield pd.DataFrame({"key": pd.Series([of[0]] * len(new), dtype=object), "at": new, "held": held, "first": pd.Series(every[at - held], dtype="Int64").mask(held == 0)})

    return keyed(stream, key, order).applyInPandasWithState(step, "key string, at long, held long, first long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def classify(stream: DataFrame, key: str, order: str, numeric: list[str], label: str, size: int, k: int) -> DataFrame:
    """(key, at, truth, label): test-then-train votes of the k nearest of the last ``size`` rows, once the window is full.

    Ranges come from the window's rows; an attribute without width adds nothing. Equal distances: the older row first;
    equal votes: the first class in order. A missing number counts as far from all others as the range lets it be; a
    missing class has no vote, and without any vote the label is missing.
    """

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_x, held_y = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        x = np.concatenate([np.array(held_x, float).reshape(-1, len(numeric)), rows[numeric].to_numpy(float)])
        y = np.array([*held_y, *rows[label].tolist()], object)
        codes, classes = pd.factorize(y, sort=True)
        codes, said = np.where(codes < 0, len(classes), codes), np.append(classes, None)
        full = np.arange(max(len(held_y), size), len(y))
        best = [said[voted(x, codes, full[i : i + TOGETHER], len(classes), size, k)] for i in range(0, len(full), TOGETHER)]
        state.update((x[-size:].reshape(-1).tolist(), y[-size:].tolist()))
        text = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"key": text([of[0]] * len(full)), "at": rows[order].to_numpy(np.int64)[full - len(held_y)], "truth": text(y[full]), "label": text(np.concatenate(best) if best else [])})

    numbers = (F.col(c).cast("double").alias(c) for c in numeric)
    return keyed(stream, key, order, *numbers, F.col(label).cast("string").alias(label)).applyInPandasWithState(
        step, "key string, at long, truth string, label string", "x array<double>, y array<string>", "append", GroupStateTimeout.NoTimeout
    )


def voted(x: np.ndarray, codes: np.ndarray, at: np.ndarray, classes: int, size: int, k: int) -> np.ndarray:
    """The class that most of the k nearest of the ``size`` rows before each place have; ``classes`` where none has one."""
    window = at[:, None] + np.arange(-size, 0)
    near = np.argsort(squared(x[window], x[at]), axis=1, kind="stable")[:, :k]
    votes = np.zeros((len(at), classes + 1), int)
    np.add.at(votes, (np.arange(len(at))[:, None], codes[np.take_along_axis(window, near, axis=1)]), 1)
    votes[:, classes] = 0
    return np.where(votes.any(axis=1), votes.argmax(axis=1), classes)


def squared(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Normalised squared distances of the rows of each window from one row, with the rules for missing values (NaN).

    ``x``: (..., rows, attributes), ``row``: (..., attributes).
    """
    row, seen = row[..., None, :], ~np.isnan(x)
    some = seen.any(axis=-2, keepdims=True)
    low = np.where(some, np.min(np.where(seen, x, np.inf), axis=-2, keepdims=True), 0.0)
    width = np.where(some, np.max(np.where(seen, x, -np.inf), axis=-2, keepdims=True), 0.0) - low
    norm = lambda v: np.where(width > 0, (v - low) / np.where(width > 0, width, 1.0), 0.0)
    gone = np.isnan(row)
    a, b = norm(np.where(seen, x, low)), norm(np.where(gone, low, row))
    far = lambda v: np.where(v < 0.5, 1 - v, v)
    diff = np.where(seen & ~gone, a - b, np.where(~seen & gone, 1.0, np.where(gone, far(a), far(b))))
    return (diff * diff).sum(axis=-1)
