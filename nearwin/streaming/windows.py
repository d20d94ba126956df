"""Windows over live streams that can be exchanged: a plain ring of rows, and a kd-tree that follows the window.

A window takes rows one at a time, drops the oldest when it is full, and gives the rows nearest to a query by the mixed
distance over the ranges of the rows it holds. It goes into a stream's keyed state as text and arrays and comes out as it
was, so a tree is maintained over all micro-batches and never built anew.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row: its order value, numbers (nan: missing), names (None: missing) and class.
Row = tuple[int, tuple[float, ...], tuple, object]
#: A leaf with more rows is split; one with fewer is taken out, if it has a sibling.
LEAF, FEW = 4, 2
#: Boxes are taken to be nearer by this share than they are, against rounding.
SLACK = 1e-9


class Window(Protocol):
    """What a live search needs of a window."""

    size: int
    rows: dict[int, Row]

    def add(self, row: Row) -> None: ...
    def nearest(self, numbers: tuple[float, ...], names: tuple, k: int) -> list[tuple[float, int]]: ...
    def shape(self) -> str: ...
    def restore(self, rows: list[Row], shape: str) -> None: ...


def ranges(rows: dict[int, Row], numeric: int) -> list[tuple[float, float]]:
    """Least value and width of each number over the rows; width 0 where none is seen."""
    out = []
    for d in range(numeric):
        seen = [r[1][d] for r in rows.values() if r[1][d] == r[1][d]]
        low = min(seen, default=0.0)
        out.append((low, max(seen, default=0.0) - low))
    return out


def unit(numbers: tuple[float, ...], of: list[tuple[float, float]]) -> tuple[float | None, ...]:
    """The numbers normalised by the ranges, 0 for a range without width; None: missing."""
    return tuple([None if z != z else (z - low) / width if width > 0 else 0.0 for z, (low, width) in zip(numbers, of, strict=True)])


def squared(a: tuple, b: tuple, a_names: tuple, b_names: tuple) -> float:
    """The mixed squared distance, normalised numbers first. Both missing: 1. One missing: as far as the range lets it be."""
    total = 0.0
    for u, v in zip(a, b):  # noqa: B905
        if u is None or v is None:
            seen = v if u is None else u
            diff = 1.0 if seen is None else 1 - seen if seen < 0.5 else seen
        else:
            diff = u - v
        total += diff * diff
    for x, y in zip(a_names, b_names):  # noqa: B905
        if x is None or x != y:
            total += 1.0
    return total


class Ring:
    """A window that looks at all its rows. Their ranges and normalised numbers are kept, and made anew when a limit comes or goes."""

    def __init__(self, size: int, numeric: int) -> None:
        self.size, self.numeric, self.rows, self.next, self.looked = size, numeric, {}, 0, 0
        self.measure()

    def measure(self) -> None:
        self.of, self.stale = ranges(self.rows, self.numeric), False
        self.units = {p: unit(r[1], self.of) for p, r in self.rows.items()}

    def limits(self) -> list[tuple[float, float]]:
        """``ranges`` of the window's rows; ``units`` are by them."""
        if self.stale:
            self.stale = False
            if ranges(self.rows, self.numeric) != self.of:
                self.measure()
        return self.of

    def add(self, row: Row) -> None:
        if len(self.rows) == self.size:
            self.drop(next(iter(self.rows)))
        self.rows[self.next] = row
        self.units[self.next] = own = unit(row[1], self.of)
        self.stale = self.stale or at_limit(own)
        self.put(self.next)
        self.next += 1

    def put(self, place: int) -> None: ...

    def drop(self, place: int) -> None:
        del self.rows[place]
        self.stale = self.stale or at_limit(self.units[place])
        del self.units[place]

    def nearest(self, numbers: tuple[float, ...], names: tuple, k: int) -> list[tuple[float, int]]:
        """(squared distance, place) of the k nearest rows, equal ones by age, the older first."""
        own = unit(numbers, self.limits())
        self.looked += len(self.rows)
        return heapq.nsmallest(k, ((squared(own, self.units[p], names, r[2]), p) for p, r in self.rows.items()))

    def shape(self) -> str:
        return ""

    def restore(self, rows: list[Row], shape: str) -> None:
        self.rows, self.next = dict(enumerate(rows)), len(rows)
        self.measure()


def at_limit(own: tuple[float | None, ...]) -> bool:
    """Whether a row with these normalised numbers can widen the ranges by coming or narrow them by going."""
    for u in own:
        if u is not None and not 0 < u < 1:
            return True
    return False


@dataclass(eq=False)
class Node:
    """A leaf with places of rows, or a split; and a box around the rows below with their names, which may be wider than they need."""

    parent: Node | None = None
    dim: int | None = None
    split: float = 0.0
    sides: list[Node] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    gap: list[bool] = field(default_factory=list)
    named: set[tuple[int, str]] = field(default_factory=set)


class Tree(Ring):
    """A kd-tree over the window: rows come in by ``value <= split`` to the left, missing values too, and go out again.

    A leaf of more than LEAF rows is split in the dimension that is widest against the window's range (of equals the first)
    at its middle, if that parts its rows. A row that goes is taken out of its leaf; a leaf of fewer than FEW rows is given up:
    its sibling takes the parent's place and gets the rows that were left.
    """

    def __init__(self, size: int, numeric: int) -> None:
        super().__init__(size, numeric)
        self.root, self.leaf_of = self.fresh(None), {}

    def fresh(self, parent: Node | None) -> Node:
        n = self.numeric
        return Node(parent, low=[math.inf] * n, high=[-math.inf] * n, gap=[False] * n)

    def widened(self, node: Node, row: Row) -> None:
        low, high = node.low, node.high
        for d, v in enumerate(row[1]):
            if v != v:
                node.gap[d] = True
                continue
            if v < low[d]:
                low[d] = v
            if v > high[d]:
                high[d] = v
        node.named.update(enumerate(row[2]))

    def put(self, place: int) -> None:
        self.into(self.root, place)

    def into(self, node: Node, place: int) -> None:
        row = self.rows[place]
        self.widened(node, row)
        while node.dim is not None:
            node = node.sides[row[1][node.dim] > node.split]
            self.widened(node, row)
        node.places.append(place)
        self.leaf_of[place] = node
        if len(node.places) > LEAF:
            self.parted(node)

    def parted(self, node: Node) -> None:
        of = self.limits()
        own = ranges({p: self.rows[p] for p in node.places}, self.numeric)
        share = [w / whole if whole > 0 else 0.0 for (_, w), (_, whole) in zip(own, of, strict=True)]
        if not share or max(share) <= 0:
            return
        d = share.index(max(share))
        split = own[d][0] + own[d][1] / 2
        if not split < own[d][0] + own[d][1]:
            return
        node.dim, node.split, node.sides = d, split, [self.fresh(node), self.fresh(node)]
        places, node.places = node.places, []
        for p in places:
            side = node.sides[self.rows[p][1][d] > split]
            side.places.append(p)
            self.widened(side, self.rows[p])
            self.leaf_of[p] = side
        for side in node.sides:
            if len(side.places) > LEAF:
                self.parted(side)

    def drop(self, place: int) -> None:
        leaf = self.leaf_of.pop(place)
        leaf.places.remove(place)
        super().drop(place)
        if len(leaf.places) < FEW and leaf.parent is not None:
            up = leaf.parent
            link = up.sides[up.sides[0] is leaf]
            link.parent = up.parent
            if up.parent is None:
                self.root = link
            else:
                up.parent.sides[up.parent.sides[1] is up] = link
            for p in leaf.places:
                self.into(link, p)

    def away(self, node: Node, seen: list[tuple[int, float, float]], named: list[tuple[int, str]], least: float) -> float:
        """At most the squared distance of any row below: by its box, a missing value there by half the range, and its names.

        ``seen``: the query's numbers with their dimensions and widths; ``least``: what its missing values add anyway.
        """
        total = least
        for d, v, width in seen:
            gap = node.low[d] - v
            if gap < 0:
                gap = v - node.high[d]
            if gap > 0:
                gap = min(gap / width, 0.5) if node.gap[d] else gap / width
                total += gap * gap
        for name in named:
            if name not in node.named:
                total += 1.0
        return total * (1 - SLACK)

    def nearest(self, numbers: tuple[float, ...], names: tuple, k: int) -> list[tuple[float, int]]:
        of, rows, units = self.limits(), self.rows, self.units
        own = unit(numbers, of)
        seen = [(d, v, width) for d, (v, (_, width)) in enumerate(zip(numbers, of, strict=True)) if v == v and width > 0]
        named = [(j, x) for j, x in enumerate(names) if x is not None]
        least = 0.25 * own.count(None) + len(names) - len(named)
        todo, best, most = [(0.0, self.root)], [], math.inf  # best: the k nearest so far, the farthest on top, at ``most``
        while todo:
            far, node = todo.pop()
            while node.dim is not None and not far > most:
                node, other = node.sides
                far, beyond = self.away(node, seen, named, least), self.away(other, seen, named, least)
                if beyond < far:
                    node, other, far, beyond = other, node, beyond, far
                if not beyond > most:
                    todo.append((beyond, other))
            if far > most:
                continue
            self.looked += len(node.places)
            for p in node.places:
                d = squared(own, units[p], names, rows[p][2])
                if len(best) < k:
                    heapq.heappush(best, (-d, -p))
                elif (-d, -p) > best[0]:
                    heapq.heapreplace(best, (-d, -p))
            if len(best) == k:
                most = -best[0][0]
        return sorted((-d, -p) for d, p in best)

    def shape(self) -> str:
        """The splits, and the leaves' rows counted from the oldest."""
        first = {p: i for i, p in enumerate(self.rows)}
        told = lambda n: [first[p] for p in n.places] if n.dim is None else {"d": n.dim, "s": n.split, "l": told(n.sides[0]), "r": told(n.sides[1])}
        return json.dumps(told(self.root))

    def restore(self, rows: list[Row], shape: str) -> None:
        super().restore(rows, shape)
        self.leaf_of = {}

        def made(told, parent: Node | None) -> Node:
            node = self.fresh(parent)
            if isinstance(told, list):
                node.places = told
                for p in told:
                    self.leaf_of[p] = node
                    self.widened(node, self.rows[p])
                return node
            node.dim, node.split = told["d"], told["s"]
            node.sides = [made(told["l"], node), made(told["r"], node)]
            for side in node.sides:
                node.low, node.high = list(map(min, node.low, side.low)), list(map(max, node.high, side.high))
                node.gap = [a or b for a, b in zip(node.gap, side.gap, strict=True)]
                node.named |= side.named
            return node

        self.root = made(json.loads(shape), None)


KINDS = {"ring": Ring, "tree": Tree}
FOUND = "key string, at long, truth string, id long, d2 double, rank int, label string"


class Live(StatefulProcessor):
    """Test, then train, for one key: a full window answers a row, then takes it in.

    A key that gets no row for ``idle_ms`` (None: never) loses its window, by a timer.
    """

    def __init__(self, kind: str, numeric: int, size: int, k: int, idle_ms: int | None) -> None:
        self.kind, self.numeric, self.size, self.k, self.idle_ms = kind, numeric, size, k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("window", "at array<bigint>, numbers array<double>, names array<string>, label array<string>, shape string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = KINDS[self.kind](self.size, self.numeric)
        if self.held.exists():
            at, x, c, y, shape = self.held.get()
            names = len(c) // max(1, len(at))
            window.restore([(a, tuple(math.nan if v is None else v for v in x[i * self.numeric : (i + 1) * self.numeric]), tuple(c[i * names : (i + 1) * names]), y[i]) for i, a in enumerate(at)], shape)
        batch, asked, found = [], [], []
        for part in rows:
            numbers = np.array(part["numbers"].tolist(), float).reshape(len(part), self.numeric).tolist()
            batch += zip(part["at"].tolist(), map(tuple, numbers), map(tuple, part["names"].tolist()), part["label"].tolist(), strict=True)
        for row in sorted(batch, key=itemgetter(0)):
            if len(window.rows) == self.size:
                near = window.nearest(row[1], row[2], self.k)
                asked += [(row[0], row[3])] * len(near)
                found += [(window.rows[p][0], d, r, window.rows[p][3]) for r, (d, p) in enumerate(near, 1)]
            window.add(row)
        every = list(window.rows.values())
        none = lambda v: None if v != v else v
        self.held.update(([r[0] for r in every], [none(v) for r in every for v in r[1]], [v for r in every for v in r[2]], [r[3] for r in every], window.shape()))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        at, truth = zip(*asked, strict=True) if asked else ((), ())
        near, d2, rank, label = zip(*found, strict=True) if found else ((), (), (), ())
        text = lambda values: np.array(values, object)
        yield pd.DataFrame({"key": text([key[0]] * len(at)), "at": np.array(at, np.int64), "truth": text(truth), "id": np.array(near, np.int64), "d2": np.array(d2, float), "rank": np.array(rank, np.int32), "label": text(label)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter([])

    def close(self) -> None: ...


def nearest(stream: DataFrame, key: str, order: str, numeric: list[str], nominal: list[str], label: str, size: int, k: int, kind: str = "tree", idle_ms: int | None = None) -> DataFrame:
    """(key, at, truth, id, d2, rank, label): the k nearest of the last ``size`` rows of a row's key, once there are so many.

    Rows of a micro-batch are taken in the order of ``order``; one without a value there takes no part. ``kind`` names the
    window. Ranges come from the window's rows; see ``squared`` for missing values. Equal distances: the older row first.
    The state store must keep values of several columns, as RocksDB's does.
    """
    numbers, names = F.array(*(F.col(c).cast("double") for c in numeric)), F.array(*(F.col(c).cast("string") for c in nominal)).cast("array<string>")
    rows = stream.filter(F.col(order).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), numbers.alias("numbers"), names.alias("names"), F.col(label).cast("string").alias("label"))
    return rows.groupBy("key").transformWithStateInPandas(Live(kind, len(numeric), size, k, idle_ms), FOUND, "Append", "None" if idle_ms is None else "ProcessingTime")
