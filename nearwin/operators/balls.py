"""Trees of balls for any metric: ball trees and cover trees, and one exact search that goes down either.

A tree is a table of nodes, each a ball around a row that holds the rows below it, in steps from the root; and its members,
each row with its leaf. Nodes are met by equality joins of a node and those below, so no step pairs all queries with all nodes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.operators import compared
from nearwin.operators.knn import ranked, sent, spread
from nearwin.plans.shared import written

#: Rows that a leaf may have, rows of a node that one task splits to the end, and levels of a ball tree that a search goes down at once.
LEAF, WHOLE, STEP = 64, 32_768, 4
#: Nodes of less than this share of a block's rows are no block by themselves.
TINY = 16
#: Levels after which the rows of a ball tree are written.
REWRITE = 4
#: A cover tree's radii are powers of this; rows that are tried at a time as new centres.
BASE, OFFERED = 1.3, 256
#: Candidates that one task settles and rows of a block beyond, new centres that a block meets at a time, and near pairs that one task settles.
TILE, CENTRES, MOST_EDGES = 16_384, 65_536, 1 << 20
#: Rows, and their values, that show how many levels of a cover tree are built at once; the share of them that may be centres; by how much a step has more centres than the one above.
SHOWN, VALUES, SHARE, WIDER = 65_536, 1 << 20, 8, 4
#: Balls are taken to be nearer by this share than they are, against rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Metric:
    """A distance of two arrays of numbers that keeps the triangle inequality, as a column and for arrays of rows."""

    name: str
    column: Callable[[Column, Column, int], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Up to so many dimensions a distance is one expression of all its terms; beyond, a fold over arrays, whose code is short.
UNROLLED = 8


def _folded(a: Column, b: Column, dims: int, term: Callable[[Column], Column], join: Callable[[Column, Column], Column] = lambda s, x: s + x) -> Column:
    if dims > UNROLLED:
        return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double") - y.cast("double"))), F.lit(0.0), join)
    each = lambda i: term(F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)).cast("double"))
    return reduce(lambda s, i: join(s, each(i)), range(1, dims), each(0))


#: The sum of squares that ``euclidean`` roots: searches rank and return it, as it has no rounding of roots.
SQUARES = Metric("squares", lambda a, b, n: _folded(a, b, n, lambda x: x * x), lambda x, y: ((x - y) ** 2).sum(axis=-1))
EUCLIDEAN = Metric("euclidean", lambda a, b, n: F.sqrt(SQUARES.column(a, b, n)), lambda x, y: np.sqrt(SQUARES.rows(x, y)))
MANHATTAN = Metric("manhattan", lambda a, b, n: _folded(a, b, n, F.abs), lambda x, y: np.abs(x - y).sum(axis=-1))
CHEBYSHEV = Metric("chebyshev", lambda a, b, n: _folded(a, b, n, F.abs, lambda s, x: F.greatest(s, x)), lambda x, y: np.abs(x - y).max(axis=-1))
METRICS = {m.name: m for m in (EUCLIDEAN, MANHATTAN, CHEBYSHEV)}


@dataclass(frozen=True)
class Tree:
    """``steps``: tables (node, parent, v, cover, n, leaf), the root's first; ``members``: (id, v, node, cd) of all rows.

    ``v`` is a node's centre, ``cover`` at least its distance to any row below it, ``cd`` a row's distance to its leaf's
    centre. A leaf is in one step only.
    """

    steps: list[DataFrame]
    members: DataFrame
    metric: Metric
    dims: int


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that have an id and a vector without missing values."""
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return spread(df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL").filter(whole))


# --- Ball tree


def split_rows(x: np.ndarray, far: np.ndarray, metric: Metric) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Places of the row farthest from the centre and of the row farthest from that, and all rows' distances to both."""
    a = int(far.argmax())
    to_a = metric.rows(x, x[a])
    b = int(to_a.argmax())
    return a, b, to_a, metric.rows(x, x[b])


def grown(x: np.ndarray, far: np.ndarray, centre: np.ndarray, path: str, leaf: int, metric: Metric) -> list[tuple]:
    """(path, centre, cover, places, distances, whether a leaf) of a node and all below it."""
    out, todo = [], [(path, centre, np.arange(len(x)), far)]
    while todo:
        path, centre, at, far = todo.pop()
        ends = len(at) <= leaf or far.max() == 0
        out.append((path, centre, float(far.max(initial=0.0)), at, far, ends))
        if not ends:
            a, b, to_a, to_b = split_rows(x[at], far, metric)
            left = to_a <= to_b
            todo += [(path + "0", x[at[a]], at[left], to_a[left]), (path + "1", x[at[b]], at[~left], to_b[~left])]
    return out


def ball_tree(df: DataFrame, key: str, vector: str, dims: int, metric: Metric = EUCLIDEAN, leaf: int = LEAF, whole: int = WHOLE) -> Tree:
    """A ball tree: a node of more than ``leaf`` rows that differ is split between two far rows, each row to the nearer one.

    The two are the row farthest from the node's centre and the row farthest from that; they are the new centres. Nodes
    over ``whole`` rows are split level by level, all at once, by aggregates and joins by node; a smaller one is finished in a
    task of its own. Equal distances: the first of the two. Rows without an id or with a missing value take no part.
    """
    rows = vectors(df, key, vector)
    root = rows.agg(F.min_by("v", "id").alias("centre"))
    rows = written(rows.join(F.broadcast(root)).select("id", "v", F.lit("1").alias("path"), metric.column(F.col("v"), F.col("centre"), dims).alias("cd")))
    centres, nodes = [written(root.filter("centre IS NOT NULL").select(F.lit("1").alias("path"), F.col("centre").alias("v")))], []
    while True:
        of = written(rows.groupBy("path").agg(F.max("cd").alias("cover"), F.count(F.lit(1)).alias("n"), F.max_by("v", F.struct("cd", "id")).alias("a")))
        big = written(of.filter((F.col("n") > max(leaf, whole)) & (F.col("cover") > 0)))
        if big.isEmpty():
            break
        nodes.append(big.join(reduce(DataFrame.unionByName, centres), "path").select("path", "v", "cover", "n", F.lit(False).alias("leaf")))
        apart = rows.join(sent(big.select("path", "a")), "path").withColumn("to_a", metric.column(F.col("v"), F.col("a"), dims))
        ends = written(apart.groupBy("path").agg(F.any_value("a").alias("a"), F.max_by("v", F.struct("to_a", "id")).alias("b")))
        centres.append(ends.select(F.concat("path", F.lit("0")).alias("path"), F.col("a").alias("v")).unionByName(ends.select(F.concat("path", F.lit("1")), F.col("b")).toDF("path", "v")))
        apart = rows.join(sent(ends), "path", "left").withColumns({f"to_{e}": metric.column(F.col("v"), F.col(e), dims) for e in "ab"})
        left, stays = F.col("to_a") <= F.col("to_b"), F.col("a").isNull()
        to = F.when(stays, F.col("path")).otherwise(F.concat("path", F.when(left, "0").otherwise("1")))
        rows = apart.select("id", "v", to.alias("path"), F.when(stays, F.col("cd")).otherwise(F.least("to_a", "to_b")).alias("cd"))
        rows = rows if len(nodes) % REWRITE else written(rows)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "v")}

    def finished(group: pd.DataFrame) -> pd.DataFrame:
        """The rows of a node with their leaves, then the nodes below it."""
        centre, group = group.loc[group["centre"], "v"], group[~group["centre"]].sort_values("id", kind="stable")
        x = np.array(group["v"].tolist(), float).reshape(len(group), -1)
        node, cd, made = np.empty(len(group), object), np.zeros(len(group)), []
        for name, at_centre, cover, at, far, ends in grown(x, group["cd"].to_numpy(), np.array(centre.iat[0], float), group["path"].iat[0], leaf, metric) if len(group) else []:
            made.append((group["id"].iat[0], at_centre.tolist(), name, cover, len(at), ends, True))
            if ends:
                node[at], cd[at] = name, far
        held = pd.DataFrame({"id": group["id"], "v": group["v"], "node": node, "cd": cd, "n": 0, "leaf": False, "inner": False})
        return pd.concat([held, pd.DataFrame(made, columns=held.columns)]) if made else held

    heads = reduce(DataFrame.unionByName, centres).join(of.join(big.select("path"), "path", "left_anti").select("path"), "path", "left_semi")
    heads = heads.select(F.lit(0).cast(kinds["id"]).alias("id"), "v", "path", F.lit(0.0).alias("cd"), F.lit(True).alias("centre"))
    groups = rows.withColumn("centre", F.lit(False)).unionByName(heads).groupBy("path")
    ready = written(groups.applyInPandas(finished, f"id {kinds['id']}, v {kinds['v']}, node string, cd double, n long, leaf boolean, inner boolean"))
    members = ready.filter("NOT inner").select("id", "v", "node", "cd")
    below = ready.filter("inner").select(F.col("node").alias("path"), "v", F.col("cd").alias("cover"), "n", "leaf")
    every = written(reduce(DataFrame.unionByName, nodes, below))
    deepest = every.agg(F.max(F.length("path"))).first()[0] or 1
    steps = [every.filter("path = '1'").select(F.col("path").alias("node"), F.lit("").alias("parent"), "v", "cover", "n", "leaf")]
    for length in range(1 + STEP, deepest + STEP, STEP):
        here = every.filter((F.length("path") == length) | (F.col("leaf") & F.length("path").between(length - STEP + 1, length)))
        steps.append(here.select(F.col("path").alias("node"), F.substring("path", 1, length - STEP).alias("parent"), "v", "cover", "n", "leaf"))
    return Tree(steps, members, metric, dims)


# --- Cover tree


def _limit(r: float, metric: Metric) -> tuple[str, float]:
    """The name of the terms that are summed up for ``metric``, and ``r`` as such a sum."""
    return (SQUARES.name, r * r) if metric.name == EUCLIDEAN.name else (metric.name, r)


def separated(x: np.ndarray, r: float, metric: Metric, tile: int) -> np.ndarray:
    """Places of rows, each taken in turn if it is farther than ``r`` from those taken before; ``tile`` rows are tried at a time."""
    name, most = _limit(r, metric)
    todo, taken = np.arange(len(x)), []
    while len(todo):
        some, todo = todo[:tile], todo[tile:]
        rough, err = compared.estimated(x[some], x[some], name)
        near, new = rough <= most + (err[:, None] if np.ndim(err) else err), np.ones(len(some), bool)
        for i in range(len(some)):
            if new[i]:
                new[i + 1 :] &= ~near[i, i + 1 :]
        taken.append(some[new])
        open_rows = np.ones(len(todo), bool)
        step = max(1, compared.TOGETHER // max(1, int(new.sum())))
        for at in range(0, len(todo), step):
            rough, err = compared.estimated(x[todo[at : at + step]], x[some[new]], name)
            open_rows[at : at + step] = (rough > most + (err[:, None] if np.ndim(err) else err)).all(axis=1)
        todo = todo[open_rows]
    return np.concatenate(taken) if taken else todo


def packed(cells: DataFrame, n: str, name: str) -> DataFrame:
    """(c, <name>, <name>_parts): cells in the order of their paths in blocks of about ``TILE`` of ``n``; a larger cell takes several blocks."""
    before = Window.orderBy("path", "c").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell of over ``leaf`` rows
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) / TILE)).cast("int")
    return cells.select("c", F.floor(F.coalesce(F.sum(n).over(before), F.lit(0)) / TILE).cast("long").alias(name), parts.alias(f"{name}_parts"))


def in_block(df: DataFrame, name: str) -> Column:
    return F.col(name) + F.pmod(F.xxhash64("id"), F.col(f"{name}_parts"))


def nets(rows: DataFrame, r: float, metric: Metric, dims: int, tile: int) -> DataFrame:
    """Of the rows that a task holds at a time some, ``r`` apart so that all others are near one: (id, v, up, h), a written table."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "v", "up")}

    def each(batches):
        for batch in batches:
            yield _net(batch, r, metric, dims, tile)

    rows = rows.select("id", "v", "up", F.xxhash64("id").alias("h"))
    return written(rows.mapInPandas(each, f"id {kinds['id']}, v {kinds['v']}, up {kinds['up']}, h long"))


def _net(group: pd.DataFrame, r: float, metric: Metric, dims: int, tile: int) -> pd.DataFrame:
    group = group.sort_values(["h", "id"], kind="stable")
    return group.iloc[separated(compared.matrix(group["v"], dims), r, metric, tile)] if len(group) else group


def settled(few: DataFrame, r: float, metric: Metric, dims: int, tile: int) -> DataFrame:
    """The same of all rows of ``few``, which are at most ``TILE``, in one task."""
    made = few.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda group: _net(group.drop(columns="one"), r, metric, dims, tile), few.schema)
    return written(made)


def apart_from(tried: DataFrame, cells: DataFrame, beside: DataFrame, r: float, metric: Metric, dims: int) -> DataFrame:
    """The rows of ``tried`` that are farther than ``r`` from all kept rows before them, in the order of h and id, as far as one round settles it.

    Rows of blocks with near cells are compared a pair of blocks a task. Few near pairs are settled one after the other; of
    many, a row with any before it waits for the next round.
    """
    name, most = _limit(r, metric)
    sizes = tried.groupBy(F.col("up").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    blocks = written(packed(cells.join(sent(sizes), "c"), "m", "b"))
    if blocks.count() == 1 and blocks.first()["b_parts"] == 1:
        return tried
    side = lambda x: blocks.select(F.col("c").alias(x), F.explode(F.sequence(F.col("b"), F.col("b") + F.col("b_parts") - 1)).alias(f"b{x}"))
    met = beside.join(sent(side("a")), "a").join(sent(side("b")), "b").filter("ba <= bb").select("ba", "bb").distinct()
    met = written(met)
    rows = written(tried.join(sent(blocks.withColumnRenamed("c", "up")), "up").withColumn("block", in_block(tried, "b")).select("id", "v", "up", "h", "block"))
    dealt = lambda x: rows.join(sent(met.withColumn("block", F.col(f"b{x}"))), "block").select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "v", "h", "ba", "bb")))
    kind = tried.schema["id"].dataType.simpleString()

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, out = compared.matrix(a["v_a"], dims), compared.matrix(b["v_b"], dims), []
        ia, ib = a["id_a"].to_numpy(), b["id_b"].to_numpy()
        step = max(1, 4 * compared.TOGETHER // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            rough, err = compared.estimated(x[at : at + step], y, name)
            i, j = np.nonzero(rough <= most + (err[:, None] if np.ndim(err) else err))
            i += at
            out.append((i, j))
        i, j = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
        differ = ia[i] != ib[j]
        i, j = i[differ], j[differ]
        ha, hb = a["h_a"].to_numpy()[i], b["h_b"].to_numpy()[j]
        swap = (hb < ha) | ((hb == ha) & (ib[j] < ia[i]))
        return pd.DataFrame({"id": np.where(swap, ia[i], ib[j]), "h": np.where(swap, ha, hb), "id2": np.where(swap, ib[j], ia[i])})

    edges = written(dealt("a").groupBy("ba_a", "bb_a").cogroup(dealt("b").groupBy("ba_b", "bb_b")).applyInPandas(near, f"id {kind}, h long, id2 {kind}").distinct())
    n = edges.count()
    if not n:
        return tried
    if n > MOST_EDGES:
        return written(tried.join(edges.select("id").distinct(), "id", "left_anti"))

    def gone_after(group: pd.DataFrame) -> pd.DataFrame:
        gone = set()
        for one, of in group.sort_values(["h", "id"], kind="stable").groupby("id", sort=False)["id2"]:
            if any(i not in gone for i in of):
                gone.add(one)
        return pd.DataFrame({"id": list(gone)}, columns=["id"])

    lost = edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(gone_after, f"id {kind}")
    return written(tried.join(lost, "id", "left_anti"))


def closer(x: np.ndarray, cd: np.ndarray, c: np.ndarray, wid: np.ndarray, w: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """``cd`` and ``c`` of rows, each in the cell of a new centre, ascending by id, if that is nearer than its own, or as near with a smaller id."""
    cd, c = cd.copy(), c.copy()
    todo = np.flatnonzero(cd > 0)
    step = max(1, compared.TOGETHER // max(1, len(w)))
    for at in range(0, len(todo) if len(w) else 0, step):
        some = todo[at : at + step]
        wi, d = first_of(x[some], w, name)
        d = np.sqrt(d) if name == SQUARES.name else d
        better = (d < cd[some]) | ((d == cd[some]) & (wid[wi] < c[some]))
        cd[some[better]], c[some[better]] = d[better], wid[wi[better]]
    return cd, c


def first_of(x: np.ndarray, w: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest of ``w``, of equal ones the first, and its distance as summed."""
    rough, err = compared.estimated(x, w, name)
    if not np.ndim(err):
        wi = rough.argmin(axis=1)
        return wi, rough[np.arange(len(x)), wi]
    qi, wi = np.nonzero(rough <= (rough.min(axis=1) + 2 * err)[:, None])
    d = compared.summed(x[qi], w[wi], name)
    order = np.lexsort((wi, d, qi))
    order = order[np.flatnonzero(np.diff(qi[order], prepend=-1))]
    return wi[order], d[order]


def nearer(held: pd.DataFrame, wid: np.ndarray, w: np.ndarray, dims: int, name: str) -> pd.DataFrame:
    cd, c = closer(compared.matrix(held["v"], dims), held["cd"].to_numpy(dtype=float), held["c"].to_numpy(), wid, w, name)
    return held[["id", "v", "up"]].assign(c=c, cd=cd)


def told(rows: DataFrame, won: DataFrame, metric: Metric, dims: int) -> DataFrame:
    """``rows`` (id, v, up, c, cd) with their nearest centres, where the new ones, at most ``TILE``, go out to all tasks: no row is shuffled."""
    new = won.select("id", "v").orderBy("id").collect()
    out = rows.sparkSession.sparkContext.broadcast((np.array([r.id for r in new], None if new and isinstance(new[0].id, int) else object), np.array([r.v for r in new], float).reshape(len(new), dims)))
    name = _limit(0.0, metric)[0]

    def each(batches):
        for batch in batches:
            yield nearer(batch, *out.value, dims, name)

    return written(rows.mapInPandas(each, rows.schema))


def moved(rows: DataFrame, won: DataFrame, cells: DataFrame, beside: DataFrame, metric: Metric, dims: int) -> DataFrame:
    """The same for any number of new centres: a block of rows meets those of near cells in a task, at most about ``CENTRES`` of them at a time."""
    name = _limit(0.0, metric)[0]
    blocks = written(packed(cells, "n", "b"))
    to = beside.join(sent(blocks.select(F.col("c").alias("b"), F.col("b").alias("at"), "b_parts")), "b")
    to = written(to.select("a", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("b_parts") - 1)).alias("block")).distinct())
    new = won.select(F.col("id").alias("w"), F.col("v").alias("wv"), F.col("up").alias("a"))
    parts = max(1, -(-new.count() // CENTRES))
    own = F.col("w").isNotNull()  # a new centre is its own, and meets no other
    rows = rows.join(won.select(F.col("id").alias("w")), F.col("id") == F.col("w"), "left").select("id", "v", "up", F.when(own, F.col("id")).otherwise(F.col("c")).alias("c"), F.when(own, 0.0).otherwise(F.col("cd")).alias("cd"))

    def met(held: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        centres = centres.sort_values("w", kind="stable")
        return nearer(held, centres["w"].to_numpy(), compared.matrix(centres["wv"], dims), dims, name)

    for part in range(parts):
        some = new if parts == 1 else new.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == part)
        meets = some.join(sent(to), "a").select("block", "w", "wv")
        dealt = rows.join(sent(blocks.withColumnRenamed("c", "up")), "up").select("id", "v", "up", "c", "cd", in_block(rows, "b").alias("block"))
        rows = written(dealt.groupBy("block").cogroup(meets.groupBy("block")).applyInPandas(met, rows.schema))
    return rows


def listed(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Arrow's lists of ``dims`` numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


class Near:
    """Centres in the balls of a few of them: a row meets those only that can be within ``r`` of it."""

    def __init__(self, w: np.ndarray, r: float, metric: Metric):
        self.w, self.r, self.metric = w, r, metric
        self.name, self.most = _limit(r, metric)
        self.heads, self.apart, far = [], [], np.full(len(w), np.inf)
        for _ in range(math.isqrt(len(w))):
            self.heads.append(int(far.argmax()))
            self.apart.append(metric.rows(w, w[self.heads[-1]]))
            far = np.minimum(far, self.apart[-1])

    def within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centre, of equal ones the first, and its distance, if that is at most ``r``; else -1."""
        c, d = np.full(len(x), -1), np.full(len(x), np.inf)
        step = max(1, compared.TOGETHER // max(1, len(self.heads)))
        for at in range(0, len(x) if len(self.w) else 0, step):
            some = x[at : at + step]
            rough, err = compared.estimated(some, self.w[self.heads], self.name)
            head = rough.argmin(axis=1)
            far = rough[np.arange(len(some)), head] + 2 * err
            far = np.sqrt(np.maximum(far, 0)) if self.name == SQUARES.name else far
            order = np.argsort(head, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(head[order])) + 1):
                reach = far[rows].max() + min(self.r, far[rows].max())
                met = np.flatnonzero(self.apart[head[rows[0]]] <= reach * (1 + SLACK))
                each = max(1, compared.TOGETHER // max(1, len(met)))
                for i in range(0, len(rows) if len(met) else 0, each):
                    few = rows[i : i + each]
                    wi, near = first_of(some[few], self.w[met], self.name)
                    held = near <= self.most
                    c[at + few[held]], d[at + few[held]] = met[wi[held]], near[held]
        return c, np.sqrt(d) if self.name == SQUARES.name else d


def split_at(level: int, widest: float, base: float) -> int:
    """The next level at which a row as far as ``widest`` from its centre gives a new one."""
    return min(level - 1, math.ceil(math.log(widest, base)) - 1)


def shown(x: np.ndarray, h: np.ndarray, w: np.ndarray, level: int, most: float, metric: Metric, base: float, tile: int) -> tuple[int, np.ndarray] | None:
    """(level, places): how deep the rows ``x`` show a tree can be built at once from the centres ``w``, and those of them that are new centres there.

    That is where a cell has at most ``most`` of them, or else the last level with few enough centres; None if even ``level``, the first, has too many.
    """
    name, order = _limit(0.0, metric)[0], np.argsort(h, kind="stable")
    near = Near(w, math.inf, metric)
    c, cd = near.within(x)
    taken, out = np.zeros(0, int), None
    while True:
        new = order[cd[order] > base**level]
        new = new[separated(x[new], base**level, metric, tile)]
        if len(w) + len(taken) + len(new) > max(1, SHOWN // SHARE, 2 * len(w)) or (len(taken) + len(new)) * x.shape[1] > VALUES // SHARE:
            return out
        cd, c = closer(x, cd, c, np.arange(len(new)) + len(w) + len(taken), x[new], name)
        taken = np.concatenate([taken, new])
        out = level, taken
        sizes = np.bincount(c, minlength=len(w) + len(taken))
        large = sizes[c] > most
        if not large.any() or cd[large].max() == 0:
            return out
        level = split_at(level, float(cd[large].max()), base)


def leapt(points: DataFrame, n: int, w: np.ndarray, level: int, whole: int, metric: Metric, dims: int, base: float, tile: int) -> tuple[int, list, np.ndarray] | None:
    """(level, ids, vectors) of new centres of ``points`` (id, v, ..), from ``level`` on down to one where most cells have at most ``whole`` rows.

    At most ``SHOWN`` rows show which level that is; of all rows, those not within its radius of a centre give new ones, round by
    round, until none is left. New centres go out to all tasks; None if there are too many for that.
    """
    few = min(SHOWN, VALUES // dims)
    hashed = points.select("id", "v", F.xxhash64("id").alias("h"))
    some = hashed.filter(F.pmod("h", F.lit(max(1, n // few))) == 0).toArrow().sort_by([("h", "ascending")])
    x = listed(some["v"], dims)
    start = shown(x, some["h"].to_numpy(), w, level, whole * len(x) / n, metric, base, tile)
    if start is None:
        return None
    level, r = start[0], base ** start[0]
    ids, new = some["id"].take(start[1]).to_pylist(), x[start[1]]
    most, (name, limit) = max(few, 2 * len(w)), _limit(r, metric)
    each, spark = max(64, few // max(1, hashed.rdd.getNumPartitions())), points.sparkSession
    while len(w) + len(ids) <= most:
        held = spark.sparkContext.broadcast(np.concatenate([w, new]))

        def opened(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            """Rows that are near no centre and not near each other; of many in a task the first, the others are tried again."""
            near, tried = Near(held.value, r, metric), np.zeros((0, dims))
            for batch in batches:
                if len(tried) >= each:
                    continue
                x = listed(batch.column("v"), dims)
                at = np.flatnonzero(near.within(x)[0] < 0)
                at = at[Near(tried, r, metric).within(x[at])[0] < 0]
                at = at[np.argsort(batch.column("h").to_numpy()[at], kind="stable")]
                at = at[separated(x[at], r, metric, tile)][: each - len(tried)]
                tried = np.concatenate([tried, x[at]])
                yield batch.take(pa.array(at))

        found = hashed.mapInArrow(opened, hashed.schema).toArrow().sort_by([("h", "ascending")])
        held.unpersist()
        if not len(found):
            return level, ids, new
        x = listed(found["v"], dims)
        kept = separated(x, r, metric, tile)
        ids, new = ids + found["id"].take(kept).to_pylist(), np.concatenate([new, x[kept]])
    return None


def ranked_levels(w: np.ndarray, new: np.ndarray, level: int, last: int, metric: Metric, base: float, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, parent) of the centres ``new``, of which ``w`` are above: each level takes those that far apart, and a parent is the nearest of the levels above.

    All of ``new`` are farther than the radius of ``last`` from each other and from ``w``. Parents are places in ``w`` and then ``new``.
    """
    name = _limit(0.0, metric)[0]
    c, cd = Near(w, math.inf, metric).within(new)
    at_level, parent = np.full(len(new), last), c.copy()
    todo = np.arange(len(new))
    while len(todo):
        r = base**level
        picked = todo[cd[todo] > r]
        picked = picked[separated(new[picked], r, metric, tile)] if level > last else todo
        at_level[picked], parent[picked] = level, c[picked]
        todo = np.setdiff1d(todo, picked)
        if len(todo):
            cd[todo], c[todo] = closer(new[todo], cd[todo], c[todo], len(w) + picked, new[picked], name)
            level = max(last, split_at(level, float(cd[todo].max()), base))
    return at_level, parent


def finished_cell(x: np.ndarray, h: np.ndarray, cd: np.ndarray, top: int, level: int, leaf: int, metric: Metric, base: float, tile: int) -> tuple[np.ndarray, np.ndarray, list[tuple], list[tuple]]:
    """The rows of the cell of the row ``top``, ascending by id, down to its leaves: their centres, their distances from them, nodes and new centres.

    Nodes are (step, centre, parent, cover, n, leaf), the first step's being the cell's children; new centres (place, level, parent). All
    are places of rows. Steps are as far apart as the tree needs to have ``WIDER`` times the cells.
    """
    name = _limit(0.0, metric)[0]
    c, order, made, nodes, steps = np.full(len(x), top), np.argsort(h, kind="stable"), [], [], []
    up, live, pending = {top: top}, np.ones(len(x), bool), {top}
    above = 1
    while True:
        level = split_at(level, float(cd[live].max()), base)
        new = order[live[order] & (cd[order] > base**level)]
        new = np.sort(new[separated(x[new], base**level, metric, tile)])
        for i in new.tolist():
            made.append((i, level, int(c[i])))
            up[i] = up[int(c[i])]
        at = np.flatnonzero(live)
        cd[at], c[at] = closer(x[at], cd[at], c[at], new, x[new], name)
        pending.update(new.tolist())
        n = np.bincount(c, minlength=len(x))
        rad = np.zeros(len(x))
        np.maximum.at(rad, c, cd)
        live = live & (n[c] > leaf) & (rad[c] > 0)
        if not live.any() or len(pending) >= WIDER * above:
            going = set(np.unique(c[live]).tolist())
            steps.append({i: (up[i], i not in going) for i in pending})
            above, pending = max(1, len(going)), going
            up = {i: i for i in going}
            if not going:
                break
    at = c.copy()
    for step in range(len(steps) - 1, -1, -1):
        here = np.array(sorted(steps[step]))
        mine = np.isin(at, here)
        d = compared.summed(x[mine], x[at[mine]], name)
        cover, n = np.zeros(len(x)), np.bincount(at[mine], minlength=len(x))
        np.maximum.at(cover, at[mine], np.sqrt(d) if name == SQUARES.name else d)
        nodes += [(step, i, steps[step][i][0], float(cover[i]), int(n[i]), steps[step][i][1]) for i in here.tolist()]
        above = np.arange(len(x))
        above[here] = [steps[step][i][0] for i in here.tolist()]
        at = np.where(mine, above[at], at)
    return c, cd, nodes, made


def finished_cells(rows: DataFrame, leaf: int, metric: Metric, dims: int, base: float, tile: int) -> DataFrame:
    """(id, v, c, cd, up, n, leaf, step, level) of ``rows`` (id, v, c, cd, level, step), cells of which each is built to the end in a task.

    First the rows, whose step is null, with their leaves ``c``; then the nodes ``c`` below ``up`` with their cover as ``cd``, and their level where they are new.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "v")}
    schema = f"id {kinds['id']}, v {kinds['v']}, c {kinds['id']}, cd double, up {kinds['id']}, n long, leaf boolean, step int, level int"

    def finished(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("id", "ascending")])
        x, at, step = listed(cell["v"], dims), cell["level"][0].as_py(), cell["step"][0].as_py()
        top = cell["id"].index(cell["c"][0]).as_py()
        c, cd, nodes, made = finished_cell(x, cell["h"].to_numpy(), cell["cd"].to_numpy().copy(), top, at, leaf, metric, base, tile)
        born, first = {i: of for i, *of in made}, {}
        for of in sorted(nodes):
            first.setdefault(of[1], of[0])
        ids = cell["id"]
        none = lambda n, kind: pa.nulls(n, kind)
        held = [ids, cell["v"], ids.take(pa.array(c)), pa.array(cd), none(len(x), ids.type), none(len(x), pa.int64()), none(len(x), pa.bool_()), none(len(x), pa.int32()), none(len(x), pa.int32())]
        node = pa.array([of[1] for of in nodes], pa.int64())
        parent = pa.array([of[2] for of in nodes], pa.int64())
        new = [born[of[1]] if of[1] in born and first[of[1]] == of[0] else (None, None) for of in nodes]
        parents = pa.array([p for _, p in new], pa.int64())
        inner = [ids.take(parents), cell["v"].take(node), ids.take(node), pa.array([of[3] for of in nodes], pa.float64()), ids.take(parent), pa.array([of[4] for of in nodes], pa.int64()), pa.array([of[5] for of in nodes], pa.bool_()), pa.array([step + 1 + of[0] for of in nodes], pa.int32()), pa.array([level for level, _ in new], pa.int32())]
        names = ["id", "v", "c", "cd", "up", "n", "leaf", "step", "level"]
        return pa.concat_tables([pa.table(held, names), pa.table(inner, names)])

    rows = rows.select("id", "v", "c", "cd", "level", "step", F.xxhash64("id").alias("h"))
    return written(rows.groupBy("c").applyInArrow(finished, schema))


def cover_tree(df: DataFrame, key: str, vector: str, dims: int, metric: Metric = EUCLIDEAN, leaf: int = LEAF, base: float = BASE, offered: int = OFFERED, whole: int = WHOLE) -> tuple[Tree, DataFrame]:
    """(tree, centres): a cover tree, built breadth first, and its centres (id, v, level, parent).

    The root covers all rows. At level i, centres of the levels above stay (nesting), and what is farther than base^i from all
    centres gives new ones until nothing is left (covering), more than base^i apart (separation). Levels are built in leaps: rows show at
    which level most cells have at most ``whole`` rows; there all rows give centres, and of these centres the levels between are made, where
    therefore centres are covered, as a parent covers its children. Where a level has too many centres to go out to all tasks, it is built by itself,
    in rounds: each task picks candidates that far apart from its open rows, ``offered`` tried at a time, and of candidates that are near the
    first in the order of a hash stays. Up to ``TILE`` candidates are settled in one task and go out to all rows; more are
    compared, and meet rows, in blocks of near cells, so no pair of rows or centres becomes a row, but of cells that are split
    on and of candidates that are near. A cell of at most ``whole`` rows is finished in a task of its own, by the same rules among its
    rows alone: below it centres are separated from those of the same cell only, not from those of other cells, as in a simplified cover tree; ``whole=0`` has
    them separated from all. A row belongs to the nearest centre of its cell. A cell of at most ``leaf`` rows, or of equal
    rows, is a leaf; its rows give no centres any more. Levels at which nothing is open are passed over. Rows without an id or
    with a missing value take no part. Equal distances: the centre with the smaller id.
    """
    apart = lambda a, b: metric.column(F.col(a), F.col(b), dims)
    spark = df.sparkSession
    given = vectors(df, key, vector)
    given = written(given if given.schema["v"].dataType.elementType.typeName() in ("float", "double") else given.withColumn("v", F.col("v").cast("array<double>")))
    root = given.agg(F.min(F.struct("id", "v")).alias("r")).select("r.*").filter("id IS NOT NULL")
    ids, kinds = given.schema["id"].dataType, {c: given.schema[c].dataType.simpleString() for c in ("id", "v")}
    here = written(root.select(F.col("id").alias("c"), F.col("v").alias("cv"), F.lit(None).cast(ids).alias("up"), F.lit("").alias("path")))
    points = given.join(F.broadcast(here)).select("id", "v", "c", apart("v", "cv").alias("cd"))
    reach = points.agg(F.max("cd")).first()[0] or 0.0
    level = math.ceil(math.log(reach, base)) if reach > 0 else 0
    found = [root.select("id", "v", F.lit(level).alias("level"), F.lit(None).cast(ids).alias("parent"))]
    done, small, levels, kin = [], [], [], []
    while True:
        sizes = points.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("cd").alias("rad"))
        ends = (F.col("n") <= leaf) | (F.col("rad") == 0)
        cells = written(here.join(sent(sizes), "c").withColumns({"leaf": ends, "own": ends | (F.col("n") <= whole)}))
        live = written(cells.filter("NOT own"))
        levels.append(cells.select("c", "cv", "n", "rad", "leaf", "own"))
        of = live.agg(F.max("rad").alias("widest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
        done.append(points.join(sent(cells.filter("leaf").select("c")), "c", "left_semi").select("id", "v", "c", "cd"))
        kept = cells.filter("own AND NOT leaf").select("c", F.lit(level).alias("level"), F.lit(len(levels) - 1).alias("step"))
        small.append(points.join(sent(kept), "c").select("id", "v", "c", "cd", "level", "step"))
        if of["widest"] is None:
            break
        was, level = base**level, split_at(level, of["widest"], base)
        points = points.join(sent(live.select("c")), "c", "left_semi").select("id", "v", F.col("c").alias("up"), "c", "cd")
        leap = None
        if whole and of["cells"] <= min(SHOWN, VALUES // dims) // SHARE:
            seeds = live.select("c", "cv", "path").orderBy("c").collect()
            w = np.array([s.cv for s in seeds], float).reshape(-1, dims)
            leap = leapt(points, of["n"], w, level, whole, metric, dims, base, offered)
        if leap:
            last, new, at = leap
            at_level, parent = ranked_levels(w, at, level, last, metric, base, offered)
            level = last
            names, at = [s.c for s in seeds] + new, np.concatenate([w, at])
            at_level, parent = np.concatenate([np.full(len(w), math.inf), at_level]), np.concatenate([np.arange(len(w)), parent])
            made = [(names[i], at[i].tolist(), int(at_level[i]), names[parent[i]]) for i in range(len(w), len(at))]
            found.append(spark.createDataFrame(made, f"id {kinds['id']}, v {kinds['v']}, level int, parent {kinds['id']}"))
            upper, paths = np.arange(len(w)), [s.path for s in seeds] + [""] * len(new)
            for i in sorted(range(len(w), len(at)), key=lambda i: -at_level[i]):
                paths[i] = paths[parent[i]] + f"{zlib.crc32(str(names[i]).encode()) % 256:02x}"
            for step in sorted({*at_level[len(w) :].tolist(), last}, reverse=True):
                members = np.flatnonzero(at_level >= step)
                if step > last and len(members) < WIDER * len(upper):
                    continue
                over, ups = set(upper.tolist()), []
                for i in members.tolist():
                    while i not in over:
                        i = int(parent[i])
                    ups.append(i)
                cells = [(names[i], at[i].tolist(), names[u], paths[i]) for i, u in zip(members.tolist(), ups, strict=True)]
                here = written(spark.createDataFrame(cells, f"c {kinds['id']}, cv {kinds['v']}, up {kinds['id']}, path string"))
                kin.append(here.select("c", "cv", "up"))
                if step > last:
                    levels.append(here.select("c", "cv", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("rad"), F.lit(False).alias("leaf"), F.lit(False).alias("own")))
                upper = members
            points = placed_in(points, names, at, base**last, metric, dims)
            continue
        r, made, beside = base**level, [], None
        while True:
            few = nets(points.filter(F.col("cd") > r), r, metric, dims, offered)
            tried = few.count()
            if not tried:
                break
            if tried <= TILE:
                won = settled(few, r, metric, dims, offered)
                points = told(points, won, metric, dims)
            else:
                if beside is None:  # a centre and a row that it may take lie in such cells
                    pairs = live.select(F.col("c").alias("a"), F.col("cv").alias("av")).join(live.select(F.col("c").alias("b"), F.col("cv").alias("bv")), apart("av", "bv") <= 3 * was * (1 + SLACK))
                    beside = written(pairs.select("a", "b"))
                won = apart_from(few, live, beside, r, metric, dims)
                points = moved(points, won, live, beside, metric, dims)
            made.append(won.select("id", "v", "up"))
        new, points = reduce(DataFrame.unionByName, made), points.drop("up")
        path = new.join(sent(live.select(F.col("c").alias("up"), "path")), "up").select(F.col("id").alias("c"), F.col("v").alias("cv"), "up", F.concat("path", F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(256))), 2, "0")).alias("path"))
        here = written(path.unionByName(live.select("c", "cv", F.col("c").alias("up"), F.concat("path", F.lit("--")).alias("path"))))
        kin.append(here.select("c", "cv", "up"))
        found.append(here.filter("c <> up").select(F.col("c").alias("id"), F.col("cv").alias("v"), F.lit(level).alias("level"), F.col("up").alias("parent")))
    below = finished_cells(reduce(DataFrame.unionByName, small), leaf, metric, dims, base, offered)
    inner = below.filter("step IS NOT NULL")
    found.append(inner.filter("level IS NOT NULL").select(F.col("c").alias("id"), "v", "level", F.col("id").alias("parent")))
    rows = reduce(DataFrame.unionByName, done).unionByName(below.filter("step IS NULL").select("id", "v", "c", "cd"))
    members = written(rows.select("id", "v", F.col("c").cast("string").alias("node"), "cd"))
    steps = _covered(levels, kin, apart)
    nodes = inner.select("step", F.col("c").cast("string").alias("node"), F.col("up").cast("string").alias("parent"), "v", F.col("cd").alias("cover"), "n", "leaf")
    deepest = nodes.agg(F.max("step")).first()[0] or 0
    for step in range(1, deepest + 1):
        mine = nodes.filter(F.col("step") == step).drop("step")
        steps[step : step + 1] = [steps[step].unionByName(mine) if step < len(steps) else mine]
    return Tree(steps, members, metric, dims), reduce(DataFrame.unionByName, found)


def placed_in(points: DataFrame, names: list, w: np.ndarray, r: float, metric: Metric, dims: int) -> DataFrame:
    """(id, v, c, cd): ``points`` with their nearest centres, all within ``r``; a written table."""
    order = sorted(range(len(names)), key=names.__getitem__)
    out = points.sparkSession.sparkContext.broadcast(([names[i] for i in order], w[order]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, near = None, Near(out.value[1], r, metric)
        for batch in batches:
            names = names if names is not None else pa.array(out.value[0], batch.column("id").type)
            c, cd = near.within(listed(batch.column("v"), dims))
            assert (c >= 0).all(), "a row is near no centre"
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), names.take(pa.array(c)), pa.array(cd)], ["id", "v", "c", "cd"])

    given = points.select("id", "v")
    kinds = {c: given.schema[c].dataType.simpleString() for c in ("id", "v")}
    return written(given.mapInArrow(each, f"id {kinds['id']}, v {kinds['v']}, c {kinds['id']}, cd double"))


def _covered(levels: list[DataFrame], kin: list[DataFrame], apart) -> list[DataFrame]:
    """The steps of a cover tree, each ball wide enough for its children's, from the last level up.

    ``levels``: cells (c, cv, n, rad, leaf, own) when each level was finished, ``own`` if their rows stay theirs to the end; ``kin``: centres
    (c, cv, up) of each level but the first. A centre that goes on is a node of each level until its cell is a leaf.
    """
    below, steps = None, []
    for i in range(len(levels) - 1, -1, -1):
        cells = levels[i].select("c", "cv", "n", "rad", "leaf", "own")
        if below is not None:
            wide = below.join(cells.select(F.col("c").alias("up"), F.col("cv").alias("upv")), "up")
            wide = wide.groupBy("up").agg(F.max(apart("cv", "upv") + F.col("cover")).alias("wide"), F.sum("n").alias("rows"))
            cells = cells.join(wide, F.col("c") == F.col("up"), "left").drop("up")
            cells = cells.withColumns({"cover": F.when(F.col("own"), F.col("rad")).otherwise(F.col("wide")), "n": F.when(F.col("own"), F.col("n")).otherwise(F.col("rows"))})
        else:
            cells = cells.withColumn("cover", F.col("rad"))
        cells = cells.join(kin[i - 1].select("c", "up"), "c") if i else cells.withColumn("up", F.lit(None).cast(cells.schema["c"].dataType))
        below = written(cells.select("c", "cv", "n", "cover", "leaf", "up"))
        steps.append(below.select(F.col("c").cast("string").alias("node"), F.coalesce(F.col("up").cast("string"), F.lit("")).alias("parent"), F.col("cv").alias("v"), "cover", "n", "leaf"))
    return steps[::-1]


# --- Search


def _bounded(front: DataFrame, k: int) -> DataFrame:
    """``front`` without the balls beyond a distance within which its other balls hold k rows for sure."""
    sure = Window.partitionBy("qid").orderBy(F.col("d") + F.col("cover"), "node").rowsBetween(Window.unboundedPreceding, 0)
    far = F.min(F.when(F.col("held") >= k, F.col("d") + F.col("cover"))).over(Window.partitionBy("qid"))
    held = front.withColumn("held", F.sum("n").over(sure)).withColumn("bound", far)
    return held.filter(F.col("bound").isNull() | (F.col("d") - F.col("cover") <= F.col("bound") * (1 + SLACK))).drop("held")


def reached(tree: Tree, queries: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(qid, qv, node, d, cover, n, bound, leaf) of the leaves that can hold a k nearest row, and each step's balls met."""
    asked = vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    to = lambda df: df.withColumn("d", tree.metric.column(F.col("qv"), F.col("v"), tree.dims)).drop("v", "parent")
    front = written(to(asked.join(F.broadcast(tree.steps[0]))))  # one root
    looked = [front]
    for step in tree.steps[1:]:
        inner = front.filter(~F.col("leaf")).select("qid", "qv", F.col("node").alias("parent"))
        met = to(inner.join(sent(step), "parent"))
        looked.append(met)
        front = written(_bounded(front.filter("leaf").select(met.columns).unionByName(met), k).drop("bound"))
    return _bounded(front, k), looked


def pairs_met(tree: Tree, leaves: DataFrame, k: int) -> DataFrame:
    """(qid, id, shown, at): rows compared with each query and their distances: first of the nearest leaves with k rows, then of those still in reach.

    A row is compared only if its own distance from the leaf's centre and the query's leave it a chance.
    """
    within = Window.partitionBy("qid").orderBy("d", "node").rowsBetween(Window.unboundedPreceding, -1)
    leaves = written(leaves.withColumn("home", F.coalesce(F.sum("n").over(within), F.lit(0)) < k))
    exact = SQUARES if tree.metric is EUCLIDEAN else tree.metric
    measured = lambda df: df.select("qid", "id", exact.column(F.col("qv"), F.col("v"), tree.dims).alias("shown"))
    root = F.sqrt(F.col("shown")) if tree.metric is EUCLIDEAN else F.col("shown")
    chance = lambda b: F.col(b).isNull() | (F.abs(F.col("d") - F.col("cd")) <= F.col(b) * (1 + SLACK))
    first = written(measured(tree.members.join(sent(leaves.filter("home")), "node").filter(chance("bound"))).withColumn("at", root))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    kth = first.withColumn("place", place).filter(F.col("place") == k).select("qid", F.col("at").alias("kth"))
    rest = leaves.filter(~F.col("home")).join(kth, "qid", "left").withColumn("bound", F.least("bound", "kth"))
    rest = rest.filter(F.col("bound").isNull() | (F.col("d") - F.col("cover") <= F.col("bound") * (1 + SLACK)))
    second = measured(tree.members.join(sent(rest), "node").filter(chance("bound"))).withColumn("at", root)
    return first.unionByName(second)


def topped(tree: Tree, most: int) -> tuple[Tree, DataFrame]:
    """The tree down to its blocks, the first nodes of at most ``most`` rows, as leaves; and (node, block, v, n, cover) of its leaves.

    Nodes of less than ``most`` / ``TINY`` rows below one are blocks together, in its ball: it may have thousands of them, which all queries would meet.
    """
    steps, leaves, above = [], [], None
    for step in tree.steps:
        first, tiny = F.col("leaf") | (F.col("n") <= most), F.col("n") < most / TINY
        if above is None:
            mine = step.withColumns({"up": F.lit(None).cast("string"), "block": F.when(first, F.col("node")), "pv": F.col("v"), "pcover": F.col("cover")})
        else:
            before = F.sum(F.when(tiny & F.col("up").isNull(), F.col("n"))).over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
            together = F.concat("parent", F.lit("#"), F.floor(F.coalesce(before, F.lit(0)) / (most - most / TINY)).cast("string"))
            mine = step.join(above.select(F.col("node").alias("parent"), F.col("block").alias("up"), F.col("v").alias("pv"), F.col("cover").alias("pcover")), "parent")
            mine = mine.withColumn("block", F.coalesce("up", F.when(first, F.when(tiny, together).otherwise(F.col("node")))))
        mine = written(mine)
        shown = mine.filter("up IS NULL").withColumn("alone", F.col("block").isNull() | (F.col("block") == F.col("node")))
        alone = shown.filter("alone").select("node", "parent", "v", "cover", "n", F.col("block").isNotNull().alias("leaf"))
        grouped = shown.filter("NOT alone").groupBy(F.col("block").alias("node"), "parent").agg(F.any_value("pv").alias("v"), F.any_value("pcover").alias("cover"), F.sum("n").alias("n"))
        steps.append(alone.unionByName(grouped.withColumn("leaf", F.lit(True))))
        leaves.append(mine.filter("leaf").select("node", "block", "v", "n", "cover"))
        above = mine.filter("NOT leaf")
    return Tree(steps, tree.members, tree.metric, tree.dims), written(reduce(DataFrame.unionByName, leaves))


def nearest(tree: Tree, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(qid, id, d2, rank): exactly the k nearest rows of each query, equal distances by id.

    Balls are met from the root down to blocks of at most ``compared.BLOCK`` rows. At each step, balls that hold k rows give
    a bound that others must not be beyond; the nearest block gives the k-th distance there, which bounds the rest. A
    block and the queries that reach it meet in a task, where the triangle inequality decides which rows of its leaves are compared.
    Of equal rows that are a block by themselves, those with the k smallest ids are met. ``d2`` is the squared distance for the Euclidean
    metric, the distance for others. Queries with a missing value are left out.
    """
    name = SQUARES.name if tree.metric is EUCLIDEAN else tree.metric.name
    top, inside = topped(tree, compared.BLOCK)
    blocks = written(reached(top, queries, key, vector, k)[0])
    held = tree.members.join(sent(inside.select("node", "block")), "node").select("block", "id", "v", "node", "cd", F.lit(False).alias("centre"))
    same = inside.filter((F.col("n") > compared.BLOCK) & (F.col("cover") == 0)).select("node")
    if not same.isEmpty():
        place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
        few = held.join(sent(same), "node", "left_semi").withColumn("place", place).filter(F.col("place") <= k)
        held = held.join(sent(same), "node", "left_anti").unionByName(few.select(held.columns))
    centres = inside.select("block", F.lit(0).cast(held.schema["id"].dataType).alias("id"), "v", "node", F.lit(0.0).alias("cd"), F.lit(True).alias("centre"))
    held = held.unionByName(centres)
    blocks = written(blocks.withColumn("home", F.row_number().over(Window.partitionBy("qid").orderBy("d", "node")) == 1))
    meets = lambda df: df.select(F.col("node").alias("block"), "qid", "qv", "bound")
    found = written(compared.nearest(held, meets(blocks.filter("home")), k, tree.dims, name, balls=True))
    far = compared.kth(found, k).withColumn("kth", F.sqrt("kth") if tree.metric is EUCLIDEAN else F.col("kth"))
    rest = blocks.filter("NOT home").join(far, "qid", "left").withColumn("bound", F.least("bound", "kth"))
    rest = written(rest.filter(F.col("bound").isNull() | (F.col("d") - F.col("cover") <= F.col("bound") * (1 + SLACK))))
    return ranked(found.unionByName(compared.nearest(held, meets(rest), k, tree.dims, name, balls=True)), k)


def statistics(tree: Tree, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(qid, balls, points, coordinates): distances to centres and to rows that a search node by node computes for each query, and the values they take."""
    leaves, looked = reached(tree, queries, key, vector, k)
    balls = reduce(DataFrame.unionByName, (s.select("qid") for s in looked)).groupBy("qid").agg(F.count(F.lit(1)).alias("balls"))
    points = pairs_met(tree, leaves, k).groupBy("qid").agg(F.count(F.lit(1)).alias("points"))
    return balls.join(points, "qid", "left").select("qid", "balls", F.coalesce("points", F.lit(0)).alias("points"), ((F.col("balls") + F.coalesce("points", F.lit(0))) * tree.dims).alias("coordinates"))
