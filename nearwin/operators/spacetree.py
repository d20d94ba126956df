"""Space-partitioning trees: large nodes one level of all at a time, small ones each in a task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.operators import blocks, compared
from nearwin.operators.knn import ranked, sent, spread, with_bounds
from nearwin.plans.shared import written

#: A node with more rows than this is split, if they differ.
LEAF = 4
#: A node of up to so many rows is finished in one task.
WHOLE = 32_768
#: Rows that a search's leaf may have, and levels that it goes down at once.
SEARCH_LEAF, STEP = 512, 6
#: Levels of a random projection tree at most.
DEEPEST = 60
#: Rows of the sample that splits nodes of over WHOLE rows, about.
FITTED = 32_768
#: Levels after which the rows are written.
REWRITE = 4


def node_table(df: DataFrame, dims: tuple[str, ...], leaf: int = LEAF) -> DataFrame:
    """(path, level, n, dim, split) of all nodes: the widest dimension (of equals the first) and its middle, null for a leaf."""
    of = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *(x for d in dims for x in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))))
    width = lambda d: F.coalesce(F.col(f"{d}_max") - F.col(f"{d}_min"), F.lit(0.0))
    widest = F.greatest(*map(width, dims)) if len(dims) > 1 else width(dims[0])
    pick = lambda value: reduce(lambda rest, d: F.when(width(d) == widest, value(d)).otherwise(rest), reversed(dims), F.lit(None))
    split, top = pick(lambda d: F.col(f"{d}_min") + width(d) / 2), pick(lambda d: F.col(f"{d}_max"))
    splits = (F.col("n") > leaf) & (widest > 0) & (split < top)
    level = (F.length("path") - 1).cast("int")
    return of.select("path", level.alias("level"), "n", F.when(splits, pick(lambda d: F.lit(d))).alias("dim"), F.when(splits, split).alias("split"))


def grown(x: np.ndarray, path: str, leaf: int) -> tuple[list, list]:
    """(leaves, nodes) below one node by the same rule: (path, places of rows) and (path, n, dimension, split)."""
    leaves, nodes, todo = [], [], [(path, np.arange(len(x)))]
    while todo:
        path, at = todo.pop()
        seen = ~np.isnan(x[at])
        low = np.where(seen, x[at], np.inf).min(axis=0, initial=np.inf)
        high = np.where(seen, x[at], -np.inf).max(axis=0, initial=-np.inf)
        width = np.where(high >= low, high - low, 0.0)
        d = int(width.argmax())
        split = low[d] + width[d] / 2
        if len(at) > leaf and width[d] > 0 and split < high[d]:
            nodes.append((path, len(at), d, split))
            right = x[at, d] > split
            todo += [(path + "0", at[~right]), (path + "1", at[right])]
        else:
            leaves.append((path, at))
    return leaves, nodes


def chosen(dims: tuple[str, ...]) -> Column:
    """The row's value in its node's dimension."""
    return F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims))


def build(df: DataFrame, key: str, dims: tuple[str, ...], leaf: int = LEAF, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(assigned, nodes): rows with the path of their leaf, and all split nodes.

    A node is split while it holds more than ``leaf`` rows that differ. A path is the text 1, then a digit a level: 0 for
    values up to the split. A missing value (or NaN) goes left. Nodes of more than ``whole`` rows are split level by level,
    all at once, by an aggregate by path; each smaller one is finished by itself in one task.
    """
    rows = df.select(key, *(F.nanvl(F.col(d).cast("double"), F.lit(None)).alias(d) for d in dims), F.lit("1").alias("path"))
    rows = written(spread(rows))
    nodes, whole, level = [], max(leaf, whole), 0
    while True:
        of = written(node_table(rows, dims, leaf).filter("dim IS NOT NULL"))
        big = of.filter(F.col("n") > whole)
        if big.isEmpty():
            break
        nodes.append(big)
        joined = rows.join(sent(big.select("path", "dim", "split")), "path", "left")
        step = F.when(F.col("dim").isNull(), F.col("path")).otherwise(F.concat("path", F.when(chosen(dims) > F.col("split"), "1").otherwise("0")))
        rows, level = joined.select(key, *dims, step.alias("path")), level + 1
        rows = rows if level % REWRITE else written(rows)
    if leaf >= whole:
        return written(rows), reduce(DataFrame.union, nodes, of)
    small = sent(of.select("path"))
    rows = written(rows)
    groups = rows.join(small, "path", "left_semi").groupBy("path")

    def finished(group: pd.DataFrame) -> pd.DataFrame:
        paths = np.empty(len(group), dtype=object)
        for path, at in grown(group[[*dims]].to_numpy(dtype=float), group["path"].iat[0], leaf)[0]:
            paths[at] = path
        return group.assign(path=paths)

    def inner(group: pd.DataFrame) -> pd.DataFrame:
        made = grown(group[[*dims]].to_numpy(dtype=float), group["path"].iat[0], leaf)[1]
        return pd.DataFrame([(p, len(p) - 1, n, dims[d], s) for p, n, d, s in made], columns=["path", "level", "n", "dim", "split"])

    ready = rows.join(small, "path", "left_anti").unionByName(groups.applyInPandas(finished, rows.schema))
    return ready, reduce(DataFrame.union, nodes, groups.applyInPandas(inner, of.schema))


def leaf_boxes(assigned: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    return assigned.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *(x for d in dims for x in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))))


def tree_nearest(df: DataFrame, queries: DataFrame, key: str, dims: tuple[str, ...], k: int, leaf: int = SEARCH_LEAF, whole: int = WHOLE) -> DataFrame:
    """(qid, id, d2, rank): exactly the k nearest by raw distance, from the leaves that can hold them.

    Queries are rows of ``df``; rows and queries with a missing value have no distance and are left out. The k-th distance
    in a query's own leaf (else in a sample) bounds the search. It goes down ``STEP`` levels at a time, to
    the nodes whose boxes are not farther, by equality joins of a node and those below.
    """
    assigned, _ = build(df.dropna(subset=list(dims)), key, dims, leaf, whole)
    rows = written(assigned).withColumnRenamed(key, "id")
    sides = queries.dropna(subset=list(dims)).select(F.col(key).alias("qid"), *(F.col(d).cast("double").alias(f"q_{d}") for d in dims))
    d2 = reduce(lambda a, b: a + b, ((F.col(f"q_{d}") - F.col(d)) * (F.col(f"q_{d}") - F.col(d)) for d in dims))
    half = dict.fromkeys(dims, 0.0)
    fine = written(blocks.boxes(rows, ["path"], dims))
    home = sides.join(rows.select(F.col("id").alias("qid"), "path").dropDuplicates(["qid"]), "qid")
    near = blocks.thinned(rows.join(sent(fine.select("path", "n")), "path"), leaf)
    pairs = near.join(sent(home), "path").select("qid", d2.alias("d2"))
    bounded = with_bounds(sides, pairs, rows.drop("path"), rows.count(), d2, k, F.lit(True))

    front = bounded.withColumn("path", F.lit("1"))
    for length in range(1 + STEP, (fine.agg(F.max(F.length("path"))).first()[0] or 0) + STEP, STEP):
        cut = fine.withColumns({"up": F.substring("path", 1, length - STEP), "path": F.substring("path", 1, length)})
        below = blocks.joined_boxes(cut, ["up", "path"], dims).withColumnRenamed("path", "down")
        front = front.join(below, F.col("path") == F.col("up")).filter(blocks.in_reach(dims, half)).select(*bounded.columns, F.col("down").alias("path"))
    met = rows.join(sent(front), "path").filter(F.col("bound").isNull() | (d2 <= F.col("bound")))
    return ranked(met.select("qid", "id", d2.alias("d2")), k)


def random_tree(df: DataFrame, key: str, vector: str, dims: int, leaf: int = SEARCH_LEAF, rule: str = "max", spread_limit: float = 3.0, seed: int = 5) -> DataFrame:
    """(key, leaf), a written table: rows with the leaf of a random projection tree that has at most ``leaf`` rows, or equal ones.

    Rule ``max`` splits a node at the median of its projections on the level's random direction (each tree has its own) plus
    the node's random shift of up to 6 / sqrt(dims) times the greatest distance from one of its rows. Rule ``mid`` splits at the
    median of projections if the squared diameter (twice the greatest squared distance to the mean bounds it) is within
    ``spread_limit`` times the mean, else at the median distance to the mean. A split that would part nothing is made in the
    middle. A missing vector takes no part, a missing component goes left. After ``DEEPEST`` levels nodes stay as they are.
    Nodes of more than ``WHOLE`` rows are split by a sample of at most about ``FITTED`` rows of all of them, together with two rows of each
    that differ; the others by all their rows, each in a task. Every row gets its leaf.
    """
    how = Splits(dims, rule, spread_limit, seed, 1)
    rows, equal = _planted(df, key, vector, how, leaf)

    def finished(group: pd.DataFrame) -> pd.DataFrame:
        return group[[key]].assign(leaf=how.grown(matrix(group[vector], dims), int(group["leaf"].iat[0]), leaf)[0])

    held = rows.join(sent(equal), "leaf", "left_semi").select(key, "leaf")
    return written(held.unionByName(rows.join(sent(equal), "leaf", "left_anti").groupBy("leaf").applyInPandas(finished, held.schema)))


@dataclass(frozen=True)
class Splits:
    """How a random projection tree's nodes are split, drawn from their numbers."""

    dims: int
    rule: str
    limit: float
    seed: int
    trees: int

    def of(self, x: np.ndarray, node: int) -> tuple[np.ndarray, bool, float] | None:
        """(direction or centre, whether distances to it count, where) that splits a node's rows; None if they are equal."""
        level = 0
        while node >> level >= 2 * self.trees:
            level += 1
        direction = np.random.default_rng([self.seed, node >> level, level]).normal(size=self.dims)
        direction /= np.linalg.norm(direction)
        x = x[np.isfinite(x).all(axis=1)]
        centre = x[0] if self.rule == "max" and len(x) else x.mean(axis=0) if len(x) else direction
        d, p = ((x - centre) ** 2).sum(axis=1), (x * direction).sum(axis=1)
        if not len(x) or (x == x[0]).all():
            return None
        if self.rule == "max":
            shift = np.random.default_rng([self.seed, node]).uniform(-1, 1) * 6 / self.dims**0.5 * d.max() ** 0.5
            return direction, False, parting(p, float(np.median(p)) + shift)
        if d.max() * 2 <= d.mean() * 2 * self.limit or d.min() == d.max():
            return direction, False, parting(p, float(np.median(p)))
        return centre, True, parting(d, float(np.median(d)))

    def right(self, x: np.ndarray, split: tuple[np.ndarray, bool, float]) -> np.ndarray:
        at, far, value = split
        return (((x - at) ** 2).sum(axis=1) if far else (x * at).sum(axis=1)) > value

    def grown(self, x: np.ndarray, node: int, most: float) -> tuple[np.ndarray, dict]:
        """Each row's leaf of at most ``most`` rows below the node, and the splits by node."""
        leaves, splits, todo = np.zeros(len(x), dtype=np.int64), {}, [(node, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            split = self.of(x[at], node) if len(at) > most and node < self.trees << DEEPEST else None
            if split is None:
                leaves[at] = node
                continue
            splits[node], right = split, self.right(x[at], split)
            todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
        return leaves, splits

    def down(self, x: np.ndarray, nodes: np.ndarray, splits: dict) -> np.ndarray:
        """The nodes that rows of ``nodes`` get to by the splits."""
        out, todo = nodes.copy(), [(int(n), np.flatnonzero(nodes == n)) for n in np.unique(nodes)]
        while todo:
            node, at = todo.pop()
            if node not in splits or not len(at):
                out[at] = node
                continue
            right = self.right(x[at], splits[node])
            todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
        return out


def parting(values: np.ndarray, at: float) -> float:
    low, high = float(values.min()), float(values.max())
    return at if low <= at < high else low + (high - low) / 2


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; a missing component is no number."""
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, dims))


def _planted(df: DataFrame, key: str, vector: str, how: Splits, leaf: int) -> tuple[DataFrame, DataFrame]:
    """((key, vector, ..., tree, leaf), (leaf)): several trees side by side, down to nodes of up to WHOLE rows, and the larger ones of equal rows.

    Tree t has the root ``trees`` + t, and so leaves of its own.
    """
    dims, trees = how.dims, how.trees
    rows = spread(df.filter(F.col(vector).isNotNull())).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.withColumn("leaf", (F.col("tree") + trees).cast("long"))
    whole = max(WHOLE, leaf)
    for _ in range(DEEPEST):
        low, high = F.min(vector).alias("low"), F.max(vector).alias("high")
        big = written(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), low, high).filter((F.col("n") > whole) & (F.col("leaf") < trees << DEEPEST) & (F.col("low") != F.col("high"))))
        sizes = {r["leaf"]: r for r in big.collect()}  # a row for each node of over WHOLE rows
        if not sizes:
            break
        step = -(-sum(r["n"] for r in sizes.values()) // FITTED)
        some = rows.join(F.broadcast(big.select("leaf")), "leaf").filter(F.pmod(F.xxhash64(key, "leaf"), F.lit(step)) == 0).select("leaf", vector).limit(4 * FITTED).toPandas()
        splits: dict = {}
        for node, size in sizes.items():
            x = np.concatenate([matrix(some.loc[some["leaf"] == node, vector], dims), matrix(pd.Series([size["low"], size["high"]]), dims)])
            splits |= how.grown(x, node, max(1, len(x) * whole / (2 * size["n"])))[1]

        def moved(batches, splits=splits):
            for batch in batches:
                if len(batch):
                    yield batch.assign(leaf=how.down(matrix(batch[vector], dims), batch["leaf"].to_numpy(), splits))

        if not splits:
            break
        rows = written(rows.mapInPandas(moved, rows.schema))

    large = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole)
    return rows, written(large.select("leaf"))


def forest_nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, trees: int = 4, leaf: int = SEARCH_LEAF, rule: str = "max") -> DataFrame:
    """(qid, id, d2, rank): the k nearest by squared distance among the rows that share a leaf with the query in one of ``trees`` trees.

    Queries are rows of ``df``. A row found in several trees counts once. Equal distances: by id. A leaf's rows and queries
    meet in a task, and only k rows a query leave it.
    """
    how = Splits(dims, rule, 3.0, 5, trees)
    wanted = queries.select(F.col(key).alias("id")).distinct().withColumn("asked", F.lit(True))
    given = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).join(sent(wanted), "id", "left")
    rows, equal = _planted(given, "id", "v", how, leaf)
    kind = rows.schema["id"].dataType.simpleString()

    def compared_in(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x, ids, found = matrix(group["v"], dims), group["id"].to_numpy(), []
        leaves = how.grown(x, int(group["leaf"].iat[0]), leaf)[0]
        asked = group["asked"].eq(True).to_numpy()
        order = np.argsort(leaves, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
            for q in np.array_split(at[asked[at]], 1 + len(at) ** 2 // compared.TOGETHER):
                if len(q):
                    qi, xi, d = compared.least(x[q], x[at], np.full(len(q), np.inf), k, "squares")
                    found.append((ids[q[qi]], ids[at[xi]], d))
        qid, near, d2 = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0], np.zeros(0))
        return pd.DataFrame({"qid": qid, "id": near, "d2": d2})

    met = rows.join(sent(equal), "leaf", "left_anti").groupBy("leaf").applyInPandas(compared_in, f"qid {kind}, id {kind}, d2 double")
    if not equal.isEmpty():
        same = rows.join(sent(equal), "leaf").withColumn("block", F.concat_ws(":", "leaf", F.pmod(F.xxhash64("id"), F.lit(64))))
        blocks_of = compared.everywhere(rows.join(sent(equal), "leaf").filter("asked"), 64).withColumn("block", F.concat_ws(":", "leaf", "block"))
        asked = written(blocks_of.select("block", F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("bound")))
        met = met.unionByName(compared.nearest(written(same.select("block", "id", "v")), asked, k, dims))
    return ranked(written(met).dropDuplicates(["qid", "id"]), k)


def apart(a: str, b: str, dims: int) -> Column:
    return reduce(lambda s, i: s + (F.get(a, F.lit(i)) - F.get(b, F.lit(i))).cast("double") * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))).cast("double"), range(1, dims), F.pow((F.get(a, F.lit(0)) - F.get(b, F.lit(0))).cast("double"), F.lit(2.0)))
