"""Hashing by cuts of orthogonal projections, with several probes in the order of the bins' distance and an early stop."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.operators.balls import SQUARES, vectors
from nearwin.operators.knn import kth, met, ranked
from nearwin.plans.ordering import bucket_of
from nearwin.plans.shared import written

#: Rows that a bin has on average, directions, and rings of bins that a query meets at most.
PER_BIN, HASHES, RINGS = 128, 2, 64


class Bins:
    """Directions of length 1 at right angles, drawn with a seed, and cuts at quantiles of the rows' projections on each.

    There are about (n / ``per_bin``) ^ (1 / ``hashes``) bins a direction, so a bin's number takes about log2(n) bits less
    those of ``per_bin``: bins stay as full however many rows there are, until a direction has 4,096.
    """

    def __init__(self, df: DataFrame, dims: int, per_bin: int, hashes: int, seed: int) -> None:
        self.directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(hashes, dims))))[0].T
        n, m = df.count(), len(self.directions)
        cuts = min(4096, math.ceil((max(1, n) / per_bin) ** (1 / m)))
        shares = [i / cuts for i in range(1, cuts)]
        found = df.agg(*(F.percentile_approx(self.projected("v", j), shares, max(10_000, 8 * cuts)).alias(f"c{j}") for j in range(m))).first() if shares else None
        self.cuts = [sorted(set(found[f"c{j}"] or [])) if found else [] for j in range(m)]

    def projected(self, vector: str, j: int) -> Column:
        direction = F.from_json(F.lit(json.dumps(self.directions[j].tolist())), "array<double>")
        return F.aggregate(F.zip_with(vector, direction, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    def placed(self, df: DataFrame, vector: str) -> DataFrame:
        """``df`` with p0, p1, ... and b0, b1, ..., the row's projections and bins."""
        df = df.withColumns({f"p{j}": self.projected(vector, j) for j in range(len(self.cuts))})
        return df.withColumns({f"b{j}": bucket_of(F.col(f"p{j}"), cuts, "double") for j, cuts in enumerate(self.cuts)})

    def cell(self) -> Column:
        """One number of a row's bins."""
        base = max(map(len, self.cuts)) + 1
        return reduce(lambda a, b: a * base + b, (F.col(f"b{j}") for j in range(len(self.cuts))), F.lit(0).cast("long"))

    def ring(self, asked: DataFrame, g: int) -> DataFrame:
        """A row for each bin that is ``g`` bins from the query's in one direction at least, and no more in any."""
        steps = [o for o in product(range(-g, g + 1), repeat=len(self.cuts)) if max(map(abs, o)) == g]
        each = F.array(*(F.struct(*(F.lit(x).alias(f"o{j}") for j, x in enumerate(o))) for o in steps))
        out = asked.withColumn("__step", F.explode(each))
        moved = {f"b{j}": F.col(f"b{j}") + F.col(f"__step.o{j}") for j in range(len(self.cuts))}
        inside = reduce(lambda a, b: a & b, (F.col(f"b{j}").between(0, len(cuts)) for j, cuts in enumerate(self.cuts)))
        return out.withColumns(moved).drop("__step").filter(inside)

    def outside(self, g: int) -> Column:
        """The least distance of any row beyond the query's ring ``g``: a projection never makes a distance longer."""
        gaps = []
        for j, cuts in enumerate(self.cuts):
            at, values = F.col(f"b{j}"), F.from_json(F.lit(json.dumps(cuts)), "array<double>")
            low, high = F.col(f"p{j}") - F.get(values, at - g - 1), F.get(values, at + g) - F.col(f"p{j}")
            gaps += [F.when(at - g - 1 >= 0, low).otherwise(float("inf")), F.when(at + g < len(cuts), high).otherwise(float("inf"))]
        return F.greatest(F.lit(0.0), F.least(*gaps))


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, c: float = 1.0, per_bin: int = PER_BIN, hashes: int = HASHES, rings: int = RINGS, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """((qid, id, d2, rank), (qid, rings, points)): the k nearest found, and the rings of bins and rows that each query met.

    A query meets its own bin, then the bins around it ring by ring, by equality joins. It stops once it has k rows within
    ``c`` times R, the least distance of anything not met yet: with c = 1 its k nearest are exact, with more it stops sooner. After
    ``rings`` rings it stops anyway. Rows without an id or with a missing value take no part. Equal distances: by id.
    Pairs are dealt to tasks by ``met`` and are never written: beyond its k-th distance so far a query keeps none of them.
    """
    rows = vectors(df, key, vector)
    bins = Bins(rows, dims, per_bin, hashes, seed)
    rows = written(bins.placed(rows, "v").select("id", "v", bins.cell().alias("cell")))
    sizes = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    asked = written(bins.placed(vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qv"))
    todo, best, done = asked.withColumn("bound", F.lit(None).cast("double")), None, []
    for g in range(rings):
        ring = bins.ring(todo, g).select("qid", "qv", "bound", bins.cell().alias("cell"))
        done.append(ring.join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("points")).withColumn("ring", F.lit(g)))
        pairs = met(rows, ring, sizes).select("qid", "id", SQUARES.column(F.col("qv"), F.col("v"), dims).alias("d2"), "bound")
        pairs = pairs.filter("bound IS NULL OR d2 <= bound").drop("bound")
        best = written(ranked(pairs if best is None else pairs.unionByName(best.drop("rank")), k))
        far = todo.drop("bound").join(kth(best, k), "qid", "left").withColumn("out", bins.outside(g))
        todo = written(far.filter((F.col("out") < float("inf")) & (F.col("bound").isNull() | (F.sqrt("bound") > F.lit(float(c)) * F.col("out") * (1 - 1e-9)))).select(todo.columns))
        if todo.isEmpty():
            break
    steps = reduce(DataFrame.unionByName, done)
    return best, steps.groupBy("qid").agg((F.max("ring") + 1).alias("rings"), F.sum("points").alias("points"))
