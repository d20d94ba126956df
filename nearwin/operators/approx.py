"""Ball covers, projections, hashing and Morton codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.functions.distance import unrolled_squared
from nearwin.operators import compared
from nearwin.operators.balls import vectors
from nearwin.operators.knn import kth, ranked, sent, spread
from nearwin.plans.shared import written


def sides(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{name}id"), F.col(vector).alias(f"{name}v"))


def array_nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int) -> DataFrame:
    """(qid, id, d2, rank): the k nearest of all rows by raw array distance."""
    d2 = unrolled_squared(F.col("qv"), F.col("v"), dims)
    pairs = spread(df.select(F.col(key).alias("id"), F.col(vector).alias("v"))).join(sent(sides(queries, key, vector, "q")))
    return ranked(pairs.select("qid", "id", d2.alias("d2")), k)


def _cut_off(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, group: int) -> tuple[DataFrame, list[Column]]:
    """All pairs with each query's ``bound``, the k-th distance in a sample of the rows, and the sums after each group of dimensions."""
    rows = written(spread(df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(F.col(vector).isNotNull())))
    n = rows.count()
    step = max(1, n // (8 * k + 4 * math.isqrt(n)))
    asked = sides(queries.filter(F.col(vector).isNotNull()), key, vector, "q")
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).join(sent(asked))
    bounded = written(asked.join(kth(part.select("qid", unrolled_squared(F.col("qv"), F.col("v"), dims).alias("d2")), k), "qid", "left"))
    sums, total = [], F.lit(0.0)
    for at in range(0, dims, group):  # folds over arrays: as one expression the terms would be too much code
        part = [F.slice(c, at + 1, min(group, dims - at)) for c in ("qv", "v")]
        squares = F.zip_with(*part, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        total = F.aggregate(squares, total, lambda s, x: s + x)
        sums.append(total)
    return rows.join(sent(bounded)), sums


def cutoff_nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, group: int = 16) -> DataFrame:
    """(qid, id, d2, rank): the k nearest of all rows by raw array distance, a pair given up once its sum passes the bound.

    The bound is the query's k-th distance in a sample of about 8 k + 4 sqrt(n) rows. Sums grow ``group`` dimensions at a time;
    a pair whose sum is over the bound is dropped before the next group is looked at. Blocks of rows meet the queries in a
    task each. Equal distances: by id. Rows without an id or with a missing value take no part.
    """
    rows, asked = written(vectors(df, key, vector)), vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (8 * k + 4 * math.isqrt(n))))) == 0).withColumn("block", F.lit("0"))
    unbound = asked.select("qid", "qv", F.lit(None).cast("double").alias("bound"), F.lit("0").alias("block"))
    bounds = compared.kth(compared.nearest(some, unbound, k, dims), k).withColumnRenamed("kth", "bound")
    bounded, blocks = written(asked.join(bounds, "qid", "left")), -(-n // compared.BLOCK) or 1
    return ranked(compared.nearest(compared.dealt(rows, "id", blocks), compared.everywhere(bounded, blocks), k, dims, group=group), k)


def cutoff_statistics(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, group: int = 16) -> DataFrame:
    """(qid, points, coordinates): rows and dimensions that ``cutoff_nearest`` looks at for each query, the sample's apart."""
    pairs, sums = _cut_off(df, queries, key, vector, dims, k, group)
    widths = [min(group, dims - at) for at in range(0, dims, group)]
    looked = reduce(lambda rest, x: F.lit(x[0]) + F.when(F.col("bound").isNull() | (x[1] <= F.col("bound")), rest).otherwise(0), list(zip(widths, sums, strict=True))[-2::-1], F.lit(widths[-1]))
    return pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("points"), F.sum(looked).alias("coordinates"))


def representatives(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """About sqrt(n) of ``df``'s n rows, those whose key is divisible by a step, and the step, sqrt(n) rounded up."""
    step = math.isqrt(max(1, df.count()) - 1) + 1
    return df.filter(F.col(key) % step == 0), step


def owners(df: DataFrame, reps: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, v, rep, rd): each row with its nearest representative and its rooted distance. Blocks of rows meet the representatives in a task each."""
    rows = written(vectors(df, key, vector))
    blocks = -(-rows.count() // compared.BLOCK) or 1
    asking = compared.dealt(rows.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("bound")), "qid", blocks)
    best = compared.nearest(compared.everywhere(vectors(reps, key, vector), blocks), asking, 1, dims)
    return rows.join(best.select(F.col("qid").alias("id"), F.col("id").alias("rep"), F.sqrt("d2").alias("rd")), "id")


def ball_cover_exact(df: DataFrame, reps: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int) -> DataFrame:
    """(qid, id, d2, rank): exactly the k nearest, from the balls that can hold them.

    A row within a query's k-th distance lies in a ball whose centre is nearer than that distance plus the ball's radius;
    the k-th distance is bounded by that in the balls nearest to the query until they hold k rows. A task holds some balls whole
    and the queries that reach one of them at least.
    """
    owned = written(owners(df, reps, key, vector, dims))
    balls = owned.groupBy("rep").agg(F.max("rd").alias("radius"), F.count(F.lit(1)).alias("n"))
    blocks = -(-owned.count() // compared.BLOCK) or 1
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("string").alias("block")
    centres = written(vectors(reps, key, vector).select(F.col("id").alias("rid"), F.col("v").alias("rv")).join(balls, F.col("rid") == F.col("rep")))
    asked = vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    to = written(asked.join(sent(centres)).select("qid", "rep", "radius", "n", F.sqrt(unrolled_squared(F.col("qv"), F.col("rv"), dims)).alias("d")))
    sure = Window.partitionBy("qid").orderBy(F.col("d") + F.col("radius"), "rep")
    bound = to.withColumn("held", F.sum("n").over(sure.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("held") >= k).groupBy("qid").agg(F.min(F.col("d") + F.col("radius")).alias("bound"))
    reach = to.join(bound, "qid", "left").filter(F.col("bound").isNull() | (F.col("d") - F.col("radius") <= F.col("bound") * (1 + 1e-9)))
    node = F.col("rep").cast("string").alias("node")
    held = owned.select(block, "id", "v", node, F.col("rd").alias("cd"), F.lit(False).alias("centre"))
    held = held.unionByName(centres.select(block, F.lit(0).cast(held.schema["id"].dataType).alias("id"), F.col("rv").alias("v"), node, F.lit(0.0).alias("cd"), F.lit(True).alias("centre")))
    meets = reach.select("qid", "bound", block).distinct().join(asked, "qid")
    return ranked(compared.nearest(held, meets, k, dims, balls=True), k)


def ball_cover_oneshot(df: DataFrame, reps: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, own: int, probes: int = 1) -> DataFrame:
    """(qid, id, d2, rank): the k nearest among the ``own`` rows nearest to each of the query's ``probes`` nearest representatives.

    Blocks of rows give each representative's nearest there, so its list is picked from those. A list and the queries that ask it meet in a task.
    """
    rows, ways = written(vectors(df, key, vector)), vectors(reps, key, vector)
    blocks = -(-rows.count() // compared.BLOCK) or 1
    heads = ways.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("bound"))
    lists = ranked(compared.nearest(compared.dealt(rows, "id", blocks), compared.everywhere(heads, blocks), own, dims), own)
    asked = written(vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("bound")))
    some = -(-asked.count() // compared.BLOCK) or 1
    home = ranked(compared.nearest(compared.everywhere(ways, some), compared.dealt(asked, "qid", some), probes, dims), probes)
    meets = home.select("qid", F.col("id").cast("string").alias("block")).join(asked, "qid")
    held = lists.select(F.col("qid").cast("string").alias("block"), "id").join(rows, "id")
    return ranked(compared.nearest(held, meets, k, dims).distinct(), k)


def sparse_entry(i: int, j: int) -> int:
    """The sparse matrix by rule: of six equally likely remainders one gives 1, one -1, four 0."""
    return {0: 1, 1: -1}.get((i * 31 + j * 17 + i * j * 7) % 6, 0)


def sparse_projection(vector: Column, dims: int, out: int) -> list[Column]:
    """``out`` coordinates, each a sum of about a third of the entries with their signs, times sqrt(3 / out)."""
    scale = (3.0 / out) ** 0.5
    each = lambda j: [(i, s) for i in range(dims) if (s := sparse_entry(i, j))]
    total = lambda j: reduce(lambda a, b: a + b, (F.get(vector, F.lit(i)).cast("double") * F.lit(float(s)) for i, s in each(j)))
    return [(total(j) * F.lit(scale)).alias(f"p{j}") for j in range(out)]


def dense_projection(vector: Column, dims: int, out: int, seed: int) -> list[Column]:
    """``out`` coordinates by a seeded Gaussian matrix over sqrt(out)."""
    matrix = np.random.default_rng(seed).normal(size=(out, dims)) / out**0.5
    return [reduce(lambda a, b: a + b, (F.get(vector, F.lit(i)).cast("double") * float(x) for i, x in enumerate(row))).alias(f"p{j}") for j, row in enumerate(matrix)]


def fourier_projection(df: DataFrame, key: str, vector: str, dims: int, out: int, seed: int) -> DataFrame:
    """(key, projection): random signs, a Fourier transform, and ``out`` of its coordinates, scaled to keep lengths."""
    rng = np.random.default_rng(seed)
    signs, chosen = rng.choice([-1.0, 1.0], dims), np.sort(rng.choice(dims, out, replace=False))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=float).reshape(-1, dims)
            spectrum = np.fft.fft(x * signs, axis=1, norm="ortho")[:, chosen] * (dims / out) ** 0.5
            yield pd.DataFrame({key: batch[key], "projection": list(np.concatenate([spectrum.real, spectrum.imag], axis=1))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(vector).alias("v")).mapInPandas(project, f"{key} {kind}, projection array<double>")


def hashed_nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, dims: int, k: int, tables: int = 16, bits: int = 3, seed: int = 3) -> DataFrame:
    """(qid, id, d2, rank): the k nearest among rows that share a bin with the query in one of ``tables`` hash tables.

    A hash is ``bits`` signs of random projections. A bin is cut into blocks of rows, each of which meets the bin's queries in a
    task; only the k nearest of each leave it. A row found in several tables counts once.
    """
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    mean = df.agg(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims))).first()

    centre, base = np.array([m or 0.0 for m in mean]), np.arange(tables) << bits

    @F.pandas_udf("array<int>")
    def bins(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(-1, dims) - centre
        signs = np.einsum("nd,tbd->ntb", x, planes) > 0
        return pd.Series(list((base + signs @ (1 << np.arange(bits))).astype(np.int32)))

    rows = spread(vectors(df, key, vector))
    blocks = -(-rows.count() // compared.BLOCK) or 1
    cut = F.pmod(F.xxhash64("id"), F.lit(blocks))
    rows = rows.withColumn("bin", F.explode(bins(F.col("v")))).withColumn("block", F.concat_ws(" ", "bin", cut))
    asked = vectors(queries, key, vector).select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.lit(None).cast("double").alias("bound"))
    asked = asked.withColumn("bin", F.explode(bins(F.col("qv")))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.concat_ws(" ", "bin", "cut"))
    return ranked(compared.nearest(rows.drop("bin"), asked.drop("bin", "cut"), k, dims).distinct(), k)


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """The bits of two whole numbers under 2^bits, dealt in turn, x first at the bottom."""
    bit = lambda v, i: F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
    parts = [F.shiftleft(bit(v, i), 2 * i + k) for i in range(bits) for k, v in enumerate((x, y))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)
