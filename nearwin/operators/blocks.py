"""Blocks of space: cells of a quantile grid, their boxes, and which boxes a query's bound reaches.

A search that knows an upper bound of its k-th distance needs only the blocks whose boxes are not farther. Boxes are
met in two steps by equality joins, first the coarse cells between the bound's corners and then those inside, so no step
pairs all queries with all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.plans.ordering import bucket_of

#: Rows that a block has on average, until a dimension has MOST_CUTS cuts; from there blocks grow.
PER_BLOCK, MOST_CUTS = 512, 4096
#: Coarse steps that a dimension has at most.
COARSE = 64
#: Dimensions that are cut.
CUT = 2
#: Boxes are taken to be nearer by this share than they are, against rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Ascending cuts of each dimension, and how many rows they were made for."""

    cuts: dict[str, list[float]]
    n: int

    @property
    def step(self) -> int:
        """Places that a coarse cell takes of a dimension."""
        return max(1, -(-max(map(len, self.cuts.values()), default=0) // COARSE))

    def reached(self, df: DataFrame, half: dict[str, float], scale: dict[str, float]) -> DataFrame:
        """A row for each query of ``df`` and each ``coarse`` cell that its bound can reach; all cells, if it has none."""
        out = df
        for i, (c, cuts) in enumerate(self.cuts.items()):
            q, r = F.col(f"q_{c}").cast("double"), F.sqrt("bound") * (1 + SLACK)
            err = F.abs(q) * 1e-12
            wide = r / scale[c] if scale[c] > 0 else F.lit(math.inf)
            low, high = F.nanvl(q - wide - err, F.lit(-math.inf)), F.nanvl(q + wide + err, F.lit(math.inf))
            any_place = F.col("bound").isNull() | F.isnan("bound") | q.isNull() | F.isnan(q)
            place = lambda at: F.floor((bucket_of(at, cuts, "double") + 1) / self.step).cast("long")  # noqa: B023, E731
            first, last = F.when(any_place, 0).otherwise(place(low)), F.when(any_place, (len(cuts) + 1) // self.step).otherwise(place(high))
            between = F.sequence(first.cast("long"), last.cast("long"))
            missing = F.array(F.lit(0).cast("long"))
            out = out.withColumn(f"__{i}", F.explode(F.when((r >= half[c]) & (first > 0), F.concat(missing, between)).otherwise(between)))
        places = [f"__{i}" for i in range(len(self.cuts))]
        return out.withColumn("coarse", joined(F.col(p) for p in places)).drop(*places)

    def placed(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """``df`` with its ``cell`` and the ``coarse`` cell around it.

        A dimension's place is 0 for a missing value, else 1 and the cuts at or below the value.
        """
        at = lambda c: F.col(prefix + c).cast("double")
        places = {f"__{i}": F.when(at(c).isNull(), 0).otherwise(bucket_of(at(c), cuts, "double") + 1).cast("long") for i, (c, cuts) in enumerate(self.cuts.items())}
        made = df.withColumns(places) if places else df
        return made.withColumns({"cell": joined([F.col(p) for p in places]), "coarse": joined([F.floor(F.col(p) / self.step) for p in places])}).drop(*places)


def joined(places: Iterable[Column]) -> Column:
    """One number of a cell's places."""
    return reduce(lambda a, b: a * (MOST_CUTS * 2) + b, places, F.lit(0).cast("long"))


def scales(of: DataFrame, half: dict[str, float]) -> dict[str, float]:
    """By how much the boxes' units are longer than the distance's, at most 1: attributes may be wider than ``half`` says."""
    if not half:
        return {}
    seen = of.agg(*(x for i, d in enumerate(half) for x in (F.min(f"{d}_low").cast("double").alias(f"a{i}"), F.max(f"{d}_high").cast("double").alias(f"b{i}")))).first()
    width = [(seen[f"b{i}"] or 0.0) - (seen[f"a{i}"] or 0.0) for i in range(len(half))]
    return {d: min(1.0, 2 * h / w) if w > 0 and math.isfinite(w) else 1.0 for (d, h), w in zip(half.items(), width, strict=True)}


def laid(df: DataFrame, dims: tuple[str, ...], per_block: int = PER_BLOCK) -> Grid:
    """A grid over the first ``CUT`` of ``dims`` by their quantiles: a count and sketches come to the driver."""
    dims = dims[:CUT]
    n = df.count()
    cuts = min(MOST_CUTS, math.ceil((n / per_block) ** (1 / len(dims)))) if dims else 1
    if cuts < 2:
        return Grid({c: [] for c in dims}, n)
    shares = [i / cuts for i in range(1, cuts)]
    found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, max(10_000, 8 * cuts)).alias(f"c{i}") for i, c in enumerate(dims))).first()
    finite = lambda vs: sorted({v for v in vs or [] if math.isfinite(v)})
    return Grid({c: finite(found[f"c{i}"]) for i, c in enumerate(dims)}, n)


def thinned(rows: DataFrame, per_block: int) -> DataFrame:
    """Rows with their block's ``n``, without it: of a block over twice ``per_block`` only every few, by a hash of the id."""
    few = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / (2 * per_block)))
    return rows.filter(F.pmod(F.xxhash64("id"), few) == 0).drop("n")


def boxes(rows: DataFrame, by: list[str], dims: tuple[str, ...]) -> DataFrame:
    """(by, n, <dim>_low, <dim>_high, <dim>_gap): rows of each block, their extent, and whether a value is missing."""
    of = [x for d in dims for x in (F.min(d).alias(f"{d}_low"), F.max(d).alias(f"{d}_high"), F.bool_or(F.col(d).isNull()).alias(f"{d}_gap"))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *of)


def joined_boxes(of: DataFrame, by: list[str], dims: tuple[str, ...]) -> DataFrame:
    """Boxes around boxes."""
    more = [x for d in dims for x in (F.min(f"{d}_low").alias(f"{d}_low"), F.max(f"{d}_high").alias(f"{d}_high"), F.bool_or(f"{d}_gap").alias(f"{d}_gap"))]
    return of.groupBy(*by).agg(F.sum("n").alias("n"), *more)


def away(dims: tuple[str, ...], half: dict[str, float], scale: dict[str, float] | None = None) -> Column:
    """The least squared distance that a row of the box can have from the query, over ``dims``.

    A missing value on either side differs by at least ``half`` of the dimension's width. ``scale``: see ``scales``.
    """

    def one(d: str) -> Column:
        q, low, high = F.col(f"q_{d}"), F.col(f"{d}_low"), F.col(f"{d}_high")
        plain = F.nanvl(F.greatest(low - q, q - high, F.lit(0.0)).cast("double"), F.lit(0.0))
        plain = plain * scale[d] if scale and scale[d] < 1 else plain
        least = F.lit(float(half[d]))
        return F.when(q.isNull() | low.isNull(), least).when(F.col(f"{d}_gap"), F.least(plain, least)).otherwise(plain)

    return reduce(lambda s, d: s + one(d) * one(d), dims, F.lit(0.0))


def in_reach(dims: tuple[str, ...], half: dict[str, float], scale: dict[str, float] | None = None) -> Column:
    """The query has no bound, or the box isn't beyond it."""
    return F.col("bound").isNull() | (away(dims, half, scale) <= F.col("bound") * (1 + SLACK))
