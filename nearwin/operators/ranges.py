"""Least and greatest values of attributes: of a table, of some of its rows, of all rows so far, of a moving window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.functions.distance import Range
from nearwin.plans.ordering import bucket_of, quantile_bounds, running_total
from nearwin.plans.shared import written

INF = float("inf")


def range_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: <column>_min, _max and _width; missing values don't count, without any value inf, -inf and inf."""
    parts = []
    for c in columns:
        low, high = F.min(c), F.max(c)
        parts += [F.coalesce(low, F.lit(INF)).alias(f"{c}_min"), F.coalesce(high, F.lit(-INF)).alias(f"{c}_max"), F.coalesce(high - low, F.lit(INF)).alias(f"{c}_width")]
    return df.agg(*parts)


def ranges_of(df: DataFrame, columns: tuple[str, ...]) -> dict[str, Range]:
    """The ranges as values for expressions: one row of partial minima and maxima comes to the driver."""
    if not columns:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max), ("c", F.count)))).first()
    return {c: Range(row[f"a{i}"], row[f"b{i}"], row[f"c{i}"] < row["n"]) for i, c in enumerate(columns)}


def in_ranges(columns: dict[str, Range]) -> Column:
    """Every value that isn't missing lies in its range."""
    out = F.lit(True)
    for c, r in columns.items():
        out = out & (F.col(c).isNull() | (F.col(c).between(r.low, r.high) if r.low is not None else F.lit(False)))
    return out


def middle(r: Range) -> float:
    return r.low + r.width / 2


def positioned(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``position``, its place in the order of ``key`` from 0, and ``part``, its bucket of keys."""
    parts = written(df.withColumn("part", bucket_of(F.col(key).cast("long"), quantile_bounds(df, F.col(key).cast("long")))))
    return running_total(parts, [], "part", [F.col(key)], {}, "position")


def running_ranges(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Ranges of all rows up to and with each row, in the order of ``key``: inside buckets, then over bucket extrema."""
    parts = written(df.select(key, *columns).withColumn("part", bucket_of(F.col(key).cast("long"), quantile_bounds(df, F.col(key).cast("long")))))
    every = [(c, n, f) for c in columns for n, f in (("min", F.min), ("max", F.max))]
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.groupBy(F.col("part").alias("__part")).agg(*(f(c).alias(f"__{c}_{n}") for c, n, f in every))
    of_part = of_part.select("__part", *(f(f"__{c}_{n}").over(ahead).alias(f"__{c}_{n}") for c, n, f in every))  # a row a bucket
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    least = {"min": F.least, "max": F.greatest}
    local = parts.withColumns({f"{c}_{n}": f(c).over(inside) for c, n, f in every})
    return local.join(of_part, local["part"] == of_part["__part"]).select(key, *(least[n](f"{c}_{n}", f"__{c}_{n}").alias(f"{c}_{n}") for c, n, _ in every))


def windowed(df: DataFrame, key: str, size: int, columns: dict[str, Column], block: int = 4096) -> DataFrame:
    """Aggregates over the ``size`` rows before each row, in the order of ``key``.

    Rows are numbered, and dealt in blocks of at least ``block`` and ``size`` rows; each block also gets the last
    ``size`` rows of the block before, so its window is whole and no task sees more than two blocks' rows.
    """
    block = max(block, size)
    rows = written(positioned(df, key))
    home = F.floor(F.col("position") / block)
    to = F.when(F.col("position") % block >= block - size, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = rows.withColumn("__home", home).withColumn("__block", F.explode(to))
    before = Window.partitionBy("__block").orderBy("position").rowsBetween(-size, -1)
    return dealt.withColumns({n: c.over(before) for n, c in columns.items()}).filter("__block = __home").drop("__home", "__block", "part")
