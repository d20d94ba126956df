"""Total order without a single task: quantile buckets of a key and two-level running sums.

A window without a partition key sends every row to one task. Here rows go to buckets that are ranges of the key
(or slices of its hash), each bucket is ordered in a task of its own, and a small table of bucket totals gives
every bucket its offset.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
#: About so many rows are in a bucket, until there are MOST_BUCKETS; from there buckets grow.
ROWS_PER_BUCKET, MOST_BUCKETS = 512, 1 << 17


def order_key(name: str) -> Column:
    """The order column as a long; null comes first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LOWEST))


def quantile_bounds(df: DataFrame, key: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[int]:
    """Ascending distinct values of ``key`` that start new buckets; reads the key alone. Empty for a small table."""
    n = df.count()
    buckets = min(MOST_BUCKETS, n // rows_per_bucket)
    if buckets < 2:
        return []
    shares = F.from_json(F.lit(json.dumps([i / buckets for i in range(1, buckets)])), "array<double>")
    found = df.select(F.call_function("percentile_approx", key, shares, F.lit(max(10_000, 8 * buckets))).alias("b")).first()["b"]
    return sorted(set(found))


def bucket_of(key: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many bounds are at or below ``key``, found in two levels of about sqrt(len(bounds)) steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = F.from_json(F.lit(json.dumps([bounds[i : i + step] for i in range(0, len(bounds), step)])), f"array<array<{kind}>>")
    firsts = F.from_json(F.lit(json.dumps(bounds[::step])), f"array<{kind}>")
    at = F.size(F.filter(firsts, lambda x: x <= key))
    inner = F.size(F.filter(F.get(groups, at - 1), lambda x: x <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + inner).cast("int")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, str], position: str | None = None) -> DataFrame:
    """Adds, for each ``out: value`` of ``sums``, the sum of ``value`` over all rows before a row, and ``position`` from 0.

    The order is ``keys``, then ``bucket``, then ``order``; sums start anew for each value of ``keys``. ``df`` is read
    twice, so it should be a written table; ``keys`` and ``bucket`` hold no nulls. Totals by (keys, bucket) are made by a partial aggregate; only they are
    ordered across buckets, at most MOST_BUCKETS rows for a key.
    """
    by = [*keys, bucket]
    every = {**sums, **({position: None} if position else {})}
    value = lambda v: F.lit(1).cast("long") if v is None else F.col(v)
    totals = df.groupBy(*by).agg(*(F.sum(value(v)).alias(f"__t_{o}") for o, v in every.items()))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"__k_{k}") for k in by), *(F.coalesce(F.sum(f"__t_{o}").over(ahead), F.lit(0)).alias(f"__o_{o}") for o in every))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"__l_{o}": F.coalesce(F.sum(value(v)).over(inside), F.lit(0)) for o, v in every.items()})
    same = [F.col(k) == F.col(f"__k_{k}") for k in by]
    joined = local.join(offsets, same)
    return joined.select(*(c for c in df.columns), *((F.col(f"__l_{o}") + F.col(f"__o_{o}")).alias(o) for o in every))
