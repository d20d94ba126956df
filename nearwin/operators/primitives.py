"""Scans, histograms, selection, sorting positions and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.operators.ranges import positioned
from nearwin.plans.ordering import bucket_of, quantile_bounds, running_total
from nearwin.plans.shared import written


def digit(value: Column, shift: int, bits: int = 4) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is not under n; 1 for n up to 1. Counted in bits, so it is exact."""
    below = F.greatest(n - 1, F.lit(0)).cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(below)))).cast("long")


def round_up(n: Column, base: int) -> Column:
    return (F.floor((n + (base - 1)) / F.lit(base)) * base).cast("long")


def bucket_index(value: Column, low: float, high: float, buckets: int) -> Column:
    """Which of equal-width buckets holds the value; the last is closed above; 0 for a range without width."""
    if high <= low:
        return F.lit(0)
    return F.least(F.floor((value - F.lit(low)) / F.lit((high - low) / buckets)), F.lit(buckets - 1)).cast("int")


def compacted(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """(key, bucket, position): each row's place from 0 in its bucket, in the order of the key."""
    parts = written(df.select(key, bucket.alias("bucket"), bucket_of(F.col(key).cast("long"), quantile_bounds(df, F.col(key).cast("long"))).alias("part")))
    return running_total(parts, ["bucket"], "part", [F.col(key)], {}, "position").select(key, "bucket", "position")


def prefix_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, exclusive, inclusive): running sums in the order of the key, by bucket totals and bucket-local windows."""
    parts = written(df.select(key, F.col(value).cast("long").alias("value"), bucket_of(F.col(key).cast("long"), quantile_bounds(df, F.col(key).cast("long"))).alias("part")))
    sums = running_total(parts, [], "part", [F.col(key)], {"exclusive": "value"})
    return sums.select(key, "exclusive", (F.col("exclusive") + F.coalesce("value", F.lit(0))).alias("inclusive"))


def steps_by_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: whether each value is the one before plus 1, in the order of the key: value less position never changes."""
    at = positioned(df.select(key, F.col(value).alias("__v")), key)
    return at.agg((F.min(F.col("__v") - F.col("position")) == F.max(F.col("__v") - F.col("position"))).alias("is_prefix_sum"))


def histogram(df: DataFrame, of: Column, block: Column | None = None) -> DataFrame:
    """Counts by digit, or by block and digit."""
    keys = ([block.alias("block")] if block is not None else []) + [of.alias("digit")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def histogram_scan(counts: DataFrame) -> DataFrame:
    """Where each (digit, block) starts in the sorted order: a running sum over blocks in a digit plus that over digits."""
    inside = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = counts.groupBy("digit").agg(F.sum("n").alias("all")).select("digit", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))  # a row a digit
    return counts.join(F.broadcast(digits), "digit").select("digit", "block", "n", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))


def kth_digit(df: DataFrame, of: Column, k: int) -> DataFrame:
    """The digit of the k-th smallest (from 0): the first whose running count is over k."""
    running = F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    return histogram(df, of).withColumn("running", running).filter(F.col("running") > k).agg(F.min("digit").alias("digit"))  # a row a digit is ordered


def smallest(df: DataFrame, k: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sort_positions(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, position): places from 0 in the order of value, then key, with value ranges as buckets."""
    bounds = quantile_bounds(df, F.col(value).cast("long"))
    parts = written(df.select(key, value, bucket_of(F.floor(F.col(value)).cast("long"), bounds).alias("part")))
    return running_total(parts, [], "part", [F.col(value), F.col(key)], {}, "position").select(key, value, "position")


def scatter_positions(df: DataFrame, key: str, of: Column) -> DataFrame:
    """(key, digit, position): a stable sort by one digit: the digit's start plus the row's place among its like."""
    parts = written(df.select(key, of.alias("digit"), bucket_of(F.col(key).cast("long"), quantile_bounds(df, F.col(key).cast("long"))).alias("part")))
    inside = running_total(parts, ["digit"], "part", [F.col(key)], {}, "place")
    starts = parts.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a digit
    return inside.join(F.broadcast(starts), "digit").select(key, "digit", (F.col("start") + F.col("place")).alias("position"))


def trimmed_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, trimmed_median): the median without one least and one greatest value; null for fewer than three.

    Missing values don't count. One from both ends leaves the middle where it is: the values at the middle places in the
    order of each group. Places come by value ranges as buckets, so no task holds a whole group.
    """
    each = df.select(F.to_json(F.struct(group)).alias("__g"), group, value)
    groups = each.groupBy("__g").agg(F.any_value(group).alias(group), F.count(value).alias("__n"))
    seen = each.drop(group).filter(F.col(value).isNotNull())
    whole = F.floor(value).cast("long")
    parts = written(seen.withColumn("__part", bucket_of(whole, quantile_bounds(seen, whole))))
    placed = running_total(parts, ["__g"], "__part", [F.col(value)], {}, "__at").join(groups.drop(group), "__g")
    middle = placed.filter("__n >= 3 AND __at BETWEEN (__n - 1) DIV 2 AND __n DIV 2").groupBy("__g").agg(F.avg(value).alias("trimmed_median"))
    return groups.join(middle, "__g", "left").select(group, "trimmed_median")


def vector_mean(df: DataFrame, group: Column, vector: str, dims: int) -> DataFrame:
    """(group, place, mean): element-wise means, one partial aggregate a place."""
    means = df.groupBy(group.alias("grp")).agg(F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dims))).alias("m"))
    return means.select("grp", F.posexplode("m").alias("place", "mean")).withColumn("place", F.col("place").cast("long"))
