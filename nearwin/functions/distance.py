"""Distances as column expressions: unrolled over attributes, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwin.spec import FeatureSpec

At = Callable[[str], Column]


@dataclass(frozen=True)
class Range:
    """Least and greatest value of an attribute, none seen: both None; and whether any value is missing."""

    low: float | None
    high: float | None
    missing: bool = True

    @property
    def width(self) -> float:
        return 0.0 if self.low is None else self.high - self.low

    def norm(self, x: Column) -> Column:
        """0 to 1 within the range; 0 for a range without width."""
        return (x - F.lit(self.low)) / F.lit(self.width) if self.width else F.when(x.isNotNull(), 0.0)


def numeric_difference(a: Column, b: Column, r: Range, raw: bool = False) -> Column:
    """Difference of two numeric values. Both missing: 1 (raw: the width). One missing: as far as the range lets it be."""
    if raw:
        far = lambda v: F.greatest(F.lit(r.high) - v, v - F.lit(r.low)) if r.low is not None else F.lit(0.0)
        both, plain = F.lit(float(r.width)), a - b
    else:
        far = lambda v: F.when(r.norm(v) < 0.5, 1.0 - r.norm(v)).otherwise(r.norm(v))
        both, plain = F.lit(1.0), r.norm(a) - r.norm(b)
    return F.when(a.isNull() & b.isNull(), both).when(a.isNull(), far(b)).when(b.isNull(), far(a)).otherwise(plain)


def normal_difference(a: Column, b: Column, missing: bool = True) -> Column:
    """The same for two values that are normalised already; plain where none is missing."""
    if not missing:
        return a - b
    far = lambda v: F.when(v < 0.5, 1.0 - v).otherwise(v)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull(), far(b)).when(b.isNull(), far(a)).otherwise(a - b)


def nominal_difference(a: Column, b: Column) -> Column:
    """0 for equal values; 1 for unequal ones and if either is missing."""
    return F.when(a == b, 0.0).otherwise(1.0)


def squared(a: At, b: At, spec: FeatureSpec, ranges: dict[str, Range], raw: bool = False) -> Column:
    """Sum of squared differences, numeric attributes first, from left to right."""
    parts = [numeric_difference(a(c), b(c), ranges[c], raw) for c in spec.numeric] + [nominal_difference(a(c), b(c)) for c in spec.nominal]
    return reduce(lambda s, d: s + d * d, parts[1:], parts[0] * parts[0]) if parts else F.lit(0.0)


def normal_squared(a: At, b: At, spec: FeatureSpec, ranges: dict[str, Range]) -> Column:
    """``squared`` of rows whose numeric attributes are normalised already, once a row and not once a pair."""
    parts = [normal_difference(a(c), b(c), ranges[c].missing) for c in spec.numeric] + [nominal_difference(a(c), b(c)) for c in spec.nominal]
    return reduce(lambda s, d: s + d * d, parts[1:], parts[0] * parts[0]) if parts else F.lit(0.0)


def cut_off(d2: Column, most: float) -> Column:
    """Infinite beyond ``most``."""
    return F.when(d2 > most, F.lit(float("inf"))).otherwise(d2)


def array_squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of doubles, folded from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unrolled_squared(a: Column, b: Column, dims: int) -> Column:
    """The same for arrays of a known, moderate length, as one expression that generated code takes in whole."""
    each = lambda i: F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)).cast("double")
    return reduce(lambda s, i: s + each(i) * each(i), range(1, dims), each(0) * each(0))


def sparse_squared(a: Column, b: Column) -> Column:
    """Squared distance of two maps from place to value; what is absent is 0."""
    diff = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    by_place = F.array_sort(F.map_entries(diff))
    return F.aggregate(by_place, F.lit(0.0), lambda s, e: s + e["value"] * e["value"])
