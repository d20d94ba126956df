"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.plans.shared import unsent, written


#: Links in a file of a round's table: few links make few files and tasks.
PER_FILE = 100_000
#: Links up to which a round's joins may be broadcast.
MOST_SENT = 50_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(edges: DataFrame, beside: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One large-star step, then one small-star step; ``beside`` takes the least neighbours that are joined back."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    large = both.join(beside(least), "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(beside(low), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that it reaches.

    Alternating large-star and small-star steps over (greater, smaller) edges: each step groups by node with a partial
    minimum and joins it back, so a node with very many links is a skewed join, which AQE splits. Only a
    round of few links may broadcast a side. Each round is a written table; rounds end when a round changes nothing. Links with a null end or between a node and itself count as none.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges)
    was = _digest(edges)
    while was[0]:
        edges = written(_round(edges, unsent if was[0] > MOST_SENT else lambda df: df).coalesce(-(-was[0] // PER_FILE)))
        now = _digest(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
