"""Votes of neighbours: class distributions, predictions and regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight(kind: str, attributes: int, d2: Column | None = None) -> Column:
    """``none``: 1; ``inverse``: 1 / (rooted mean distance + 0.001); ``similarity``: 1 less that distance."""
    d = F.sqrt((F.col("d2") if d2 is None else d2) / F.lit(float(attributes)))
    return {"none": F.lit(1.0), "inverse": F.lit(1.0) / (d + F.lit(0.001)), "similarity": F.lit(1.0) - d}[kind]


def distribution(neighbours: DataFrame, classes: list, window: int, weights: Column, label: str = "label") -> DataFrame:
    """(qid, label, p) for each query and class: the prior 1 / window a class plus the neighbours' weights, to a sum of 1."""
    prior = 1.0 / max(1, window)
    summed = neighbours.groupBy("qid").agg(*(F.sum(F.when(F.col(label) == c, weights).otherwise(0.0)).alias(f"v{i}") for i, c in enumerate(classes)))
    total = sum((F.col(f"v{i}") for i in range(len(classes))), F.lit(0.0)) + F.lit(len(classes) * prior)
    each = F.array(*(F.struct(F.lit(c).alias("label"), ((F.col(f"v{i}") + prior) / total).alias("p")) for i, c in enumerate(classes)))
    return summed.select("qid", F.inline(each))


def predicted(votes: DataFrame) -> DataFrame:
    """(qid, label, p): the likeliest class; of equals the first in order."""
    return votes.groupBy("qid").agg(F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("label"), F.max("p").alias("p"))


def regression(neighbours: DataFrame, weights: Column, value: str = "label") -> DataFrame:
    """(qid, estimate): the weighted mean of the neighbours' values."""
    return neighbours.groupBy("qid").agg((F.sum(F.col(value) * weights) / F.sum(weights)).alias("estimate"))
