"""Scores of predictions: accuracy, kappa, temporal kappa, confusion, periodic hold-out, agreement of two classifiers.

A prediction table has qid (its order), truth and label. Sums over it are partial aggregates; the label before a row
comes by a join on positions, so no step needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.operators.ranges import positioned
from nearwin.plans.shared import written


def hit() -> Column:
    return F.when(F.col("truth") == F.col("label"), 1.0).otherwise(0.0)


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "label").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit()) * 100, 6).alias("accuracy_pct"))


def chance_corrected(p0: Column, chance: Column) -> Column:
    """(p0 - chance) / (1 - chance), null where chance is certain."""
    return F.when(chance < 1, (p0 - chance) / (F.lit(1.0) - chance))


def kappa(predictions: DataFrame) -> DataFrame:
    """Agreement beyond that of independent truths and predictions with the same shares of classes."""
    counts = confusion(predictions)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("label"), F.col("n")).otherwise(0)).alias("hits"))
    truths, labels = counts.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("a")), counts.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("b"))
    both = truths.join(labels, "c").agg(F.coalesce(F.sum((F.col("a") * F.col("b")).cast("decimal(38,0)")), F.lit(0)).alias("ab"))
    one = total.join(F.broadcast(both))  # a row each
    p0, pc = F.col("hits") / F.col("n"), F.col("ab").cast("double") / (F.col("n").cast("double") * F.col("n").cast("double"))
    return one.select("n", F.round(chance_corrected(p0, pc) * 100, 6).alias("kappa_pct"))


def kappa_temporal(predictions: DataFrame) -> DataFrame:
    """Agreement beyond that of repeating the truth of the row before; the first row counts as no repeat."""
    at = written(positioned(predictions, "qid"))
    before = at.select((F.col("position") + 1).alias("position"), F.col("truth").alias("was"))
    joined = at.join(before, "position", "left")
    sums = joined.agg(F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("p0"), F.avg(F.when(F.col("truth") == F.col("was"), 1.0).otherwise(0.0)).alias("pp"))
    return sums.select("n", F.round(chance_corrected(F.col("p0"), F.col("pp")) * 100, 6).alias("kappa_temporal_pct"))


def periodic(predictions: DataFrame) -> DataFrame:
    """Rows and accuracy of each ``period`` of the predictions."""
    return predictions.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit()) * 100, 6).alias("accuracy_pct"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """On how many rows two classifiers say the same, and how many each has right."""
    both = first.select("qid", "truth", F.col("label").alias("label")).join(second.select("qid", F.col("label").alias("other")), "qid")
    same = F.when(F.col("label") == F.col("other"), 1.0).otherwise(0.0)
    other = F.when(F.col("truth") == F.col("other"), 1.0).otherwise(0.0)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same) * 100, 6).alias("agree_pct"), F.round(F.avg(hit()) * 100, 6).alias("first_pct"), F.round(F.avg(other) * 100, 6).alias("second_pct"))

