"""Nearest-neighbour classifiers whose search, metric, weights and options are arguments: ``fit`` a table, ``transform`` another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.functions.distance import Range
from nearwin.operators import balls, knn, ranges, votes
from nearwin.spec import FeatureSpec, SearchOptions


@dataclass(frozen=True)
class Task:
    """What a search is given: rows, their ranges, how to measure, and which rows don't count."""

    train: DataFrame
    spec: FeatureSpec
    ranges: dict[str, Range]
    options: SearchOptions
    metric: str
    k: int
    leave_one_out: bool

    def column(self, name: str) -> Column:
        """A numeric attribute as it is measured: normalised, or as it is with raw distances."""
        return F.col(name).cast("double") if self.options.raw else self.ranges[name].norm(F.col(name))

    def euclidean(self, search: str) -> None:
        if self.metric != "euclidean":
            raise ValueError(f"the search {search} knows the euclidean metric alone")


def by_cells(task: Task, queries: DataFrame) -> DataFrame:
    """Grid cells: numbers and names, missing values; the Euclidean metric."""
    task.euclidean("cells")
    return knn.nearest(task.train, queries, task.spec, task.ranges, task.k, raw=task.options.raw, leave_one_out=task.leave_one_out, skip_identical=task.options.skip_identical)


def by_pairs(task: Task, queries: DataFrame) -> DataFrame:
    """Every query with every row, for small tables: what other searches are held against. Numbers and names."""
    task.euclidean("pairs")
    d2 = knn.measured(task.spec, task.ranges, task.options.raw)
    rows = task.train.select(F.col(task.spec.key).alias("id"), *task.spec.attributes)
    pairs = knn.spread(rows).join(knn.sent(knn.sided(queries, task.spec)))  # queries in blocks against all rows
    return knn.ranked(pairs.filter(knn.kept(d2, task.leave_one_out, task.options.skip_identical)).select("qid", "id", d2.alias("d2")), task.k)


def by_balls(build: Callable[[DataFrame, int, balls.Metric], balls.Tree]) -> Callable[[Task, DataFrame], DataFrame]:
    """A tree of balls: numbers without missing values, any metric of ``balls.METRICS``. It finds what must be left out too and drops it."""

    def search(task: Task, queries: DataFrame) -> DataFrame:
        if task.spec.nominal:
            raise ValueError("trees of balls measure numbers alone")
        if task.options.skip_identical:
            raise ValueError("trees of balls skip no identical rows: there may be any number of them")
        dims = len(task.spec.numeric)
        point = lambda df: df.select(F.col(task.spec.key).alias("id"), F.array(*map(task.column, task.spec.numeric)).alias("v"))
        tree = build(point(task.train), dims, balls.METRICS[task.metric])
        found = balls.nearest(tree, point(queries), "id", "v", task.k + task.leave_one_out)
        if task.leave_one_out:
            found = knn.ranked(found.filter("qid <> id").drop("rank"), task.k)
        return found

    return search


SEARCHES: dict[str, Callable[[Task, DataFrame], DataFrame]] = {
    "cells": by_cells,
    "pairs": by_pairs,
    "ball_tree": by_balls(lambda df, dims, metric: balls.ball_tree(df, "id", "v", dims, metric)),
    "cover_tree": by_balls(lambda df, dims, metric: balls.cover_tree(df, "id", "v", dims, metric, leaf=1024)[0]),
}


@dataclass(frozen=True)
class KnnClassifier:
    """k nearest neighbours by a named search and metric, votes by ``weights`` (see ``votes.weight``) over a prior of 1 / ``window``."""

    k: int = 16
    search: str = "cells"
    metric: str = "euclidean"
    weights: str = "none"
    window: int = 1
    options: SearchOptions = SearchOptions()
    leave_one_out: bool = False

    def fit(self, train: DataFrame, spec: FeatureSpec) -> KnnModel:
        """Takes the attributes that the options choose, their ranges, and the classes in order."""
        chosen = spec.select(self.options.attributes, self.options.invert)
        classes = [r[0] for r in train.select(spec.label).filter(F.col(spec.label).isNotNull()).distinct().sort(spec.label).collect()]  # a row a class
        return KnnModel(self, train, chosen, ranges.ranges_of(train, chosen.numeric), classes)


@dataclass(frozen=True)
class KnnModel:
    """A classifier with its rows; ``updated`` takes more in."""

    of: KnnClassifier
    train: DataFrame
    spec: FeatureSpec
    ranges: dict[str, Range]
    classes: list

    def updated(self, more: DataFrame) -> KnnModel:
        return replace(self.of).fit(self.train.unionByName(more), self.spec)

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """(qid, id, d2, rank, label), equal distances by id."""
        task = Task(self.train, self.spec, self.ranges, self.of.options, self.of.metric, self.of.k, self.of.leave_one_out)
        found = SEARCHES[self.of.search](task, queries)
        return found.join(self.train.select(F.col(self.spec.key).alias("id"), F.col(self.spec.label).alias("label")), "id").select("qid", "id", "d2", "rank", "label")

    def votes(self, queries: DataFrame) -> DataFrame:
        """(qid, label, p) for each query and class."""
        return votes.distribution(self.neighbours(queries), self.classes, self.of.window, votes.weight(self.of.weights, len(self.spec.attributes)))

    def transform(self, queries: DataFrame) -> DataFrame:
        """(qid, truth, label, p): the likeliest class of each query, beside its own."""
        own = queries.select(F.col(self.spec.key).alias("qid"), F.col(self.spec.label).alias("truth"))
        return votes.predicted(self.votes(queries)).join(own, "qid").select("qid", "truth", "label", "p")
