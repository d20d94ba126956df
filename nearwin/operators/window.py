"""Nearest neighbours in a moving window of rows: test, then train, as one batch plan."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.functions.distance import nominal_difference, normal_difference
from nearwin.operators.knn import ranked
from nearwin.operators.ranges import positioned
from nearwin.plans.shared import written
from nearwin.spec import FeatureSpec
from nearwin.streaming.window import squared


def members(at: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """Each query beside the ``size`` rows before it: an equality join on blocks of ``size`` positions, two a query.

    ``at`` and ``queries`` have a ``position``; columns of queries are named apart (qid, q_...), their position is ``q_at``.
    """
    block = F.floor(F.col("position") / size)
    rows = at.withColumn("block", block)
    asked = queries.withColumn("block", F.explode(F.array(F.floor(F.col("q_at") / size) - 1, F.floor(F.col("q_at") / size))))
    return rows.join(asked, "block").filter((F.col("position") < F.col("q_at")) & (F.col("position") >= F.col("q_at") - size)).drop("block")


def bounds(spec: FeatureSpec) -> dict:
    """Least and greatest value of each numeric attribute, by name."""
    return {f"low_{c}": F.min(c) for c in spec.numeric} | {f"high_{c}": F.max(c) for c in spec.numeric}


def asking(spec: FeatureSpec, *more: str) -> list:
    """A query's columns beside ``more``: its id and attributes under other names, and its ranges."""
    return [F.col(spec.key).alias("qid"), *more, *(F.col(c).alias(f"q_{c}") for c in spec.attributes), *bounds(spec)]


def measured(spec: FeatureSpec):
    """The squared distance of a row from a query that brings its ranges; an attribute without width there adds nothing.

    Missing values differ as in ``normal_difference``: both missing by 1, one by as far as the range lets the other be.
    """

    def scaled(name: str, c: str):
        width = F.col(f"high_{c}") - F.col(f"low_{c}")
        return F.when(width > 0, (F.col(name) - F.col(f"low_{c}")) / width).when(F.col(name).isNotNull(), 0.0)

    parts = [normal_difference(scaled(f"q_{c}", c), scaled(c, c)) for c in spec.numeric] + [nominal_difference(F.col(f"q_{c}"), F.col(c)) for c in spec.nominal]
    return reduce(lambda s, d: s + d * d, parts[1:], parts[0] * parts[0]).alias("d2")


#: Positions in a block of ``window_nearest``, at least, and queries of a block that are answered together.
BLOCK, TOGETHER = 4096, 256


def window_nearest(df: DataFrame, spec: FeatureSpec, size: int, k: int, keep: str = "true", block: int = BLOCK) -> DataFrame:
    """(qid, id, d2, rank, label): the k nearest of the ``size`` rows before each row, once there are so many.

    Rows are dealt in blocks of positions; each block also gets the last ``size`` rows of the one before, and is answered in a
    task, some queries at a time, from slices of its columns: no pair becomes a row. Ranges come from the values seen in
    a query's rows alone; see ``measured`` for missing values (nan counts as one). ``keep`` is a condition on the rows that
    are asked. Equal distances: the smaller id first.
    """
    block = max(block, size)
    rows = positioned(df.select(spec.key, *spec.attributes, spec.label), spec.key)
    home = F.floor(F.col("position") / block)
    to = F.when(F.col("position") % block >= block - size, F.array(home, home + 1)).otherwise(F.array(home))
    numbers, names = ([f"__{kind}{i}" for i in range(len(of))] for kind, of in (("x", spec.numeric), ("c", spec.nominal)))
    dealt = rows.select(
        F.col(spec.key).alias("id"), F.col("position").alias("__at"), F.expr(keep).alias("__keep"), F.col(spec.label).alias("label"), F.explode(to).alias("__block"),
        *(F.col(c).cast("double").alias(n) for c, n in zip(spec.numeric, numbers, strict=True)), *(F.col(c).cast("string").alias(n) for c, n in zip(spec.nominal, names, strict=True)),
    )

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("__at").combine_chunks()
        at = group.column("__at").to_numpy()
        x = np.stack([group.column(n).to_numpy().astype(float) for n in numbers], axis=1) if numbers else np.zeros((len(at), 0))
        codes = [pc.fill_null(pc.dictionary_encode(group.column(n)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False) for n in names]
        own = at >= group.column("__block")[0].as_py() * block
        asked = np.flatnonzero(own & (at >= size) & pc.fill_null(group.column("__keep"), False).to_numpy())
        q, near, d2 = [asked[:0]], [asked[:0]], [np.zeros(0)]
        for i in range(0, len(asked), TOGETHER):
            some = asked[i : i + TOGETHER]
            window = some[:, None] + np.arange(-size, 0)
            far = squared(x[window], x[some])
            for c in codes:
                far += (c[window] != c[some][:, None]) | (c[window] < 0)
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            q.append(np.repeat(some, best.shape[1]))
            near.append(np.take_along_axis(window, best, axis=1).reshape(-1))
            d2.append(np.take_along_axis(far, best, axis=1).reshape(-1))
        q, near = np.concatenate(q), np.concatenate(near)
        rank = np.arange(len(q)) % min(k, size) + 1
        ids, labels = group.column("id"), group.column("label")
        return pa.table({"qid": ids.take(pa.array(q)), "id": ids.take(pa.array(near)), "d2": np.concatenate(d2), "rank": pa.array(rank, pa.int64()), "label": labels.take(pa.array(near))})

    key, label = (dealt.schema[c].dataType.simpleString() for c in ("id", "label"))
    return dealt.groupBy("__block").applyInArrow(answer, f"qid {key}, id {key}, d2 double, rank long, label {label}")


def held_out_nearest(df: DataFrame, spec: FeatureSpec, train: int, test: int, size: int, k: int) -> DataFrame:
    """(qid, period, truth, id, d2, rank, label): neighbours of the rows of test stretches among the rows learned before.

    In the order of the key, ``train`` rows are learned, the next ``test`` rows are asked and not learned, and so on. A
    query meets the last ``size`` rows of its period's train stretch, which give the ranges too; so rows meet on the
    period alone, ``size`` x ``test`` pairs in each. Equal distances: the smaller id first.
    """
    if not 0 < k <= size <= train:
        raise ValueError("0 < k <= size <= train")
    at = positioned(df.select(spec.key, *spec.attributes, spec.label), spec.key)
    at = written(at.withColumns({"period": F.floor(F.col("position") / (train + test)), "place": F.col("position") % (train + test)}))
    learned = at.filter(F.col("place").between(train - size, train - 1))
    asked = at.filter(F.col("place") >= train).join(learned.groupBy("period").agg(*(c.alias(n) for n, c in bounds(spec).items())), "period")
    rows = learned.select("period", F.col(spec.key).alias("id"), *spec.attributes, F.col(spec.label).alias("label"))
    pairs = rows.join(asked.select(*asking(spec, "period"), F.col(spec.label).alias("truth")), "period")
    return ranked(pairs.select("qid", "period", "truth", "id", measured(spec), "label"), k)
