"""Exact nearest neighbours by places in Morton orders: candidates beside a query's place, a box around what is open, then proof."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.operators.knn import kth, ranked, sent, spread
from nearwin.operators.ranges import ranges_of
from nearwin.plans.ordering import bucket_of, running_total
from nearwin.plans.shared import written

#: Shifted orders, and rows looked at on either side of a query's place in each, times k.
ORDERS, BESIDE = 3, 2
#: Rows that a task puts in order; places of a block that round 2 meets, until there are MOST_BLOCKS; from there blocks grow.
PART, BLOCK, MOST_BLOCKS = 1 << 18, 128, 1 << 17
#: The box of a distance is taken to be wider by this share, against rounding.
SLACK = 1e-9


def interleaved(values: list[Column], bits: int) -> Column:
    """The bits of whole numbers under 2^bits, dealt in turn, the first number's at the bottom: at most 62 terms, so generated code takes them in."""
    bit = lambda v, i: F.shiftright(v.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(bit(v, i), i * len(values) + d) for i in range(bits) for d, v in enumerate(values)))


class Orders:
    """Shifted Morton orders over the ranges of some columns: codes of points, and codes that hold a box between them.

    A number becomes a step of half of 2^bits along its range, and each order adds its own shift of up to the other half.
    """

    def __init__(self, df: DataFrame, dims: tuple[str, ...], shifts: int) -> None:
        self.dims, self.ranges, self.bits = dims, ranges_of(df, dims), min(24, 62 // len(dims))
        self.steps = (1 << (self.bits - 1)) - 1
        self.shifts = [i * self.steps // shifts for i in range(shifts)]

    def step(self, dim: str, value: Column) -> Column:
        r = self.ranges[dim]
        at = (value - F.lit(float(r.low))) / F.lit(float(r.width)) if r.width else F.lit(0.0)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)) * self.steps).cast("long")

    def code(self, steps: list[Column], shift: int) -> Column:
        return interleaved([v + F.lit(shift).cast("long") for v in steps], self.bits)

    def stepped(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """``df`` with s_<dim>, the steps of its values: a column each, as every bit of a code looks at them."""
        return df.withColumns({f"s_{d}": self.step(d, F.col(prefix + d)) for d in self.dims})

    def boxed(self, asked: DataFrame) -> DataFrame:
        """``asked`` with l_<dim> and h_<dim>, the steps at or below and at or above those of all points within ``far`` in every dimension."""
        wide = F.col("far") * (1 + SLACK)
        return asked.withColumns({f"{name}_{d}": self.step(d, F.col(f"q_{d}") + sign * wide) for name, sign in (("l", -1), ("h", 1)) for d in self.dims})

    def spans(self, boxes: DataFrame, shift: int) -> DataFrame:
        """Boxes as stretches ``from`` to ``to`` of codes that hold them: one for each cell that a box meets, at most two a dimension.

        Cells are those of the first power of two over the box's longest side, so however many edges of larger cells a box
        lies across, its stretches hold no more than the area around it. One without a bound gets all codes.
        """
        low, high = ([F.col(f"{name}_{d}") + F.lit(shift).cast("long") for d in self.dims] for name in "lh")
        side = F.greatest(*(b - a for a, b in zip(low, high, strict=True))) if len(low) > 1 else high[0] - low[0]
        level = F.when(side > 0, F.length(F.bin(side))).otherwise(0)
        boxes = boxes.withColumn("level", level).withColumns({"low": interleaved(low, self.bits), "high": interleaved(high, self.bits)})
        boxes = boxes.withColumns({f"{name}_{d}": F.call_function("shiftright", c, F.col("level")) for name, of in (("l", low), ("h", high)) for d, c in zip(self.dims, of, strict=True)})
        corners = [interleaved([F.col(f"{name}_{d}") for name, d in zip(names, self.dims, strict=True)], self.bits) for names in product("lh", repeat=len(self.dims))]
        boxes = boxes.withColumn("cell", F.explode(F.array_distinct(F.array(*corners))))
        up = lambda c: F.call_function("shiftleft", c, F.col("level") * len(self.dims))
        ends = {"from": F.greatest(up(F.col("cell")), "low"), "to": F.least(up(F.col("cell") + 1) - 1, "high")}
        free = {"from": F.lit(0).cast("long"), "to": F.lit((1 << 62) - 1)}
        return boxes.withColumns({c: F.when(F.col("bound").isNull(), free[c]).otherwise(e) for c, e in ends.items()})


def placed(points: DataFrame, code: str) -> DataFrame:
    """``points`` with ``position``, their place in the order of ``code`` from 0: ranges of codes to tasks, then the totals before each."""
    n = points.sparkSession.sparkContext.defaultParallelism
    parts = written(points.repartitionByRange(max(n, -(-points.count() // PART)), code).withColumn("part", F.spark_partition_id()))
    return written(running_total(parts, [], "part", [F.col(code)], {}, "position").drop("part"))


def beside(rows: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """Queries (qid, q_at, ...) with the rows up to ``reach`` places before and after theirs: an equality join on blocks of places."""
    block = lambda c: F.floor(F.col(c) / reach)
    sides = asked.withColumn("block", F.explode(F.sequence(block("q_at") - 1, block("q_at") + 1)))
    met = rows.withColumn("block", block("position")).join(sent(sides), "block")
    return met.filter(F.abs(F.col("position") - F.col("q_at")) <= reach).drop("block")


def nearest(df: DataFrame, queries: DataFrame, key: str, dims: tuple[str, ...], k: int, shifts: int = ORDERS, near: int = BESIDE) -> tuple[DataFrame, DataFrame]:
    """((qid, id, d2, rank), (qid, round)): exactly the k nearest by raw distance, equal ones by id, and the round that proved them.

    First the rows beside a query in every order give candidates, and the k-th distance a cube. If in one of the orders the
    codes of the cube's corners lie strictly between those of the outermost candidates, no nearer row was missed (round
    1). The others meet, in the first order, all rows of the cells, about as large as the cube, that it lies in (round 2).

    Queries are rows of ``df``; rows and queries with a missing value or without a key have no place and are left out. Rows
    that differ by less than a step share a code and stand together in any order.
    """
    points = df.dropna(subset=[key, *dims]).select(F.col(key).alias("id"), *(F.col(d).cast("double").alias(d) for d in dims))
    points = spread(points)
    orders, reach = Orders(points, dims, shifts), max(1, near * k)
    codes = {f"c{s}": orders.code([F.col(f"s_{d}") for d in dims], shift) for s, shift in enumerate(orders.shifts)}
    points = written(orders.stepped(points).withColumns(codes).select("id", *dims, *codes))
    n = points.count()
    d2 = reduce(lambda a, b: a + b, ((F.col(f"q_{d}") - F.col(d)) * (F.col(f"q_{d}") - F.col(d)) for d in dims))
    asked = written(queries.dropna(subset=[key, *dims]).select(F.col(key).alias("qid"), *(F.col(d).cast("double").alias(f"q_{d}") for d in dims)).distinct())
    pairs, spans, first = [], [], None
    for s in range(len(orders.shifts)):
        order = placed(points.select("id", *dims, F.col(f"c{s}").alias("code")), "code")
        first = first or order
        home = order.join(sent(asked.select("qid").distinct()), F.col("id") == F.col("qid"), "left_semi").groupBy("id").agg(F.min("position").alias("q_at"))
        met = written(beside(order, asked.join(home, asked.qid == home.id).drop("id"), reach).select("qid", "id", d2.alias("d2"), "code", "position", "q_at"))
        pairs.append(met.select("qid", "id", "d2"))
        before, after = F.min("position") > 0, F.max("position") < n - 1
        spans.append(met.groupBy("qid").agg(F.lit(s).alias("s"), F.when(before, F.min("code")).alias("first"), F.when(after, F.max("code")).alias("last")))
    found = written(reduce(DataFrame.unionByName, pairs).distinct())
    bounded = written(orders.boxed(asked.join(kth(found, k), "qid", "left").withColumn("far", F.sqrt("bound"))))
    corner = lambda name, shift: orders.code([F.col(f"{name}_{d}") for d in dims], shift)
    boxes = reduce(DataFrame.unionByName, (bounded.select("qid", F.lit(s).alias("s"), corner("l", x).alias("low"), corner("h", x).alias("high")) for s, x in enumerate(orders.shifts)))
    sure = (F.col("first").isNull() | (F.col("low") > F.col("first"))) & (F.col("last").isNull() | (F.col("high") < F.col("last")))
    held = boxes.join(reduce(DataFrame.unionByName, spans), ["qid", "s"])
    proved = held.groupBy("qid").agg(F.bool_or(F.coalesce(sure, F.col("first").isNull() & F.col("last").isNull())).alias("proved"))
    rounds = written(proved.select("qid", F.when(F.col("proved"), 1).otherwise(2).alias("round")))

    block = F.floor(F.col("position") / max(BLOCK, -(-n // MOST_BLOCKS)))
    starts = [r["code"] for r in first.groupBy(block.alias("block")).agg(F.min("code").alias("code")).sort("block").collect()]  # a number a block
    stretches = orders.spans(bounded.join(rounds.filter("round = 2").select("qid"), "qid", "left_semi"), orders.shifts[0])
    of = lambda c: F.greatest(F.lit(0), bucket_of(c, starts) - 1)
    stretches = stretches.select("qid", "bound", *(f"q_{d}" for d in dims), of(F.col("from") - 1).alias("a"), of(F.col("to")).alias("b"))
    again = written(stretches.select("*", F.explode(F.sequence("a", "b")).alias("block")).drop("a", "b").distinct())
    met = first.withColumn("block", block).join(sent(again), "block").filter(F.col("bound").isNull() | (d2 <= F.col("bound"))).select("qid", "id", d2.alias("d2"))
    every = found.join(rounds.filter("round = 1").select("qid"), "qid", "left_semi").unionByName(met)
    return ranked(every, k), rounds
