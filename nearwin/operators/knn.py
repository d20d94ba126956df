"""Nearest neighbours of a query set among all rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.functions.distance import Range, normal_squared, squared
from nearwin.operators import blocks
from nearwin.plans.shared import unsent, written
from nearwin.spec import FeatureSpec

#: Query rows that are sent to every task; more are met in blocks of partitions, which needs no copy anywhere.
MOST_SENT = 50_000
#: About so many rows make the sample that bounds the search of queries whose own cell holds fewer than k rows.
SAMPLE = 4096
#: Pairs in all, and times a cell's rows a query, beyond which equal rows are met once and nominal attributes split the search.
MOST_MET, MOST_CELLS = 100_000_000, 32
#: Pairs that a task makes, about, and rows that it holds for them, before they are dealt to more tasks.
PAIRS, HELD = 1 << 21, 1 << 19
#: Queries that show about how many rows all of them reach.
SHOWN = 1000
#: Nominal attributes that split a search at most: a search for each of their subsets.
SPLIT_BY = 2


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it would be read by fewer tasks."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def sent(queries: DataFrame) -> DataFrame:
    """The query side, broadcast only if a count shows that it is small."""
    return F.broadcast(queries) if queries.limit(MOST_SENT + 1).count() <= MOST_SENT else queries


def met(rows: DataFrame, asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of ``rows`` and the queries ``asked`` in their cells, dealt so that a task makes about ``PAIRS`` of them from ``HELD`` rows, however many there are.

    ``sizes`` has cell and n, its rows at most. The queries of a cell with more pairs go to several tasks, each with the cell's rows.
    """
    load = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(sizes.select("cell", "n"), "cell")
    load = written(load.select("cell", "asked", (F.col("asked") * F.col("n")).alias("pairs")))
    total = load.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.max("pairs"), F.lit(0)).alias("most")).first()
    if total["pairs"] <= PAIRS and total["asked"] <= MOST_SENT:
        return rows.join(F.broadcast(asked), "cell")
    part = F.lit(0)
    if total["most"] > PAIRS:
        large = sent(load.filter(F.col("pairs") > PAIRS).select("cell", F.ceil(F.col("pairs") / PAIRS).cast("int").alias("parts")))
        parts, part = F.coalesce("parts", F.lit(1)), F.col("part")
        asked = asked.join(large, "cell", "left").withColumn("part", F.pmod(F.xxhash64("qid"), parts).cast("int")).drop("parts")
        rows = rows.join(large, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    spark = rows.sparkSession
    held = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["pairs"] // PAIRS), -(-held // HELD))
    here = lambda df: df.withColumn("slot", F.xxhash64("cell", part)).drop("part").repartition(tasks, "slot")
    pairs = here(asked).join(unsent(here(rows).withColumnRenamed("cell", "__cell")), "slot")
    return pairs.filter(F.col("cell").bitwiseXOR(F.col("__cell")) == 0).drop("slot", "__cell")  # slots may collide; an equality would become a key


def over_tasks(asked: DataFrame, n: int, each: int) -> DataFrame:
    """``n`` queries over all cores, and over more tasks if each of them makes ``each`` pairs and these are many."""
    return asked.repartition(max(asked.sparkSession.sparkContext.defaultParallelism, -(-n * each // PAIRS)))


def sided(queries: DataFrame, spec: FeatureSpec, *more: str) -> DataFrame:
    return queries.select(F.col(spec.key).alias("qid"), *(F.col(c).alias(f"q_{c}") for c in (*spec.attributes, *more)))


def measured(spec: FeatureSpec, ranges: dict[str, Range], raw: bool = False) -> Column:
    return squared(lambda c: F.col(f"q_{c}"), F.col, spec, ranges, raw)


def normalised(df: DataFrame, spec: FeatureSpec, ranges: dict[str, Range]) -> DataFrame:
    return df.withColumns({c: ranges[c].norm(F.col(c)) for c in spec.numeric}) if spec.numeric else df


def kth(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, bound): each query's k-th distance; queries with fewer pairs are left out."""
    if k == 1:
        return pairs.groupBy("qid").agg(F.min("d2").alias("bound"))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("d2"))
    return pairs.select("qid", "d2").withColumn("r", at).filter(F.col("r") <= k).filter(F.col("r") == k).select("qid", F.col("d2").alias("bound"))


def with_bounds(sides: DataFrame, pairs: DataFrame, rows: DataFrame, n: int, d2: Column, k: int, keep: Column) -> DataFrame:
    """``sides`` with ``bound``, a written table: the k-th distance among ``pairs``, else in a sample of ``rows``, else null."""
    own = written(sides.join(kth(pairs, k), "qid", "left"))
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0)
    unknown = own.filter("bound IS NULL").drop("bound")
    many = unknown.count()
    if not many:
        return own
    second = kth(over_tasks(unknown, many, 2 * SAMPLE).join(sent(part), keep).select("qid", d2.alias("d2")), k).withColumnRenamed("bound", "second")
    return written(own.join(second, "qid", "left").withColumn("bound", F.coalesce("bound", "second")).drop("second"))


@dataclass(frozen=True)
class Search:
    """What stays the same while one set of queries looks for neighbours: how, and which pairs count."""

    spec: FeatureSpec
    d2: Column
    k: int
    half: dict[str, float]
    keep: Column
    per_block: int

    def near(self) -> Column:
        return self.keep & (F.col("bound").isNull() | (self.d2 <= F.col("bound")))


def candidates(
    train: DataFrame, queries: DataFrame, spec: FeatureSpec, d2: Column, k: int, half: dict[str, float],
    keep: Column | None = None, extra: tuple[str, ...] = (), per_block: int = blocks.PER_BLOCK, ties: bool = False, own: bool = True,
) -> DataFrame:
    """(qid, id, d2, ...) of pairs that can be among a query's k nearest.

    The k-th distance among any part of the rows bounds the k-th of all, so nothing near is lost. That part is the query's
    own cell of a quantile grid (of an overfull cell every few rows); where that holds fewer than k rows, a sample of the
    table. A query then meets the rows of those cells only that its bound reaches. One without a bound meets all.

    Where those are too many, because rows are equal, or numeric attributes have few values or tell little, of rows equal
    in all attributes only those with the k (with ``own``, where a query's own row may not count, k + 1) smallest ids are
    met; for ``ties`` the others come back at the end. If they still are too many, nominal attributes split the search.
    """
    how = Search(spec, d2, k, half, F.lit(True) if keep is None else keep, per_block)
    columns = [c for c in dict.fromkeys((*spec.attributes, *extra)) if c != "id"]
    found = ["qid", "id", d2.alias("d2"), *(c for c in extra if c != "id")]
    rows, sides = spread(train.select(F.col(spec.key).alias("id"), *columns)), sided(queries, spec)
    placed, bounded, fine, reach, many = _reach(rows, sides, how)
    if not many:
        return met(placed.drop("coarse"), written(reach), fine).filter(how.near()).select(*found)
    place = F.row_number().over(Window.partitionBy(*spec.attributes).orderBy("id"))
    few = written(placed.drop("cell", "coarse").withColumn("place", place).filter(F.col("place") <= k + own).drop("place"))
    few, bounded, fine, reach, many = _reach(few, sides, how)
    if many and spec.nominal:
        pairs = split(few.drop("cell", "coarse"), bounded, how)
    else:
        pairs = met(few.drop("coarse"), written(reach), fine).filter(how.near())
    if not ties:
        return pairs.select(*found)
    pairs = written(pairs.select("qid", "id", d2.alias("d2"), *spec.attributes))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("d2"))
    far = pairs.withColumn("at", at).filter(F.col("at") == k).select("qid", F.col("d2").alias("kth"))
    kinds = pairs.join(far, "qid", "left").filter(F.col("kth").isNull() | (F.col("d2") <= F.col("kth"))).groupBy("qid", *spec.attributes).agg(F.min("d2").alias("d2"))
    kinds = kinds.withColumnsRenamed({c: f"__{c}" for c in spec.attributes})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__{c}")), spec.attributes, F.lit(True))
    back = placed.drop("cell", "coarse").join(kinds, same)
    if own:
        back = back.join(sides, "qid").filter(how.keep)
    return back.select("qid", "id", "d2", *(c for c in extra if c != "id"))


def _reach(rows: DataFrame, sides: DataFrame, how: Search) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """``rows`` with their cells, queries with bounds, the cells' boxes, all written; the cells that each query reaches, not written; and whether those hold too many rows."""
    spec, d2 = how.spec, how.d2
    grid = blocks.laid(rows, spec.numeric, how.per_block)
    rows = written(grid.placed(rows))
    sides = grid.placed(sides, "q_").drop("coarse")
    fine = written(blocks.boxes(rows, ["cell", "coarse"], spec.numeric))
    scale = blocks.scales(fine, how.half)

    home = blocks.thinned(rows.join(sent(fine.select("cell", "n")), "cell"), how.per_block)
    pairs = met(home, sides, _thin(fine, how.per_block)).filter(how.keep).select("qid", d2.alias("d2"))
    bounded = with_bounds(sides.drop("cell"), pairs, rows.drop("cell", "coarse"), grid.n, d2, how.k, how.keep)

    coarse = blocks.joined_boxes(fine, ["coarse"], spec.numeric)  # at most (COARSE + 2) ** CUT boxes
    near = blocks.in_reach(spec.numeric, how.half, scale)
    first = lambda of: grid.reached(of, how.half, scale).join(F.broadcast(coarse), "coarse").filter(near).select(*bounded.columns, "coarse")
    reached = lambda of: first(of).join(sent(fine), "coarse").filter(near)
    asked = bounded.count()
    most = max(MOST_MET, asked * MOST_CELLS * how.per_block)
    few = bounded.filter(F.pmod(F.xxhash64("qid"), F.lit(max(1, asked // SHOWN))) == 0)  # decides between exact ways, no more
    shown = few.count() if asked else 0
    told = reached(over_tasks(few, shown, 1)).agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first() if shown else {"cells": 0, "n": 0}
    many = grid.n * asked > most and told["n"] * asked > most * shown
    reach = reached(over_tasks(bounded, asked, 1 + told["cells"] // max(1, shown))).select(*bounded.columns, "cell")
    return rows, bounded, fine, reach, many


def _thin(sizes: DataFrame, per_block: int) -> DataFrame:
    """The cells' rows once they are ``thinned``, at most."""
    return sizes.select("cell", F.least("n", F.lit(4 * per_block)).alias("n"))


def split(rows: DataFrame, bounded: DataFrame, how: Search) -> DataFrame:
    """The pairs of written tables ``rows`` and ``bounded`` that can be among a query's k nearest, by which nominal attributes match.

    The ``SPLIT_BY`` attributes with the most values split; each set of them is a search of its own among the rows that
    match in it and in no other of them: rows and queries meet in cells that hold the attributes' values too. Each of the
    others adds 1, so the larger sets come first and lower the bounds, and a query whose bound is below what a set's pairs
    add is not asked there. Attributes that do not split only count in the distance, so there are at most four searches
    however many there are.
    """
    nominal = how.spec.nominal
    values = rows.agg(*(F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(nominal))).first()
    by = [nominal[i] for i in sorted(range(len(nominal)), key=lambda i: -values[f"n{i}"])[:SPLIT_BY]]
    met = []
    for others in range(len(by) + 1):
        for same in combinations(by, len(by) - others):
            if others and bounded.filter(_open(others)).isEmpty():
                continue
            bounded, found = _matching(rows, bounded, same, [c for c in by if c not in same], how)
            met.append(found)
    return reduce(DataFrame.unionByName, met)


def _open(others: int) -> Column:
    return F.col("bound").isNull() | (F.col("bound") * (1 + blocks.SLACK) >= others)


def _matching(rows: DataFrame, bounded: DataFrame, same: tuple[str, ...], differ: list[str], how: Search) -> tuple[DataFrame, DataFrame]:
    """``bounded`` with bounds lowered by rows that match in ``same``, and the pairs that match there and not in ``differ``."""
    spec, others = how.spec, len(differ)
    of = lambda prefix: F.xxhash64(F.lit(0), *(F.col(prefix + c) for c in same))
    present = lambda df, prefix: df.filter(reduce(lambda a, c: a & F.col(prefix + c).isNotNull(), same, F.lit(True))).withColumn("group", of(prefix))
    alike = reduce(lambda a, c: a & (F.col(c) == F.col(f"q_{c}")), same, F.lit(True))
    alone = reduce(lambda a, c: a & ~F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False)), differ, alike)

    inside = present(rows, "")
    groups = inside.agg(F.approx_count_distinct("group")).first()[0]
    grid = blocks.laid(inside, spec.numeric, how.per_block * max(1, groups))
    placed = lambda df, prefix: grid.placed(df, prefix).withColumn("cell", F.xxhash64("group", "cell"))
    inside = placed(inside, "")
    fine = written(blocks.boxes(inside, ["group", "coarse", "cell"], spec.numeric))

    sizes, scale = fine.groupBy("cell").agg(F.sum("n").alias("n")), blocks.scales(fine, how.half)
    home = blocks.thinned(inside.drop("group", "coarse").join(sent(sizes), "cell"), how.per_block)
    sides = placed(present(bounded.filter(_open(others)), "q_"), "q_").drop("group", "coarse", "bound")
    own = kth(met(home, sides, _thin(sizes, how.per_block)).filter(alike & how.keep).select("qid", how.d2.alias("d2")), how.k).withColumnRenamed("bound", "second")
    bounded = written(bounded.join(own, "qid", "left").withColumn("bound", F.least("bound", "second")).drop("second"))

    asked = present(bounded.filter(_open(others)), "q_")
    reached = F.col("bound").isNull() | (blocks.away(spec.numeric, how.half, scale) + others <= F.col("bound") * (1 + blocks.SLACK))
    coarse = blocks.joined_boxes(fine, ["group", "coarse"], spec.numeric)
    asked = grid.reached(over_tasks(asked, asked.count(), blocks.COARSE), how.half, scale)
    first = asked.join(sent(coarse), ["group", "coarse"]).filter(reached).select(*bounded.columns, "group", "coarse")
    reach = written(first.join(sent(fine), ["group", "coarse"]).filter(reached).select(*bounded.columns, "cell").distinct())
    return bounded, met(inside.drop("group", "coarse"), reach, sizes).filter(alone & how.near())


def ranked(pairs: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """The k nearest with ``rank`` from 1: exactly k, equal distances by id; with ``ties`` also all as near as the k-th."""
    if ties:
        return pairs.withColumn("rank", F.rank().over(Window.partitionBy("qid").orderBy("d2")).cast("long")).filter(F.col("rank") <= k)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id")).cast("long")).filter(F.col("rank") <= k)


def nearest(train: DataFrame, queries: DataFrame, spec: FeatureSpec, ranges: dict[str, Range], k: int, *, ties: bool = False, raw: bool = False, leave_one_out: bool = False, skip_identical: bool = False, extra: tuple[str, ...] = (), per_block: int = blocks.PER_BLOCK) -> DataFrame:
    """(qid, id, d2, rank, ...) of each query's nearest rows by the mixed squared distance.

    ``leave_one_out`` leaves out the query's own row, ``skip_identical`` all rows at distance 0; about ``per_block`` rows
    make a cell of the search's grid.
    """
    if raw:
        d2, half = measured(spec, ranges, raw), {c: ranges[c].width / 2 for c in spec.numeric}
        return ranked(candidates(train, queries, spec, d2, k, half, kept(d2, leave_one_out, skip_identical), extra, per_block, ties, leave_one_out), k, ties)
    own = tuple(c for c in extra if c in spec.numeric)  # extra columns keep their own values
    train = train.withColumns({f"__{c}": F.col(c) for c in own}) if own else train
    train, queries = normalised(train, spec, ranges), normalised(queries, spec, ranges)
    d2, half = normal_squared(lambda c: F.col(f"q_{c}"), F.col, spec, ranges), dict.fromkeys(spec.numeric, 0.5)
    found = candidates(train, queries, spec, d2, k, half, kept(d2, leave_one_out, skip_identical), tuple(f"__{c}" if c in own else c for c in extra), per_block, ties, leave_one_out)
    return ranked(found.withColumnsRenamed({f"__{c}": c for c in own}), k, ties)


def kept(d2: Column, leave_one_out: bool, skip_identical: bool) -> Column:
    keep = F.lit(True)
    if leave_one_out:
        keep = keep & (F.col("qid") != F.col("id"))
    if skip_identical:
        keep = keep & (d2 > 0)
    return keep


def statistics(train: DataFrame, queries: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(qid, points, coordinates): rows and attribute values that an exhaustive search looks at for each query."""
    n = train.count()
    return queries.select(F.col(spec.key).alias("qid"), F.lit(n).cast("long").alias("points"), F.lit(n * len(spec.attributes)).cast("long").alias("coordinates"))
