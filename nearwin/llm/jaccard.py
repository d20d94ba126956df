"""Links of documents by the exact similarity (Jaccard) of their sets of shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.llm.components import components
from nearwin.llm.shingles import hashes, majority
from nearwin.llm.words import Start
from nearwin.plans.shared import unsent, written

#: Bands of minima, and minima in a band: of pairs at a similarity of 0.8, 1 - (1 - 0.8^5)^24 = 0.9999 share a band.
BANDS, DEEP = 24, 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
SLICE = 512
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * DEEP, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = {"node": pa.int64(), "size": pa.int32(), "fp": pa.int64(), "bands": pa.list_(pa.int64())}


def bands(found: np.ndarray) -> list[int]:
    """A signed long for each band: a hash of the band's number and of its minima over a set."""
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SLICE):
        np.minimum(least, (_FACTORS * found[None, at : at + SLICE]).min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(part.tobytes(), seed=i) - (1 << 63) for i, part in enumerate(least.reshape(BANDS, DEEP))] if len(found) else []


def sketch(text: Column, words: int) -> Column:
    """node, a hash of the text's whole set of shingles (0 for none), size, the set's, fp, its SimHash, and its bands."""
    start = Start()

    @F.arrow_udf("struct<node: bigint, size: int, fp: bigint, bands: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        start.once()
        rows = []
        for t in texts:
            every = hashes(t.as_py(), words)
            found = np.unique(every)
            rows.append((xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0, len(found), majority(every), bands(found)))
        columns = zip(*rows, strict=True) if rows else ((),) * len(SKETCH)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, SKETCH.values(), strict=True)], names=list(SKETCH))

    return of(text.cast("binary"))


def whole_set(text: Column, words: int) -> Column:
    """The sorted different hashes of a text's shingles, as signed longs."""
    start = Start()

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        start.once()
        return pa.array([np.unique(hashes(t.as_py(), words)).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of(text.cast("binary"))


def alike(a: Column, b: Column, least: tuple[int, int] = LEAST) -> Column:
    """Whether two sets given as arrays have a similarity of ``least`` or more, in whole numbers."""
    up, down = least

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            u, v = x.values.to_numpy(), y.values.to_numpy()
            both = np.sort(np.concatenate([u, v]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(down * shared >= up * (len(u) + len(v) - shared))
        return pa.array(out, pa.bool_())

    return of(a, b)


def sharing(nodes: DataFrame) -> DataFrame:
    """(node, size, key): the bands of a table of different nodes that at least two nodes have."""
    each = nodes.select("node", "size", F.explode("bands").alias("key"))
    several = each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    return written(each.join(unsent(several), "key").select("node", "size", "key"))


def met(one: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b): the different pairs of (node, size, other, other_size) whose sizes don't rule out a similarity of ``least``."""
    up, down = least
    fits = down * F.least("size", "other_size") >= up * F.greatest("size", "other_size")
    return one.filter("node != other").filter(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def to_pivots(shared: DataFrame) -> DataFrame:
    """(node, size, other, other_size): each node beside one node of each of its bands, which meets the most others in all its bands.

    In a group of near copies that is one with few changes, to which most of the group is similar.
    """
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = shared.join(unsent(counts), "key").groupBy("node", "size").agg(F.sum("n").alias("weight"))
    pivots = shared.join(unsent(weight.drop("size")), "node").groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("pivot"))
    return shared.join(unsent(pivots), "key").select("node", "size", F.col("pivot.node").alias("other"), F.col("pivot.size").alias("other_size"))


def crossing(held: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(node, size, other, other_size) of different roots that may be similar; none that is similar is left out.

    ``held``: a table (node, size, root). Similar sets share one of their rarest tokens: put in the order of how many
    nodes have them, a set of n tokens must show a common one among its first n - ceil(s n) + 1, and from there on both
    sets must have tokens enough left for the overlap that similarity s asks for. So nodes meet in such tokens alone, and
    the places of the token in both sets decide in the join. A token's nodes of its most frequent root never meet each
    other, and before they meet the rest, both sides lose what cannot fit the other side's best place and least size. So
    a large group that is one component already costs what the nodes outside of it do.
    """
    up, down = least
    tokens = held.join(unsent(sets), "node").select("node", "size", "root", F.explode("set").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    some = tokens.join(unsent(counts), "token")
    of_node = Window.partitionBy("node")
    unique = F.col("size") - F.count(F.lit(1)).over(of_node)
    place = unique + F.row_number().over(of_node.orderBy("n", "token")) - 1
    placed = some.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * up / F.lit(down)))
    entries = written(placed.select("token", "node", "size", "root", (F.col("size") - F.col("place")).alias("left")))
    roots = entries.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("most"), F.min("size").alias("small"))
    roots = roots.groupBy("token").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.max("most").alias("most"), F.min("small").alias("small"))
    roots = roots.filter("roots > 1").select("token", F.col("main.root").alias("main"), "most", "small")
    enough = lambda left, most, size, small: (up + down) * F.least(left, most) >= up * (F.col(size) + F.col(small))
    fit = entries.join(unsent(roots), "token").filter(enough("left", "most", "size", "small")).drop("most", "small")
    outside = fit.filter("root != main")
    reach = outside.groupBy("token").agg(F.max("left").alias("most"), F.min("size").alias("small"))
    inside = fit.join(unsent(reach), "token").filter((F.col("root") != F.col("main")) | enough("left", "most", "size", "small"))
    other = inside.select("token", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("root").alias("other_root"), F.col("left").alias("other_left"))
    once = (F.col("other_root") == F.col("main")) | (F.col("node") < F.col("other"))
    pairs = outside.join(unsent(other), "token").filter((F.col("root") != F.col("other_root")) & once & enough("left", "other_left", "size", "other_size"))
    return pairs.select("node", "size", "other", "other_size")


def links(close: DataFrame, shared: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """(a, b): links that give all components of the pairs that are in ``close`` or share a band and have a similarity of ``least``.

    ``close``: different pairs (a, b); ``shared``: a table of ``sharing``; ``sets``: node and set, of all nodes of
    both. Each pair is decided by the whole sets. First come the pairs given and those of each node with the pivots of
    its bands. Then, of bands whose nodes are not all of one component, the nodes of different components.
    """

    def verified(found: DataFrame) -> DataFrame:
        side = lambda n: sets.select(F.col("node").alias(n), F.col("set").alias(f"of_{n}"))
        return written(found.join(unsent(side("a")), "a").join(unsent(side("b")), "b").filter(alike(F.col("of_a"), F.col("of_b"), least)).select("a", "b"))

    first = verified(close.union(met(to_pivots(shared), least)).distinct())
    rooted = shared.join(unsent(components(first, "a", "b").withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left")
    held = written(rooted.select("node", "size", "key", F.coalesce("root", "node").alias("root")))
    parted = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    held = written(held.join(unsent(parted), "key").select("node", "size", "root").distinct())
    return first.union(verified(met(crossing(held, sets, least), least)))
