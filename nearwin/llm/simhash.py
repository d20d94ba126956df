"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.llm import jaccard
from nearwin.llm.components import components
from nearwin.llm.shingles import BITS, hashes, majority, shingles  # noqa: F401
from nearwin.llm.words import Start
from nearwin.plans.shared import small_batches, unsent, written

#: A segment: its lowest bit and width.
Cut = tuple[int, int]


def simhash(text: bytes | None, words: int = 3) -> int:
    """64 bits, each 1 if it is set in over half the shingles' XXH64 (seed 42); 0 for a text without words."""
    return majority(hashes(text, words))


def fingerprint(text: Column, words: int = 3) -> Column:
    """The SimHash of a text column as a signed long."""

    start = Start()

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        start.once()
        return pa.array([simhash(t.as_py(), words) for t in texts], pa.int64())

    return of(text.cast("binary"))


def segments(distance: int) -> list[Cut]:
    """``distance`` // 2 + 1 segments of the 64 bits: of ``distance`` differing bits, one segment has one at most."""
    m = distance // 2 + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(prints: DataFrame, cuts: list[Cut]) -> DataFrame:
    """(fp, key, side): each segment as it is (side 2), and with each of its bits deleted (side: that bit).

    A key holds the segment's number, the deleted bit's and the rest of the segment. Two fingerprints whose segments are
    equal meet in the whole segment's key; two whose segments differ in one bit meet in that bit's key, from opposite
    sides. So a pair meets once a segment, however much it has in common.
    """
    found, before = [], 0
    for low, width in cuts:
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))
        each = prints.select("fp", value.alias("value"), F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("bit"))
        rest = "IF(bit < 0, value, value & ~shiftleft(1L, greatest(bit, 0)))"
        key = f"shiftleft(CAST({before} + bit + 1 AS BIGINT), {width}) | {rest}" if width < 56 else f"xxhash64({before} + bit + 1, {rest})"
        found.append(each.selectExpr("fp", f"{key} AS key", "IF(bit < 0, 2, CAST(shiftright(value, greatest(bit, 0)) & 1 AS INT)) AS side"))
        before += width + 1
    return reduce(DataFrame.union, found)


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): every pair of different fingerprints, of a table of distinct ones, at ``distance`` or fewer differing bits.

    The equality join on keys checks each pair in its condition, so only such pairs leave it; its sides hold about 34 rows a
    fingerprint and are never broadcast. A pair is found once for
    each segment that differs in one bit at most; repeats go.
    """
    found = variants(prints, segments(distance))
    left = found.filter("side != 1").select(F.col("fp").alias("x"), "key")
    right = found.filter("side != 0").select(F.col("fp").alias("y"), "key")
    close = (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance) & (F.col("x") != F.col("y"))
    return left.join(unsent(right), "key").filter(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of a written table (doc_id, fp, ...) with root, their component, and component_id, its smallest doc_id.

    ``nodes``: a written table of distinct fp with first_id, the smallest doc_id. Copies are one fingerprint, however
    many; links are between fingerprints, so no group is expanded into pairs.
    """
    roots = components(linked, "a", "b")
    of = written(nodes.join(unsent(roots), nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(unsent(of.join(unsent(least), "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of ``docs``.

    Null, empty and blank texts: fingerprint zero, linked like any other. Repeated rows keep a row each. A null id takes
    part, and is a component's id only if all ids of the component are null. Empty table: no rows. Other columns are not
    looked at.
    """
    prints = written(small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return classes(prints, nodes, links(nodes.select("fp"), distance)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(node, size, other, other_size): pairs of a written table (node, size, fp) that SimHashes at ``distance`` bits suggest.

    Nodes of one fingerprint are paired with its first; the first nodes of linked fingerprints with each other.
    """
    heads = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")))
    same = nodes.join(unsent(heads), "fp").select("node", "size", F.col("head.node").alias("other"), F.col("head.size").alias("other_size")).filter("node != other")
    side = lambda fp, head: heads.select(F.col("fp").alias(fp), F.col("head").alias(head))
    near = links(heads.select("fp"), distance).join(unsent(side("a", "one")), "a").join(unsent(side("b", "two")), "b")
    return same.unionByName(near.select("one.node", "one.size", F.col("two.node").alias("other"), F.col("two.size").alias("other_size")))


def one_of_each(docs: DataFrame, words: int = 5, least: tuple[int, int] = jaccard.LEAST, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (nulls last; of repeated ids, the least by all columns).

    Documents are linked if their sets of shingles of ``words`` words have a similarity (Jaccard) of ``least``, a
    fraction, or more; that is decided by the whole sets. Close copies are found by SimHashes of those shingles at
    ``distance`` bits, through deletion variants; the segments of one that would meet at a similarity of 0.8 also meet a
    share of all documents, so pairs farther apart are found by bands of minima. Texts without words are one component.
    Columns stay as they are. Only ids, hashes, bands and the sets of documents that share a band or a near SimHash are
    written; ``docs`` is read again for the sets and for the rows kept, known by id and hash of the text, of which a
    repeated row is one. Empty table: no rows.
    """
    place = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")]
    prints = written(small_batches(docs).select(*place, jaccard.sketch(F.col(text_col), words).alias("print")).select("doc_id", "hash", "print.*"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    nodes = written(prints.groupBy("node").agg(first.alias("kept"), *(F.min(c).alias(c) for c in ("size", "fp", "bands"))))
    shared = jaccard.sharing(nodes)
    close = written(jaccard.met(similar_pairs(nodes.select("node", "size", "fp"), distance), least))

    def read_again(wanted: DataFrame, how: str, *columns: Column) -> DataFrame:
        wanted = wanted.withColumns({"kept_id": F.col("kept.doc_id"), "kept_hash": F.col("kept.hash")}).drop("kept")
        return docs.select(*columns, *place).join(wanted, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), how)

    asked = shared.select("node").union(close.select("a")).union(close.select("b")).distinct()
    texts = read_again(nodes.select("node", "kept").join(unsent(asked), "node"), "inner", F.col(text_col).alias("__text"))
    sets = written(texts.dropDuplicates(["node"]).select("node", jaccard.whole_set(F.col("__text"), words).alias("set")))
    roots = components(jaccard.links(close, shared, sets, least), "a", "b").withColumnRenamed("node", "of")
    kept = nodes.join(unsent(roots), F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("kept").alias("kept"))
    rows = read_again(kept.select("kept"), "left_semi", F.struct(*docs.columns).alias("row"))
    if not prints.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("doc_id", "hash").agg(F.min("row").alias("row"))
    return rows.select("row.*")
