"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearwin.plans.ordering import MOST_BUCKETS, ROWS_PER_BUCKET, running_total
from nearwin.plans.shared import written

WEIGHTS, SHARE, MOST_TIMES, BLOCK = (3, 1, 2), 1.5, 2, 256
#: The golden ratio's fraction, and that of 2^20 times it.
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_20 = math.modf(GOLDEN * (1 << 20))[0]
SPACE = r"[\x20\x09-\x0D]"


def words_in(text: Column) -> Column:
    """Number of words: parts between white space, without the empty parts at either end."""
    some = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(some, SPACE + "+"))
    edge = lambda p: F.when(some.rlike(p), 1).otherwise(0)
    return F.when(some == "", 0).otherwise(parts - edge(f"^{SPACE}") - edge(f"{SPACE}\\z")).cast("long")


def point(slot: Column) -> Column:
    """The slot-th golden-ratio point in [0, 1); the slot number is cut in two so that no precision is lost."""
    high, low = F.floor(slot / F.lit(1 << 20)), slot % (1 << 20)
    return F.pmod(high * F.lit(GOLDEN_20) + low * F.lit(GOLDEN), F.lit(1.0))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, src, source_size, target) of a table (source, size), a row a source.

    src numbers the sources by code point, null last, and gives the weights in turn. A target is the weight's share of
    SHARE of all words, stopped at MOST_TIMES the source's size, with what is over shared by weight among the rest until
    none is above: so all sources that aren't stopped share one level of words per unit of weight, and the stopped ones
    are those whose room per unit of weight is under that level. Both are found from sums in the order of that room.
    """
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    rows = ranked.withColumns({"weight": weight, "room": F.col("size") * MOST_TIMES}).withColumn("ratio", F.col("room") / F.col("weight"))
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("room").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rows = rows.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every))
    target = F.least(F.col("room").cast("double"), F.col("level") * F.col("weight"))
    return rows.select("source", "src", F.col("size").alias("source_size"), F.coalesce(target, F.lit(0.0)).alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, rank, slot) of every slot of the mix, for a written table of targets.

    Slot i draws the source whose interval of cumulative targets holds the i-th golden-ratio point, and is the rank-th
    slot of that source. A source ends at the rank that fills its target; the few that the points leave short of it,
    by the sequence's discrepancy, get their last slots at the end.
    """
    spark = sources.sparkSession
    rows = sources.orderBy("src").collect()  # a row a source
    total = sum(r["target"] for r in rows)
    if not total:
        return spark.createDataFrame([], "src int, rank long, slot long")
    ends, at = [], 0.0
    for r in rows:
        at += r["target"] / total
        ends.append(at)
    needs = [slots_of(r["target"], r["source_size"], block) for r in rows]
    n = sum(needs)
    bounds = F.from_json(F.lit(json.dumps(ends[:-1])), "array<double>")
    drawn = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / F.lit(4096)).alias("part"), F.size(F.filter(bounds, lambda x: x <= point(F.col("id")))).alias("src"))
    ranked = running_total(drawn, ["src"], "part", [F.col("slot")], {}, "rank").select("src", "rank", "slot")
    need = F.get(F.from_json(F.lit(json.dumps(needs)), "array<bigint>"), F.col("src"))
    have = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    short = sources.join(have, "src", "left").select("src", F.coalesce("have", F.lit(0)).alias("have"), need.alias("need")).filter("have < need")
    last = short.select("src", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"), F.lit(n).cast("long").alias("slot"))
    return ranked.filter(F.col("rank") < need).union(last)


def slots_of(target: float, size: int, block: int) -> int:
    """Slots until ``target`` words: the last block of each pass over a source may be short."""
    words, passes = math.floor(target + 0.5), 0
    if size and words > size:
        passes, words = divmod(words, size)
    return passes * -(-size // block) + -(-words // block)


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (a written table with doc_id, source, size, crc) with src, source_size, target and word_start.

    A source's documents are shuffled by the md5 of their ids, the same in every run; word_start is the sum of the sizes
    before a document in its source. Large sources are cut into slices of that hash, so none is one task's work.
    """
    n = rows.count()
    slices = max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    known = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    mixed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    known = known.withColumn("mixed", mixed).withColumn("slice", F.floor(F.conv(F.substring("mixed", 1, 6), 16, 10).cast("long") * slices / F.lit(1 << 24)).cast("int"))
    return running_total(known, ["src"], "slice", [F.col("mixed"), F.col("doc_id"), F.col("crc")], {"word_start": "size"}).drop("mixed", "slice")


def takes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A written table (doc_id, source, size, crc, ...) with src, source_size, target, word_start, taken, first_slot and passes.

    Each source's shuffled words are cut into blocks of ``block`` words; a slot takes the block of its rank, and starts
    the source again after its last. Documents are joined to slots by the pieces that they have in each block: passes
    has, for each pass over the source, the first slot that takes words of the document and how many are taken.
    """
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("size"))))
    at = written(placed(rows, sources))
    first, last = F.floor(F.col("word_start") / F.lit(block)), F.floor((F.col("word_start") + F.col("size") - 1) / F.lit(block))
    sized = at.filter("size > 0")
    pieces = sized.select("src", "word_start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("word_start"), F.col("block") * block)
    pieces = pieces.select("src", "word_start", "block", low.alias("low"), F.least(F.col("word_start") + F.col("size"), (F.col("block") + 1) * block).alias("high"))
    slots = schedule(sources, block).join(sources.select("src", "source_size", "target"), "src")
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    slots = slots.withColumn("turn", F.floor(F.col("rank") / blocks))
    slots = slots.select("src", "slot", "turn", F.pmod("rank", blocks).alias("block"), (F.floor(F.col("target") + 0.5) - F.col("turn") * F.col("source_size")).alias("end"))
    got = pieces.join(slots, ["src", "block"]).select("src", "word_start", "slot", "turn", F.greatest(F.least("high", "end") - F.col("low"), F.lit(0)).cast("long").alias("got")).filter("got > 0")
    turns = range(MOST_TIMES + 1)  # a target over twice the source by rounding alone begins one pass more
    got = got.groupBy("src", "word_start").agg(*(f(F.when(F.col("turn") == k, F.col(c))).alias(f"{c}_{k}") for k in turns for c, f in (("slot", F.min), ("got", F.sum))))
    passes = F.filter(F.array(*(F.struct(F.col(f"slot_{k}").alias("slot"), F.col(f"got_{k}").alias("got")) for k in turns)), lambda p: p["got"] > 0)
    some = sized.join(got.select("src", "word_start", passes.alias("passes")), ["src", "word_start"], "left")
    rest = F.array().cast("array<struct<slot: bigint, got: bigint>>")
    every = some.withColumn("passes", F.coalesce("passes", rest)).unionByName(at.filter("size = 0").withColumn("passes", rest))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["got"])
    return every.withColumns({"taken": taken, "first_slot": F.array_min(F.transform("passes", lambda p: p["slot"]))})


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"), *more)


def mix(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (null: not taken) of every row of ``docs``.

    Every source's taken words are its rounded target. Null and empty texts: size 0, nothing taken. Null sources are one
    source, the last. Equal ids of a source are ordered by the crc32 of the text; repeated rows keep a row each. All
    sizes 0: targets 0. Empty table: no rows. Other columns are not looked at.
    """
    return takes(written(measured(docs, id_col, text_col, source_col)), block).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixture(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows with the columns of ``docs``, in the schedule's order: a document once for each pass that takes it.

    A document stands at the first slot that takes words of it. Partitions hold ranges of slots, equal in number, so
    every stretch of the mix is near the target weights. A text that a pass takes in part, at most one a source, is cut
    after its last word taken. Texts without words, null and empty ones among them, are in no mix. An n_chars column follows
    the text. Columns may have any names. Repeated rows count each. Empty table: no rows.
    """
    spark = docs.sparkSession
    held = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    given = lambda c: F.col("row").getField(c)
    slim = held.select(given(id_col).alias("id"), given(text_col).alias("text"), given(source_col).alias("source"), "at")
    rows = written(measured(slim, "id", "text", "source", F.col("at")))
    took = written(takes(rows, block).select(F.col("at").alias("took_at"), "size", "word_start", F.explode("passes").alias("pass")).select("took_at", "size", "word_start", "pass.*"))
    slots = (took.agg(F.max("slot")).first()[0] or 0) + 1
    each = held.join(took, held.at == took.took_at)
    text = given(text_col)
    cut = F.array_join(F.slice(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), F.lit(1), F.col("got").cast("int")), " ")
    each = each.select("row", "slot", "word_start", F.when(F.col("got") < F.col("size"), cut).otherwise(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = each.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(slots)).cast("int")).sortWithinPartitions("slot", "word_start")
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return each.select(*(new.get(c, given(c)).alias(c) for c in docs.columns))
