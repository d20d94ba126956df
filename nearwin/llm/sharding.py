"""Contiguous shards of near-equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwin.plans.ordering import LOWEST, bucket_of, order_key, quantile_bounds, running_total
from nearwin.plans.shared import written

SHARDS = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; a null text counts as none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's place in ``shards`` contiguous shards of near-equal byte size.

    Rows are ordered by id (null first; equal ids by crc32 of the text, then size). Each quantile bucket of ids gives
    its byte and row totals, their running sums are the buckets' offsets, and a row whose middle byte lies in the i-th
    of ``shards`` equal parts of all bytes goes to shard i. So a shard's size is off by at most one document at each
    end. Texts stay where they are: only ids, sizes and checksums are shuffled, and they are written once, to be read
    for the totals and for the cut.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the shard, gapless from 0), grown_shard
    (null), byte_start. Null text: size 1, crc32 of no bytes, 0. Repeated rows and copies keep a row each. Empty table:
    no rows. One document larger than a shard's share leaves some shards empty. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    bounds = quantile_bounds(docs, order_key(id_col))
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    rows = written(rows.withColumn("bucket", bucket_of(key, bounds)))
    placed = running_total(rows, [], "bucket", [key, F.col("text_crc32"), F.col("size")], {"byte_start": "size"}, "position")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    shard = F.floor((F.col("byte_start").cast("decimal(38,0)") * 2 + F.col("size")) * shards / F.lit(2 * total).cast("decimal(38,0)"))
    placed = written(placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int")).drop("bucket"))
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("position")).collect()}  # at most one row a shard
    starts = spark.createDataFrame([(k, v) for k, v in first.items()], "shard int, first long")
    cut = placed.join(F.broadcast(starts), "shard")
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "byte_start")
