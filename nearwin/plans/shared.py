"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; where that is unset, under a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearwin-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/nearwin-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, in a session that sends Python workers batches of ``most`` bytes at most, so that long texts take no more memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(conf.get(key)).rstrip("b")
    if not given.isdigit() or int(given) > most:
        conf.set(key, f"{most}b")
    return df


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equality join of which neither side is broadcast.

    Spark estimates an exploded table as if each row made one row, and a written one by its compressed files; a side that
    it takes to be small so can be larger than the driver's memory, where a broadcast is built.
    """
    return df.hint("merge")


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: evaluated once, safe against lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
