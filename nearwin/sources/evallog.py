"""Evaluation logs: sections of a header and lines of thirteen numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearwin.operators.primitives import trimmed_median

#: Column names of an evaluation line, in order.
COLUMNS = ("evaluation_instances", "total_train_time", "total_train_speed", "last_train_time", "last_train_speed", "test_time", "test_speed", "classified_instances", "correct_pct", "kappa_pct", "kappa_temporal_pct", "model_instances", "model_bytes")
NUMBERS = r"^\s*[-+0-9.eE]+(,[-+0-9.eE?NaN]+){12}\s*$"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, at) of each line; a log is a small file that one task reads, so line order is row order there."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    return lines.select("file", "text", "at")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row an evaluation line: file, section, window, k, classifier, then the thirteen numbers as doubles.

    A section starts at each line that names a classifier; window and k come from the last ``Test`` line before it.
    """
    lines = lines_of(spark, path)
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda pattern, group=1: F.last(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, group)), ignorenulls=True).over(so_far)
    marked = lines.select("file", "at", "text", F.sum(F.when(F.col("text").rlike(r"^-+Classifier:"), 1).otherwise(0)).over(so_far).alias("section"), last(r"window\s*=\s*(\d+)").cast("int").alias("window"), last(r"\bk\s*=\s*(\d+)").cast("int").alias("k"), last(r"^-+Classifier:\s*(\S+)").alias("classifier"))
    found = marked.filter(F.col("text").rlike(NUMBERS)).withColumn("n", F.split(F.trim("text"), ","))
    return found.select("file", "section", "window", "k", "classifier", *(F.expr(f"try_cast(n[{i}] AS double)").alias(c) for i, c in enumerate(COLUMNS)))


def summary(log: DataFrame) -> DataFrame:
    """(window, section, classifier, train, test): medians of training and test speed without one least and one greatest."""
    keyed = log.withColumn("__key", F.struct("file", "window", "section", "classifier"))
    train = trimmed_median(keyed, "__key", "last_train_speed").withColumnRenamed("trimmed_median", "train")
    test = trimmed_median(keyed, "__key", "test_speed").withColumnRenamed("trimmed_median", "test")
    return train.join(test, "__key").select("__key.window", "__key.section", "__key.classifier", "train", "test")
