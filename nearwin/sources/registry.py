"""Tables and streams by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearwin.sources.arff import read_arff
from nearwin.sources.evallog import read_log
from nearwin.sources.generators import generate


def open_source(spark: SparkSession, name: str, path: str | None = None, **options: int) -> DataFrame:
    """``parquet``, ``csv``, ``json``, ``arff`` or ``log`` at a path; ``random_tree`` or ``radial`` by options."""
    readers = {
        "parquet": lambda: spark.read.parquet(path),
        "csv": lambda: spark.read.csv(path, header=True, inferSchema=True),
        "json": lambda: spark.read.json(path),
        "arff": lambda: read_arff(spark, path),
        "log": lambda: read_log(spark, path),
        "random_tree": lambda: generate(spark, "random_tree", **options),
        "radial": lambda: generate(spark, "radial", **options),
    }
    if name not in readers:
        raise ValueError(f"no source is named {name}: {', '.join(readers)}")
    return readers[name]()
