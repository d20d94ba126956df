"""ARFF files as a Spark data source, and as plain schema reading."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def header(lines: Iterator[str]) -> list[tuple[str, str]]:
    """(name, type) of each attribute, up to the data."""
    out = []
    for line in lines:
        text = line.strip()
        low = text.lower()
        if low.startswith("@data"):
            break
        if low.startswith("@attribute"):
            rest = text[len("@attribute") :].strip()
            if rest[:1] in "'\"":
                end = rest.index(rest[0], 1)
                name, kind = rest[1:end], rest[end + 1 :].strip()
            else:
                name, kind = rest.split(None, 1)
            out.append((name, kind))
    return out


def schema_of(attributes: list[tuple[str, str]]) -> StructType:
    numeric = ("numeric", "real", "integer")
    return StructType([StructField(n, DoubleType() if k.lower().startswith(numeric) else StringType()) for n, k in attributes])


def row_of(line: str, schema: StructType) -> tuple | None:
    """Values of a data line, dense or sparse ({place value, ...}; absent numbers are 0); None for blanks and comments."""
    text = line.strip()
    if not text or text.startswith("%"):
        return None
    kinds = [f.dataType for f in schema.fields]
    cast = lambda v, k: None if v in ("?", "") else float(v) if isinstance(k, DoubleType) else v
    if text.startswith("{"):
        given = dict(p.strip().split(None, 1) for p in text.strip("{}").split(",") if p.strip())
        return tuple(cast(given[str(i)], k) if str(i) in given else (0.0 if isinstance(k, DoubleType) else None) for i, k in enumerate(kinds))
    values = next(csv.reader(io.StringIO(text), quotechar="'", skipinitialspace=True))
    return tuple(cast(v.strip(), k) for v, k in zip(values, kinds, strict=True))


class ArffReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.schema, self.path = schema, path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, encoding="utf-8") as lines:
            header(lines)
            yield from filter(None, (row_of(line, self.schema) for line in lines))


class ArffSource(DataSource):
    """``spark.read.format("arff").load(path)`` of one file that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self) -> StructType:
        with open(self.options["path"], encoding="utf-8") as lines:
            return schema_of(header(lines))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArffReader(schema, self.options["path"])


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArffSource)
    return spark.read.format("arff").load(path)
