"""Seeded synthetic streams as batch data sources: a random decision tree's labels, and radial clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

CHUNK = 10_000


class Rows(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class GeneratorReader(DataSourceReader):
    """Rows in chunks, each drawn from a seed of its own, so any split into tasks gives the same rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.get = lambda k, d: int(options.get(k.lower(), options.get(k, d)))
        self.rows, self.seed, self.tasks = self.get("rows", 10_000), self.get("seed", 1), self.get("partitions", 8)

    def partitions(self) -> list[InputPartition]:
        chunks = -(-self.rows // CHUNK)
        per = max(1, -(-chunks // self.tasks))
        return [Rows(a, min(chunks, a + per)) for a in range(0, chunks, per)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for chunk in range(partition.begin, partition.end):
            n = min(CHUNK, self.rows - chunk * CHUNK)
            yield from self.draw(np.random.default_rng([self.seed, 1, chunk]), chunk * CHUNK, n)


class RandomTreeReader(GeneratorReader):
    """A full random tree over numeric and five-valued nominal attributes gives each row's class."""

    def draw(self, rng, first, n):
        numeric, nominal, classes, depth = self.get("numerics", 5), self.get("nominals", 5), self.get("classes", 2), self.get("depth", 5)
        tree = np.random.default_rng([self.seed, 0])
        test, cut, leaf = tree.integers(0, numeric + nominal, 2**depth), tree.uniform(0, 1, 2**depth), tree.integers(0, classes, 2 ** (depth + 1))
        x = np.concatenate([rng.uniform(0, 1, (n, numeric)), rng.integers(0, 5, (n, nominal)) / 5 + 0.1], axis=1)
        node = np.ones(n, int)
        for _ in range(depth):
            node = node * 2 + (x[np.arange(n), test[node]] > cut[node])
        for i in range(n):
            yield (first + i, *map(float, x[i, :numeric]), *(f"v{int(v * 5)}" for v in x[i, numeric:]), f"class{leaf[node[i]]}")


class RadialReader(GeneratorReader):
    """Clusters of random centre, weight, spread and class; a row is a centre plus a step in a random direction."""

    def draw(self, rng, first, n):
        numeric, classes, centres = self.get("numerics", 10), self.get("classes", 2), self.get("centres", 50)
        base = np.random.default_rng([self.seed, 0])
        c, label, wide, weight = base.uniform(0, 1, (centres, numeric)), base.integers(0, classes, centres), base.uniform(0, 1, centres), base.uniform(0, 1, centres)
        pick, way = rng.choice(centres, n, p=weight / weight.sum()), rng.normal(size=(n, numeric))
        x = c[pick] + way / np.linalg.norm(way, axis=1, keepdims=True) * (rng.normal(size=n) * wide[pick])[:, None]
        for i in range(n):
            yield (first + i, *map(float, x[i]), f"class{label[pick[i]]}")


class RandomTreeSource(DataSource):
    reader_class, nominal_default, numeric_default = RandomTreeReader, 5, 5

    @classmethod
    def name(cls) -> str:
        return "random_tree"

    def schema(self) -> StructType:
        get = lambda k, d: int(self.options.get(k, d))
        return StructType([StructField("id", LongType()), *(StructField(f"x{i}", DoubleType()) for i in range(get("numerics", self.numeric_default))), *(StructField(f"n{i}", StringType()) for i in range(get("nominals", self.nominal_default))), StructField("label", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_class(dict(self.options))


class RadialSource(RandomTreeSource):
    reader_class, nominal_default, numeric_default = RadialReader, 0, 10

    @classmethod
    def name(cls) -> str:
        return "radial"


def generate(spark: SparkSession, name: str, **options: int) -> DataFrame:
    for source in (RandomTreeSource, RadialSource):
        spark.dataSource.register(source)
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()
