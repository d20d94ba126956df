"""A sink for the progress of live runs: rows of speed and state for each micro-batch, as a table, or as lines of a log."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

KINDS = {"int": "long", "float": "double", "str": "string"}


@dataclass(frozen=True)
class Step:
    """One micro-batch: rows answered and learned, seconds and speed of the whole run so far and of the batch, and the model."""

    run: str
    batch: int
    evaluation_instances: int
    total_train_time: float
    total_train_speed: float
    last_train_time: float
    last_train_speed: float
    model_instances: int
    model_bytes: int


SCHEMA = ", ".join(f"{f.name} {KINDS[f.type]}" for f in fields(Step))


class Progress(StreamingQueryListener):
    """Keeps a ``Step`` for each progress event that took rows in; test and train are one pass, so their times are one too.

    The model is what the run's state stores hold: keys with a window, and bytes of memory.
    """

    def __init__(self) -> None:
        self.steps: list[Step] = []

    def took(self, told: dict) -> None:
        """The progress as the dictionary of its JSON form."""
        rows, seconds = int(told.get("numInputRows", 0)), told.get("durationMs", {}).get("triggerExecution", 0) / 1000
        if not rows:
            return
        before = [s for s in self.steps if s.run == told["runId"]]
        all_rows, all_seconds = rows + (before[-1].evaluation_instances if before else 0), seconds + (before[-1].total_train_time if before else 0.0)
        speed = lambda n, t: n / t if t else 0.0
        stores = told.get("stateOperators", [])
        self.steps.append(Step(
            told["runId"], int(told["batchId"]), all_rows, all_seconds, speed(all_rows, all_seconds), seconds, speed(rows, seconds),
            sum(int(s["numRowsTotal"]) for s in stores), sum(int(s["memoryUsedBytes"]) for s in stores),
        ))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.took(json.loads(event.progress.json))

    def onQueryStarted(self, event) -> None: ...  # noqa: N802

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802

    def lines(self) -> Iterator[str]:
        """The log: a header, then a line of comma-separated values for each step."""
        yield ",".join(f.name for f in fields(Step))
        for s in self.steps:
            yield ",".join(map(str, astuple(s)))


@contextmanager
def listening(spark: SparkSession) -> Iterator[Progress]:
    """A listener for the time of a run; at the end all its events have come in."""
    log = Progress()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(log)


def report(spark: SparkSession, log: Progress, scores: DataFrame) -> DataFrame:
    """(run, batch, ..., classified_instances, accuracy_pct): the steps beside the run's scores (n, accuracy_pct)."""
    steps = spark.createDataFrame([astuple(s) for s in log.steps], SCHEMA)  # a row a micro-batch
    return steps.join(F.broadcast(scores.withColumnRenamed("n", "classified_instances")))
