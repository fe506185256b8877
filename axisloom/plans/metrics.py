"""What the steps of a run did, as a table: rows and bases that went by, and seconds.

Rows and bases are observed while a step's result is written, by Spark's own accumulators of the tasks
that count, so watching a table costs no job of its own.
"""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step string, metric string, value double"


class Metrics:
    """Watch tables with watch() before an action runs on them, and stretches of code with timed()."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []
        self._seconds: dict[str, float] = {}

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        """df, whose rows (and bases, of intervals) are counted by the first action on it."""
        numbers = [F.count(F.lit(1)).alias("rows")]
        if {"start", "end"} <= set(df.columns):
            numbers.append(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0).cast("long")).alias("bases"))
        observation = Observation()
        self._seen.append((step, observation))
        return df.observe(observation, *numbers)

    @contextmanager
    def timed(self, step: str):
        """Seconds of the driver's clock; those of a step entered again are added."""
        since = time.monotonic()
        try:
            yield
        finally:
            self._seconds[step] = self._seconds.get(step, 0.0) + time.monotonic() - since

    def table(self, spark: SparkSession) -> DataFrame:
        """step, metric, value: a few rows for each step. Waits for an action on every watched table."""
        rows = [(step, name, float(value)) for step, seen in self._seen for name, value in seen.get.items()]
        rows += [(step, "seconds", s) for step, s in self._seconds.items()]
        return spark.createDataFrame(rows, SCHEMA)
