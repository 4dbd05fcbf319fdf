"""What leaves each stage of a job, counted while the job runs."""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("passagework.stages")


class Stages:
    """Rows and failures by stage, observed in passing: nothing is read twice and no job is added.

    A stage must run in exactly one action; its counts are there when that has ended. Seconds of actions go to the log, not to results.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._seen = spark, {}

    def watch(self, rows: DataFrame, stage: str, failed: Column | None = None) -> DataFrame:
        """``rows``, counted under the stage's name; ``failed`` marks those that failed in it (null: not failed)."""
        if stage in self._seen:
            raise ValueError(f"stage {stage} is watched already")
        self._seen[stage] = Observation(stage)
        failures = F.count(F.when(F.lit(False) if failed is None else failed, 1))
        return rows.observe(self._seen[stage], F.count(F.lit(1)).alias("n_rows"), failures.alias("n_failed"))

    def timed(self, name: str, action):
        """Runs ``action()`` and logs how long it took."""
        start = time.monotonic()
        try:
            return action()
        finally:
            log.info("%s: %.1f s", name, time.monotonic() - start)

    def counts(self) -> DataFrame:
        """pos, stage, n_rows, n_failed: a row for each stage, in the order they were watched."""
        rows = [(i, stage, seen.get["n_rows"], seen.get["n_failed"]) for i, (stage, seen) in enumerate(self._seen.items())]
        return self.spark.createDataFrame(rows, "pos long, stage string, n_rows long, n_failed long")
