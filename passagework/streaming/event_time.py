"""Windows over event time: watermarks, late rows, and runs that go on from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .ingest import run_available

#: How late a row may be, and the pause that ends a session.
DELAY, PAUSE = "2 hours", "30 minutes"


def arriving(spark: SparkSession, parts: Sequence[DataFrame], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of a stream into which the parts arrive one after another.

    The query is stopped when it has taken a part, and started again from its checkpoint for the next one; watermark and
    open windows are kept there. A part's rows that are older than the watermark of the parts before are dropped.
    """
    incoming, out = scratch(spark, "arrivals"), scratch(spark, "windows")
    for part in parts:
        part.write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(parts[0].schema).parquet(incoming)
        made = run_available(work(stream), out)
    return made


def watermarked(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows with a time, by which they are late or not; rows without one belong to no window."""
    return events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _shown(counted: DataFrame, *by: str) -> DataFrame:
    times = [F.date_format(f"window.{end}", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f"window_{end}") for end in ("start", "end")]
    return counted.select(*times, *by, "n", "total")


def windows(events: DataFrame, by: str, length: str, step: str | None = None) -> DataFrame:
    """Counts and sums by window and ``by``; tumbling, or sliding by ``step``. A window appears once the watermark has passed its end."""
    window = F.window("ts", length, step).alias("window")
    return _shown(watermarked(events).groupBy(window, by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), by)


def sessions(events: DataFrame, by: str, pause: str = PAUSE) -> DataFrame:
    """A session goes on as long as no pause of that length comes."""
    window = F.session_window("ts", pause).alias("window")
    return _shown(watermarked(events).groupBy(window, by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), by)


def once(events: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    """Each key once, its repetitions being no further apart than the watermark; keys are forgotten after that, so state is bounded."""
    return watermarked(events, delay).dropDuplicatesWithinWatermark([key]).select(key)
