"""Micro-batch ingestion: the batch transforms over new files, each row once, over restarts too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import fixed
from ..sources.tables import scratch, stored, table


def run_available(stream: DataFrame, out: str) -> DataFrame:
    """Runs a stream over what is there, exactly once by its checkpoint, and reads the result."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Calls ``work(rows, batch)`` for each micro-batch of what is there that the checkpoint doesn't know as done.

    A batch that was cut off comes again with the same rows and number, so ``work`` must overwrite what it wrote for
    that number before (``write_batch``); then every row counts once, however often the stream is stopped and started.
    """
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_batch(rows: DataFrame, path: str, batch: int, *by: str) -> None:
    """One batch's rows in a folder of their own, in place of what an earlier try has left there."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def before(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What batches before this one have written; a repeated batch sees what its first try saw."""
    return stored(spark, path, f"{schema}, batch int").where(F.col("batch") < batch)


def _source(spark: SparkSession, sf_dir: str, files_per_batch: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    folder = scratch(spark, "incoming")
    docs.write.option("maxRecordsPerFile", 100_000).json(folder)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of JSON files that arrive: the same rows as in batch."""
    stream = fixed(_source(spark, sf_dir, 2)).select("doc_id", "idx")
    return run_available(stream, scratch(spark, "chunks"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id once, although each file's rows arrive twice. Ids are held against the stored ones: no state grows in memory."""
    rows = _source(spark, sf_dir, 2).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    out = scratch(spark, "once")

    def work(batch: DataFrame, number: int) -> None:
        known = before(spark, out, "doc_id long", number)
        write_batch(batch.select("doc_id").distinct().join(known, "doc_id", "left_anti"), out, number)

    run_batches(rows, f"{out}-state", work)
    return stored(spark, out, "doc_id long, batch int").select("doc_id")
