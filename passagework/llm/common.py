"""Helpers that every training-data operator shares: staging, running sums and text basics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: One run of the blanks that separate words, as a Java regex.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Everything that is not part of a word, negated: one word.
WORD = "[^\\x20\\x09-\\x0D]+"

#: The lists of folders that the calls under way in this thread collect, innermost last.
_collected: ContextVar[tuple[list[str], ...]] = ContextVar("collected", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a local session (tests, a single machine) gets a temporary
    folder; a cluster, whose executors would write to disks of their own, an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="passagework-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder; removed by ``remove``, or else when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = _file_system(spark, path)
    fs.deleteOnExit(hadoop)
    for made in _collected.get():
        made.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The folders that are made inside, in this thread and by this call alone."""
    made: list[str] = []
    token = _collected.set((*_collected.get(), made))
    try:
        yield made
    finally:
        _collected.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders whose rows nobody reads any more."""
    for path in paths:
        fs, hadoop = _file_system(spark, path)
        fs.delete(hadoop, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and
    several consumers share one evaluation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_struct(df: DataFrame) -> Column:
    """The whole row as one column, so that no name of its own can clash."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def row_hash(df: DataFrame, *first: Column) -> Column:
    """A 64-bit hash of ``first`` and all columns, each with whether it is null, since Spark's hash passes nulls over.

    Nested columns, which may hold nulls anywhere, and maps, which Spark doesn't hash, count by their JSON, nulls included.
    """

    def of(f) -> list[Column]:
        c = F.col(f"`{f.name}`")
        nested = any(k in f.dataType.simpleString() for k in ("map<", "array<", "struct<"))
        return [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else c, c.isNull()]

    return F.xxhash64(*first, *(c for f in df.schema.fields for c in of(f)))


def running(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with the sum of each expression over all rows before, in the total order ``order``.

    Rows are range-partitioned and summed inside their range; only one row for each
    partition is ever ordered in a single task.
    """
    ranged = staged(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = ranged.groupBy("_range").agg(*(F.sum(e).alias(f"_{n}") for n, e in sums.items()))
    bases = per.select("_range", *(zero(F.sum(f"_{n}").over(before)).alias(f"_{n}") for n in sums))
    local = ranged.select("*", *(zero(F.sum(e).over(inside)).alias(n) for n, e in sums.items()))
    return local.join(bases, "_range").select(
        *(F.col(f"`{c}`") for c in df.columns), *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums)
    )


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_count(text: Column) -> Column:
    """Number of words as a long, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
