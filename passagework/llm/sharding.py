"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash into buckets of bounded size. Pass two
shuffles each bucket by Fisher-Yates (Spark's seeded ``shuffle``, over the places of the bucket's rows, 4 bytes
each, so that a bucket's memory doesn't depend on what its rows hold) and writes it in that order. The buckets laid
end to end are cut into shards whose row counts differ by one at most (law ``rows``).

Main path: DataFrame functions only. Everything follows from the seed and the rows' contents: the hash
covers the whole row, a bucket's rows are numbered in the order of their hashes, and the permutations are drawn with
the buckets at fixed places. So another layout of the input, or a task that is run again, gives the
same order. A row that comes more than ``HOT`` times, as two hashes of the whole row say, is kept once on its way and its copies are dealt evenly over
all buckets, so that no bucket and no task gets them all.

Defined results. Null text: no bytes, so size 8 and checksum 0. Null ids: told apart by the rest of the
row. Very long texts: moved once, sorted with spilling. Repeated rows stay as often as they come. Ties: equal rows are
interchangeable. Empty table: no rows. Extra columns, whatever their names, are carried inside one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, row_hash, row_struct, running, staged

SHARDS = 24
#: Rows that a bucket is meant to hold, and copies of one row beyond which they are dealt by number.
BUCKET_ROWS = 16_384
HOT = 1_024


def _dealt(counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(h, bucket, m): how many of the rows of hash h go to a bucket. Rows that aren't hot go to one bucket all."""
    first = F.xxhash64(F.lit(seed), "h")
    spread = F.when(F.expr(f"n > {HOT} and same"), F.least("n", F.lit(buckets).cast("long"))).otherwise(F.lit(1).cast("long"))
    many = F.expr("n div parts + if(i < n % parts, 1, 0)")
    return counts.select("h", "n", spread.alias("parts")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i")
    ).select("h", F.pmod(F.pmod(first, F.lit(buckets)) + F.col("i"), F.lit(buckets)).alias("bucket"), many.alias("m"))


def external_shuffle(df: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """(shard, bucket, slot, row): every row of ``df`` as a struct, at its place; a bucket's rows are in one task."""
    both = df.select(row_hash(df).alias("h"), row_hash(df, F.lit(1)).alias("g")).groupBy("h")
    counts = staged(both.agg(F.count(F.lit(1)).alias("n"), (F.min("g") == F.max("g")).alias("same")), "hashes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_ROWS))
    dealt = _dealt(counts, buckets, seed)
    sizes = running(dealt.groupBy("bucket").agg(F.sum("m").alias("size")), [F.col("bucket")], base=F.col("size"))
    # The partitions' number and their rows' order are fixed, and with them the numbers that are drawn.
    fixed = sizes.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    order = F.shuffle(F.sequence(F.lit(0), F.col("size").cast("int") - 1), seed)
    orders = staged(fixed.select("bucket", "base", order.alias("order")), "orders")
    rows, hot = df.select(row_struct(df).alias("row"), row_hash(df).alias("h")), staged(counts.where(f"n > {HOT} and same"), "hot")
    place = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(buckets)).alias("bucket")
    if hot.isEmpty():
        scattered = rows.select("h", place, "row")
    else:
        once = rows.join(hot, "h", "left_semi").dropDuplicates(["h"])
        copies = once.join(_dealt(hot, buckets, seed), "h").select("h", "bucket", "row", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
        scattered = rows.join(hot, "h", "left_anti").select("h", place, "row").union(copies.select("h", "bucket", "row"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("h")) - 1
    ranked = scattered.repartition(buckets, "bucket").select("bucket", nth.alias("nth"), "row")
    at = F.col("base") + F.get("order", F.col("nth"))
    n = F.lit(max(1, total)).cast("long")
    return (
        ranked.join(orders, "bucket").select("bucket", at.alias("at"), "row")
        .select(F.expr(f"cast((at * {shards}) div {max(1, total)} as int) as shard"), "bucket", "at", "row")
        .select("shard", "bucket", (F.col("at") - F.floor((F.col("shard") * n + (shards - 1)) / shards)).alias("slot"), "row")
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = 42) -> None:
    """Whole rows as Parquet: a folder for each shard, in it one for each bucket, with its rows by slot.

    The folders of a shard, by the number of their buckets, are one run in the order of the slots.
    """
    out = external_shuffle(df, shards, seed).sortWithinPartitions("shard", "bucket", "slot")
    out.write.partitionBy("shard", "bucket").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """(shard, bucket, slot, row) of what ``write_shards`` has written, ``schema`` being that of the rows."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    fields = [StructField("slot", LongType()), StructField("row", schema), StructField("shard", IntegerType()), StructField("bucket", LongType())]
    return spark.read.schema(StructType(fields)).parquet(path)


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard of the rows, read from written shards."""
    path, body = new_folder(docs.sparkSession, "shards"), F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    write_shards(docs, path, shards, seed)
    return read_shards(docs.sparkSession, path, docs.schema).select(
        F.col(f"row.`{doc_id}`").alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
