"""Mixing sources to target weights by pivotal dependent rounding.

Each document should appear target / source size times on average. The whole part is
given; the fraction is rounded by the pivotal method: two documents of a source are
paired, and words are moved between their fractions, at random but without bias, until
one is zero or one. Pairing conserves the source's expected words exactly, so that only
the last unpaired fraction of each source can miss its target, by less than one document. Large
documents come first, so that this last one is small.

Equal rows are one item with a count: all but a fraction of their copies is certain. Items
are dealt to buckets by id and content, so that a hot source or a missing id is spread over all of
them. A bucket leaves at most one fraction per source; these residuals are paired again
up a reduction tree.

Random numbers come from the seed, round and bucket, and a bucket is sorted before use, so
reruns agree for any layout of the input.

Defined results. Null or empty text: size 0, taken 0. Null source: a source of its own, last in
order. Null ids: told apart by a hash of the row. Very long texts: counted in the scan. Repeated
rows and ties: rows that are equal in all columns are interchangeable; ``mixture`` gives the first of
them one copy more than the others where their copies don't divide. Empty table: no rows. Extra columns
are carried inside one struct by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, row_hash, row_struct, running, staged, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 4096
FAN_IN = 32
#: Parts into which the rows of one source are dealt where they meet its target.
SALTS = 16

SCHEMA = "doc_id long, source string, size long, content long, n long, source_size long, target double, sure long, part double, salt long"


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, size), by water filling.

    A target is level x weight, or ``most`` times the source's size if that is less; the level is the
    one at which the targets add up. Sources are ordered by code point, null last.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    ready = running(named, by_name, place=F.lit(1)).select("source", "source_size", weight.alias("weight")).select(
        "*", (F.col("source_size") * most).alias("cap"), (F.col("source_size") * most / F.col("weight")).alias("full_at")
    )
    upto = staged(running(ready, [F.col("full_at"), *by_name], caps=F.col("cap"), weights=F.col("weight")), "levels")
    all_sizes, all_weights = upto.agg(F.sum("source_size"), F.sum("weight")).first()
    # The level if all sources that fill up before this one are full and this one isn't; it rises up to
    # the first source that isn't full, then falls.
    level = (F.lit(float(all_sizes or 0) * share) - F.col("caps")) / (F.lit(all_weights or 0.0) - F.col("weights"))
    highest = upto.agg(F.max(level)).first()[0] or 0.0
    return upto.select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("cap", F.col("weight") * highest)).alias("target"),
    )


def pivot(pa_: float, sa: float, pb: float, sb: float, u: float) -> tuple[float, float]:
    """One step: moves words between two fractions, so that one becomes 0 or 1; unbiased if u is uniform."""
    up = min((1 - pa_) * sa, pb * sb)  # words that a can take from b
    down = min(pa_ * sa, (1 - pb) * sb)
    if u * (up + down) < down:
        return (1.0, max(0.0, pb - up / sb)) if (1 - pa_) * sa <= pb * sb else (min(1.0, pa_ + up / sa), 0.0)
    return (0.0, min(1.0, pb + down / sb)) if pa_ * sa <= (1 - pb) * sb else (max(0.0, pa_ - down / sa), 1.0)


def _round(seed: int, level: int, last: bool):
    """Rows arrive sorted by bucket; gives them back with part 0, 1 or, once per source and bucket, between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        bucket = random = None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            names, sizes, parts, salts = cols["source"], cols["size"], cols["part"], cols["salt"]
            keep: list[int] = []
            out: list[list] = []

            def leave(rows=out) -> None:
                for row in held.values():
                    if last:
                        row[8] = float(random.random() < row[8])
                    rows.append(row)
                held.clear()

            for i in range(batch.num_rows):
                if salts[i] != bucket:
                    leave()
                    bucket = salts[i]
                    random = np.random.default_rng([seed, level, bucket & 0xFFFFFFFFFFFFFFFF])
                p = parts[i]
                if p <= 0.0 or p >= 1.0:
                    keep.append(i)
                    continue
                row = [cols[n][i] for n in cols]
                other = held.pop(names[i], None)
                if other is None:
                    held[names[i]] = row
                    continue
                other[8], row[8] = pivot(other[8], other[2], p, sizes[i], random.random())
                for r in (other, row):
                    if 0.0 < r[8] < 1.0 and names[i] not in held:
                        held[names[i]] = r
                    else:
                        out.append(r)
            yield batch.take(pa.array(keep, pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), batch.schema.types, strict=True)], names=batch.schema.names)
            schema = batch.schema
        if held:
            rest = []
            for row in held.values():
                if last:
                    row[8] = float(random.random() < row[8])
                rest.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest, strict=True), schema.types, strict=True)], names=schema.names)

    return run


def copies(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """From (doc_id, source, size, content): one row for all equal ones, with their number ``n``, source_size, target and ``copies`` in all."""
    keys = ["doc_id", "source", "size", "content"]
    items = staged(sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    named = staged(targets(items.select("source", (F.col("size") * F.col("n")).alias("size"))), "targets")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    right = named.select(F.struct("source").alias("_source"), "source_size", "target", each)
    share = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Each row's fraction apart, n rows have n times the whole part and the whole part of n fractions for certain.
    rows = (
        items.withColumns({"_source": F.struct("source"), "_salt": F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")})
        .join(right, ["_source", "_salt"])
        .withColumn("part", share - F.floor(share))
        .withColumn("sure", F.col("n") * F.floor(share) + F.floor(F.col("n") * F.col("part")))
        .withColumn("part", F.col("n") * F.col("part") - F.floor(F.col("n") * F.col("part")))
        .select(*keys, "n", "source_size", "target", "sure", "part")
    )
    total = items.count()
    groups, level, done = max(1, -(-total // BUCKET)), 0, []
    salt = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "content"), F.lit(groups)).cast("long")
    while True:
        last = groups == 1
        dealt = rows.withColumn("salt", salt).repartition("salt").sortWithinPartitions("salt", F.desc("size"), *keys)
        out = staged(mapped(dealt, _round(seed, level, last), SCHEMA), "rounded")
        if last:
            done.append(out)
            break
        done.append(out.where("part <= 0 or part >= 1"))
        rows, groups, level = out.where("part > 0 and part < 1"), -(-groups // FAN_IN), level + 1
        salt = F.pmod("salt", F.lit(groups))
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    return whole.select(*keys, "n", "source_size", "target", (F.col("sure") + F.col("part").cast("int")).alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("content")
    )


def mixture(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document."""
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
    times = F.floor(F.col("copies") / F.col("n")) + (F.col("nth") < F.col("copies") % F.col("n")).cast("long")
    return copies(sized(docs), seed).select("*", nth).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Texts meet their counts by a hash of the whole row and the id. Of n equal rows each is taken as often
    as n divides their copies; what is left over, if any, is taken of one of them.
    """
    keys = ["_id", "_content"]
    left = docs.select(
        row_struct(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), row_hash(docs).alias("_content")
    )
    found = staged(copies(sized(docs), seed), "copies")
    each = found.select(
        F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("content").alias("_content"),
        F.floor(F.col("copies") / F.col("n")).alias("times"), (F.col("copies") % F.col("n")).alias("more"),
    )
    repeat = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole = left.join(each.where("times > 0").hint("shuffle_hash"), keys).select("row", repeat(F.col("times"))).select("row.*")
    if each.where("more > 0").isEmpty():
        return whole
    one = left.join(each.where("more > 0"), keys).dropDuplicates(keys)
    return whole.union(one.select("row", repeat(F.col("more"))).select("row.*"))
