"""Where a chunk lies: its pages and heading, by a join of character ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines on a page of plain text, characters of a line that serve as its heading.
LINES, HEADING = 12, 80
#: Characters of one bin.
BIN = 4096


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Pairs of rows of one ``key`` whose ranges [start, stop) have a character in common, once each.

    A range is listed under the bins that it touches, so rows meet by equality of key and bin and a long document
    is as many keys as it has bins. A pair counts in the bin in which the later one starts. ``left`` keeps its columns, of ``right``
    all but the key are added; ``start`` and ``stop`` are the left ones. Empty ranges and nulls meet nothing.
    """
    bins = lambda d: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("_bin")
    real = F.col("start") < F.col("stop")
    a = left.where(real).select("*", bins(left))
    more = [c for c in right.columns if c not in (key, "start", "stop")]
    b = right.where(real).select(key, F.col("start").alias("_start"), F.col("stop").alias("_stop"), *more, bins(right))
    meet = (F.col("start") < F.col("_stop")) & (F.col("_start") < F.col("stop")) & (F.floor(F.greatest("start", "_start") / width) == F.col("_bin"))
    return a.join(b, [key, "_bin"]).where(meet).select(*left.columns, *more)


def page_ranges(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, page, heading, start, stop): every ``lines`` lines of a text are a page; its first line is its heading.

    ``stop`` counts the line break that ends a page. A text that is null or empty has no page.
    """
    parts = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(lines))
    sized = F.transform(starts, lambda at: F.struct(
        F.aggregate(F.slice(parts, at + 1, lines), F.lit(0), lambda n, x: n + F.length(x) + 1).cast("long").alias("size"),
        F.left(F.get(parts, at), F.lit(HEADING)).alias("heading"),
    ))
    cut = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(sized).alias("page", "p"))
    upto = F.sum("p.size").over(Window.partitionBy("doc_id").orderBy("page"))
    return cut.select("doc_id", F.col("page").cast("long").alias("page"), "p.heading", (upto - F.col("p.size")).alias("start"), upto.alias("stop"))


def located(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_id, start, stop) with first_page, last_page and the heading of the first."""
    met = overlapping(chunks.select("doc_id", "chunk_id", "start", "stop"), pages, "doc_id")
    return met.groupBy("doc_id", "chunk_id").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("heading", "page").alias("heading")
    )
