"""Where outside models plug in: parsers, OCR, embedders, rerankers, generators.

A provider is a plain function on one value. It runs on the executors in Arrow batches; a failure is tried
once more and then becomes an error value in its row, so that no row and no batch is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: (content of a file of ``pages`` pages, pages) -> their texts.
PageParser = Callable[[bytes, int], list[str]]
#: (content, pages in a range) -> first page, pages and content of each range, as a file of its own.
PageCutter = Callable[[bytes, int], Iterator[tuple[int, int, bytes]]]


def attempt(function, *values, tries: int = 2):
    """(result, None) or (None, error)."""
    error = "no try"
    for _ in range(tries):
        try:
            return function(*values), None
        except Exception as e:  # an outside model may raise anything; the row keeps what it said
            error = f"{type(e).__name__}: {e}"[:500]
    return None, error


def plain_pages(content: bytes, n: int) -> list[str]:
    """The default parser: UTF-8 text with form feeds between pages."""
    return content.decode("utf-8").split("\f")


def plain_cut(content: bytes, batch: int) -> Iterator[tuple[int, int, bytes]]:
    pages = content.split(b"\f")
    for first in range(0, len(pages), batch):
        some = pages[first : first + batch]
        yield first, len(some), b"\f".join(some)


def page_ranges(files: DataFrame, cut: PageCutter = plain_cut, batch: int = 4) -> DataFrame:
    """path, first, n, part, error: the files in ranges of ``batch`` pages, each with the content of its own pages.

    A file that cannot be cut gives the ranges before the fault, then a row with the error and no range.
    """
    schema = pa.schema([("path", pa.string()), ("first", pa.int32()), ("n", pa.int32()), ("part", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                ranges, error = attempt(lambda c: iter(cut(c, batch)), content.as_py() or b"", tries=1)
                while True:
                    made, error = (None, error) if error else attempt(next, ranges, None, tries=1)
                    if made is None and error is None:
                        break
                    row = [path.as_py(), *(made or (None, None, None)), error]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                    if error:
                        break

    return files.select("path", "content").mapInArrow(run, "path string, first int, n int, part binary, error string")


def extract_pages(files: DataFrame, parser: PageParser = plain_pages, cut: PageCutter = plain_cut, batch: int = 4, tasks: int | None = None) -> DataFrame:
    """path, page, content, error: from (path, content), in ranges of ``batch`` pages, numbered from 0.

    The ranges are dealt over all tasks, so the pages of one file are read beside each other; each carries its own pages only.
    A range that fails gives one row for each of its pages, with the error and no content, so that error texts never become
    passages; a page that the parser leaves out has neither. A null content is one empty page. Files with one path give rows each.
    """
    spark = files.sparkSession
    ship(spark)
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("content", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, n, part, error in zip(*(b.column(i) for i in range(5)), strict=True):
                pages, first, n, error = None, first.as_py(), n.as_py() or 1, error.as_py()
                if error is None:
                    pages, error = attempt(parser, part.as_py(), n)
                numbers = [None if first is None else first + i for i in range(n)]
                columns = [[path.as_py()] * n, numbers, [*(pages or []), *[None] * n][:n], [error] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    dealt = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return page_ranges(files, cut, batch).repartition(dealt, "path", "first").mapInArrow(run, "path string, page int, content string, error string")


def in_batches(model: Callable[[list], list], values: list, batch: int) -> list:
    """What the model says to each value that isn't null; a batch that fails is tried value by value, and null where that fails."""
    at, out = [i for i, v in enumerate(values) if v is not None], [None] * len(values)
    for a in range(0, len(at), batch):
        some = at[a : a + batch]
        found, error = attempt(model, [values[i] for i in some], tries=1)
        if error or len(found) != len(some):
            found = [(attempt(model, [values[i]])[0] or [None])[0] for i in some]
        for i, x in zip(some, found, strict=True):
            out[i] = x
    return out


def called(value: Column, model: Callable[[str], str]) -> Column:
    """What a model says to each text; null for a null text, "" where it fails twice or says nothing."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else attempt(model, t)[0] or "")

    return F.pandas_udf(run, "string")(value)


def relevance(query: Column, text: Column, model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16, most: int = 512) -> Column:
    """A model's scores of pairs, in batches; of a text its first ``most`` words after the query's are read.

    A batch that fails is tried pair by pair, and pairs that fail have no score (null), as have pairs with a null.
    """

    def cut(q: str, t: str) -> tuple[str, str]:
        asked = q.split()[:most]
        return " ".join(asked), " ".join(t.split()[: most - len(asked)])

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = [None if q is None or t is None else cut(q, t) for q, t in zip(queries, texts, strict=True)]
        return pd.Series(in_batches(model, pairs, batch), dtype="float64")

    return F.pandas_udf(run, "double")(query, text)


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 10) -> DataFrame:
    """Adds ``dense``, made in batches; rows that the model fails on are left out, as are their sparse vectors, since both stay keyed to the row."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(in_batches(model, texts.tolist(), batch))

    ship(rows.sparkSession)
    out = rows.withColumn("dense", F.pandas_udf(run, "array<float>")(F.col(text)))
    return out.where(F.col("dense").isNotNull())


def needs_ocr(pages: DataFrame, corrupted, first: int = 5) -> DataFrame:
    """path, needs_ocr: a file goes to OCR if its first pages hold a corrupted one, or it has no text at all."""
    flagged = pages.withColumn("bad", F.coalesce(corrupted(F.col("content")), F.lit(False)) & (F.col("page") < first))
    return flagged.groupBy("path").agg(
        (F.max("bad") | (F.count(F.when(F.length(F.trim("content")) > 0, 1)) == 0)).alias("needs_ocr")
    )
