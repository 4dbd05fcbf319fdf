"""Chunkers, chunk numbering and parents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import chunk_id
from ..functions.text import BLANK
from ..shipping import ship

SIZE, OVERLAP = 1000, 150
#: Texts other than ASCII of more than so many windows are cut out of wide bytes, which cost more than searching in shorter ones.
FAR = 32
#: The splitter's overlap and marks for recognised text.
OCR_OVERLAP, OCR_MARKS = 200, ("\n\n", "\n", "।", ".", " ", "")
# The lengths by which paragraphs are merged.
TARGET, MOST, LEAST = 1200, 2000, 200


def last_index(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The idx of the last window of a text that isn't empty."""
    return F.greatest(F.lit(0), F.ceil((length - size) / (size - overlap))).cast("int")


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, source, idx, chunk: windows of ``size`` characters that share ``overlap``; with the documents' columns ``keep``.

    Windows of ASCII texts and of long ones are cut out of bytes of one width (1 or 4), so that none is searched for from the text's beginning.
    The mark before the latter is what decoding takes away, so that a window's own one stays.
    """
    step, text, width = size - overlap, F.col("text"), F.col("_width")
    n = F.length(text)
    ascii_, long_ = F.octet_length(text) == n, n > FAR * size
    wide = F.when(ascii_, text.cast("binary")).when(long_, F.encode(text, "UTF-32"))
    cut = F.substring(F.col("_wide"), F.col("idx") * step * width + 1, width * size)
    chunk = (
        F.when(width == 1, cut.cast("string")).when(width == 4, F.decode(F.concat(F.unhex(F.lit("0000FEFF")), cut), "UTF-32"))
        .otherwise(F.substring(text, F.col("idx") * step + 1, F.lit(size)))
    )
    return (
        docs.where(n > 0)
        .select("doc_id", "lang", "source", *keep, "text", F.when(ascii_, 1).when(long_, 4).otherwise(0).alias("_width"), wide.alias("_wide"),
                last_index(n, size, overlap).alias("_last"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("idx"))  # apart, since what stands beside a generator is computed for each of its rows
        .select("doc_id", "lang", "source", *keep, F.col("idx").cast("long").alias("idx"), chunk.alias("chunk"))
    )


def doc_name(doc_id: Column) -> Column:
    return F.left(F.md5(doc_id.cast("string")), F.lit(12))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds chunk_id by position."""
    return chunks.withColumn("chunk_id", chunk_id(doc_name(F.col("doc_id")), F.col("idx")))


def linked(chunks: DataFrame) -> DataFrame:
    """Adds the ids of the chunks before and after (empty at the ends) and the number of chunks."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return chunks.select(
        "*", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total_chunks"),
        F.lag("chunk_id", 1, "").over(w).alias("prev_chunk_id"), F.lead("chunk_id", 1, "").over(w).alias("next_chunk_id"),
    )


def parents(chunks: DataFrame) -> DataFrame:
    """One row per (doc_id, page): chunk texts in order of chunk_id, with the first chunk's id."""
    return chunks.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk"))), lambda x: x["chunk"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk_id"),
    )


def merged_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """Every ``n`` parents of a document in one; the label names the first and last page."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return (
        pages.withColumn("batch", F.floor(nth / n))
        .groupBy("doc_id", "batch")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("text"),
            F.concat_ws("-", F.min("page").cast("string"), F.max("page").cast("string")).alias("label"),
            F.sum("n_chunks").alias("n_chunks"),
        )
    )


def by_page(merged: DataFrame) -> DataFrame:
    """A row for each page that a merged parent's label spans, so that any of them finds it by equality."""
    ends = F.transform(F.split("label", "-"), lambda x: x.try_cast("long"))
    return merged.select("*", F.explode(F.sequence(F.get(ends, F.lit(0)), F.element_at(ends, -1))).alias("page"))


def heading_runs(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring rows with the same heading: (page_id, run, heading, n)."""
    w = Window.partitionBy("page_id").orderBy("pos")
    new = F.when(F.lag("heading").over(w).eqNullSafe(F.col("heading")), 0).otherwise(1)
    return (
        lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
        .groupBy("page_id", "run").agg(F.min("heading").alias("heading"), F.count(F.lit(1)).alias("n"))
    )


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Recursive splitter: by the first mark that occurs, pieces joined again up to ``size``, tails shared."""
    mark = next((m for m in marks if m in text), "")
    rest = marks[marks.index(mark) + 1 :] if mark in marks else ()
    parts = text.split(mark) if mark else list(text)
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        joined = mark.join(held).strip()
        if joined:
            out.append(joined)

    for part in (p for p in parts if p):
        if len(part) > size and rest:
            if held:
                close()
                held = []
            out.extend(split_text(part, size, overlap, rest))
            continue
        if held and len(mark.join([*held, part])) > size:
            close()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    if held:
        close()
    return out


def _strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{BLANK}+|{BLANK}+$", "")


def _spaced(*parts: Column) -> Column:
    """The parts that aren't empty, with one space between."""
    return _strip(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, rf"(?<=[.!?]){BLANK}+"), _strip), lambda s: s != "")


def merged(text: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, compat: bool = False) -> Column:
    """An array of chunks: paragraphs joined up to ``target``, at most ``most`` long, none under ``least``.

    A fold over the paragraphs. Its state is the chunks so far, the tail that the next chunk starts with, and the open chunk.
    A chunk that has reached the target is closed and leaves its last sentence, or its end if that is longer than ``overlap``, as the tail.
    A paragraph with which the open chunk would reach ``most`` closes it and is packed by sentences, starting from the
    end of what was closed. The tail is used once; with ``compat`` it stays until a chunk is closed, and so comes again
    with each paragraph.
    """
    none = F.lit("")
    state = lambda done, tail, open_: F.struct(done.alias("done"), tail.alias("tail"), open_.alias("open"))
    end = lambda t: F.right(t, F.lit(overlap))
    with_ = lambda done, c: F.concat(done, F.array(c))

    def tail_of(c: Column) -> Column:
        return _named(F.element_at(_sentences(c), -1), lambda s: F.when(F.length(s) <= overlap, s).otherwise(end(c)))

    def add_sentence(s: Column, t: Column) -> Column:
        full = F.length(s["open"]) + F.length(t) + 1 > most
        kept = F.when(full, with_(s["done"], _strip(s["open"]))).otherwise(s["done"])
        return state(kept, none, _spaced(F.when(full, end(s["open"])).otherwise(s["open"]), t))

    def packed(s: Column, p: Column) -> Column:
        closed = F.when(s["open"] != "", with_(s["done"], _spaced(s["tail"], s["open"]))).otherwise(s["done"])
        return F.aggregate(_sentences(p), state(closed, none, F.when(s["open"] != "", end(s["open"])).otherwise(s["tail"])), add_sentence)

    def add_paragraph(s: Column, p: Column) -> Column:
        return _named(
            _spaced(s["tail"], s["open"], p),
            lambda grown: F.when(F.length(grown) < target, state(s["done"], s["tail"] if compat else none, grown))
            .when(F.length(grown) < most, state(with_(s["done"], grown), tail_of(grown), none))
            .otherwise(packed(s, p)),
        )

    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, none), r"\n\n+"), _strip), lambda p: p != "")
    start = state(F.array().cast("array<string>"), none, none)
    last = lambda s: F.when(s["open"] != "", with_(s["done"], _spaced(s["tail"], s["open"]))).otherwise(s["done"])
    return F.filter(F.aggregate(paragraphs, start, add_paragraph, last), lambda c: F.length(c) >= least)


def by_paragraphs(docs: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id, idx, chunk: the paragraphs of each text, merged."""
    return docs.select("doc_id", F.posexplode(merged(F.col("text"), compat=compat)).alias("idx", "chunk")).withColumn("idx", F.col("idx").cast("long"))


def _apply(split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, c) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for i, c in enumerate(split(t.as_py() or ""))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["doc_id", "idx", "chunk"]
            )

    return run


def by_python(docs: DataFrame, split) -> DataFrame:
    """doc_id, idx, chunk by one of the sequential splitters, a document at a time."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_apply(split), "doc_id long, idx long, chunk string")
