"""What a batch of the ingestion does with texts: judged once, moved by no shuffle, cut in windows without a search from their beginning."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import ingest_corpus
from passagework.functions import text
from passagework.operators import chunk

SCHEMA = "doc_id long, text string, lang string, source string"


def test_texts_are_judged_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    rows = [(i, f"the w{i} and of a line " * 90, "en", "s") for i in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    plans, write = [], ingest_corpus.write_batch

    def kept(df, path, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, path, *more)

    monkeypatch.setattr(ingest_corpus, "write_batch", kept)
    told = ingest_corpus.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert told["documents_written"] == 20 and len(plans) == 2
    for plan in plans:
        assert "Relation" in plan and not [x for x in ("regexp", "Window", "Join", "Aggregate") if x in plan]
    assert {p.name for p in Path(tmp_path / "out").iterdir()} == {"documents", "chunks"}  # judged texts are gone


@pytest.mark.parametrize("few", [0, 100_000])
def test_known_and_repeated_ids_of_a_later_batch(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ingest_corpus, "FEW", few)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = [(1, "a" * 50, "fr", "s"), (2, "b" * 2000, "", "s"), (None, "c" * 60, "en", "s")]
    second = [(2, "z" * 50, "de", "s"), (2, "a" * 60, "de", "s"), (3, "y" * 70, "fr", "s"), (3, "d" * 80, "fr", "s"), (4, None, None, None), (None, "", "", "")]
    for rows, read, written in ((first, 3, 2), (second, 6, 2)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        told = ingest_corpus.run(spark, source, out, mark)
        assert (told["rows_read"], told["documents_written"]) == (read, written)
    got = {r["doc_id"]: (r["lang"], r["n_chars"], r["n_chunks"], r["batch"]) for r in ingest_corpus.documents(spark, out).collect()}
    assert got == {1: ("fr", 50, 1, 0), 2: ("", 2000, 3, 0), 3: ("fr", 80, 1, 1), 4: (None, 0, 0, 1)}
    assert ingest_corpus.chunks(spark, out).groupBy("doc_id").count().count() == 3


def test_chunks_name_their_neighbours_and_are_as_many_as_listed(spark, tmp_path):
    lengths = [40, 99, 100, 101, 180, 181, 260, 261, 5000]
    spark.createDataFrame([(n, "x" * n, "fr", "s") for n in lengths], SCHEMA).write.parquet(str(tmp_path / "in"))
    config = ingest_corpus.DEFAULTS | {"size": 100, "overlap": 20}
    ingest_corpus.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), config)
    listed = {r["doc_id"]: r["n_chunks"] for r in ingest_corpus.documents(spark, str(tmp_path / "out")).collect()}
    for n in lengths:
        made = ingest_corpus.chunks(spark, str(tmp_path / "out")).where(F.col("doc_id") == n).orderBy("idx").collect()
        names = [r["chunk_id"] for r in made]
        assert len(names) == listed[n] == max(0, -(-(n - 100) // 80)) + 1
        assert [r["prev_chunk_id"] for r in made] == ["", *names[:-1]] and [r["next_chunk_id"] for r in made] == [*names[1:], ""]


def test_windows_of_texts_of_any_width(spark):
    texts = ["a", "abcdefg", "abcdefgh", "é" * 23, "తెలుగు పదం " * 9, "𝐀b é" * 12, "x" * 30 + "𝐀", "﻿ab" * 9, "\x00" * 9]
    texts += [t * 60 for t in texts]  # long ones
    docs = spark.createDataFrame([*((i, t, "l", "s") for i, t in enumerate(texts)), (199, None, "l", "s"), (200, "", "l", "s")], SCHEMA)
    got = sorted((r["doc_id"], r["idx"], r["chunk"]) for r in chunk.fixed(docs, 7, 3).collect())
    assert got == [(i, k, t[k * 4 : k * 4 + 7]) for i, t in enumerate(texts) for k in range(max(0, -(-(len(t) - 7) // 4)) + 1)]


def test_long_texts_are_cut_in_proportion(spark):
    """Windows of bytes are cut, not characters counted from the text's beginning, which took longer."""
    docs = spark.createDataFrame([(1, "a"), (2, "é")], "doc_id long, t string").select("doc_id", F.repeat("t", F.lit(1_000_000)).alias("text"), *(F.lit("").alias(c) for c in ("lang", "source")))
    began = time.monotonic()
    got = {r["doc_id"]: (r["n"], r["chars"]) for r in chunk.fixed(docs, 100, 20).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("chars")).collect()}
    assert got == {1: (12_500, 1_249_980), 2: (12_500, 1_249_980)}
    assert time.monotonic() - began < 20


def test_words_by_one_pattern(spark):
    given = ["", "The cat_1 sat, on a-mat x9 ab9 9ab _ab ab_", "తెab ab తెలుగు-cd ef౧ gh", "it's I'm U.S. A b", "\tnew\nline\r end ", "é the ü und"]
    df = spark.createDataFrame([(t,) for t in given], "t string").select(text.sanitize(F.col("t")).alias("t"))
    assert all(r["a"] == r["b"] for r in df.select(text.words(F.col("t"), 2).alias("a"), text.whole_words(F.col("t"), 2).alias("b")).collect())


def test_sanitize_keeps_one_block(spark):
    given = "a\x0bb\x0cc\x7fd௿eఀ౿ಀf\U0001d400g h \t\r\n i\x85"
    got = spark.createDataFrame([(given,)], "t string").select(text.sanitize(F.col("t"))).first()[0]
    assert got == "abcdeఀ౿fgh i"
