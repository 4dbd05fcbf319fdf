"""Rows that differ only in which of two neighbouring columns is null are different rows."""

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from llm_rows import SCHEMA

from passagework.llm import common, mixing, sharding, simhash_dedup


def moved(spark, n, text="some words of a text that is long enough", number=1):
    """n rows with a language and no source, n with a source and no language; equal otherwise."""
    rows = [(number, text, "x", None, 5)] * n + [(number, text, None, "x", 5)] * n
    return spark.createDataFrame(rows, SCHEMA)


def counted(rows):
    return Counter((r["lang"], r["source"]) for r in rows)


def test_hash_tells_where_nulls_are(spark):
    df = moved(spark, 1)
    assert df.select(common.row_hash(df)).distinct().count() == 2
    nested = spark.createDataFrame([([None, 1], None), ([1, None], None), (None, [1]), ([1], None)], "a array<int>, b array<int>")
    assert nested.select(common.row_hash(nested)).distinct().count() == 4


@pytest.mark.parametrize("hot", [1024, 10])
def test_shuffle(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "HOT", hot)
    assert counted(sharding.external_shuffle(moved(spark, 60)).select("row.*").collect()) == {("x", None): 60, (None, "x"): 60}


def test_rows_that_one_hash_takes_for_equal_are_not_dealt_as_copies(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "HOT", 10)
    monkeypatch.setattr(sharding, "row_hash", lambda df, *first: F.xxhash64(*first, "doc_id") if not first else common.row_hash(df, *first))
    assert counted(sharding.external_shuffle(moved(spark, 30)).select("row.*").collect()) == {("x", None): 30, (None, "x"): 30}


def test_deduplicated(spark):
    far = moved(spark, 2).union(moved(spark, 2, "quite another text without one word in common here"))
    kept = simhash_dedup.deduplicated(far).collect()
    assert len(kept) == 2 and len({r["text"] for r in kept}) == 2


def test_mixed(spark):
    df = moved(spark, 1, " ".join(f"w{i}" for i in range(64)), 7)
    taken = {(r["doc_id"], r["source_size"], r["target"]): r["taken"] for r in mixing.mixture(df).collect()}
    got = counted(mixing.mixed(df).collect())
    assert sum(got.values()) * 64 == sum(taken.values()) and got[None, "x"] >= got["x", None] - 1


def test_two_pipelines_at_once(spark, data):
    import corpus_pipeline as p

    whole = lambda _=None: sorted(map(str, p.run(spark, data).select("doc_id", "piece", "ids_crc32").collect()))
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(whole, range(2))
    assert a == b and a
