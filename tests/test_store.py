from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from passagework.sources.tables import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def size(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_additions_write_what_is_new(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k long, v string", "k")
    with pytest.raises(AnalysisException):
        store.read()
    assert store.create() and not store.create() and rows(store.read()) == []
    many = spark.createDataFrame([(i, "v" * 50) for i in range(5000)], "k long, v string")
    store.add(many)
    before = size(store.path)
    store.add(many.union(spark.createDataFrame([(9000, "new")], "k long, v string")))
    after = size(store.path)
    assert all(after[f] == t for f, t in before.items())  # nothing is rewritten
    assert sum(f.stat().st_size for f in after.keys() - before.keys()) < sum(f.stat().st_size for f in before) / 5
    store.add(many)
    assert size(store.path) == after and store.read().count() == 5001


def test_null_and_repeated_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k long, v string", "k")
    store.create()
    given = spark.createDataFrame([(None, "b"), (None, "a"), (1, "y"), (1, "x"), (2, None)], "k long, v string")
    for _ in range(2):
        store.add(given)
        assert rows(store.read()) == [(1, "x"), (2, None), (None, "a")]
    assert store.new(given).count() == 0
    for _ in range(2):
        store.upsert(spark.createDataFrame([(None, "c"), (3, "n"), (3, "m"), (2, None)], "k long, v string"))
        assert rows(store.read()) == [(1, "x"), (2, None), (3, "m"), (None, "c")]
    store.add(given)
    assert store.read().count() == 4
    store.upsert(given.limit(0))
    store.add(given.limit(0))
    assert store.read().count() == 4


def test_replacing_writes_the_replaced_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "k long, v string", "k")
    store.create()
    store.add(spark.range(4000).selectExpr("id as k", "repeat('v', 50) as v"))
    before = size(store.path)
    change = spark.createDataFrame([(7, "changed")], "k long, v string")
    store.upsert(change)
    once = size(store.path)
    store.upsert(change)
    assert size(store.path) == once and len(once) == len(before) + 1
    assert store.read().where("k = 7").collect() == [(7, "changed")] and store.read().count() == 4000
