import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from llm_rows import make
from pyspark.sql import functions as F

from passagework.llm import mixing as m
from passagework.llm import sharding as h


def slots_are_gapless(rows, shards, total):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def digest(r):
    body = (r["text"] or "").encode()
    return str((r["doc_id"], len(body) + 8, zlib.crc32(body)))


def test_shards(awkward, empty):
    rows = h.assign_shards(awkward).collect()
    slots_are_gapless(rows, 24, awkward.count())
    assert Counter(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == Counter(map(digest, awkward.collect()))
    assert h.assign_shards(empty).count() == 0


@pytest.mark.parametrize("hot", [1024, 20])
def test_any_layout_gives_the_same_order(spark, monkeypatch, hot):
    monkeypatch.setattr(h, "BUCKET_ROWS", 50)
    monkeypatch.setattr(h, "HOT", hot)
    docs = make(spark, [(i if i % 3 else None, f"t{i}", "s") for i in range(600)] + [(None, "copied", "s")] * 400)
    rows = h.assign_shards(docs).collect()
    slots_are_gapless(rows, 24, 1000)
    assert Counter(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == Counter(map(digest, docs.collect()))
    again = h.assign_shards(docs.repartition(7).orderBy("text")).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    buckets = h.external_shuffle(docs).groupBy("bucket").count().collect()
    assert len(buckets) == 20 and (hot == 1024 or max(r["count"] for r in buckets) < 100)


def test_order_is_mixed_and_seeded(spark):
    docs = make(spark, [(i, "x", "s") for i in range(2000)])
    order = lambda seed: [r["doc_id"] for r in h.assign_shards(docs, 1, seed).orderBy("slot").collect()]
    a = order(1)
    assert a == order(1) and a != order(2)
    assert abs(sum(x < y for x, y in zip(a, a[1:], strict=False)) - 1000) < 150


def test_written_shards_are_ordered_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(h, "BUCKET_ROWS", 40)
    docs = make(spark, [(i, f"t{i}", "s") for i in range(300)])
    for n in ("row", "shard", "_shard", "_at", "slot", "bucket", "h", "n"):
        docs = docs.withColumn(n, F.lit("clash"))
    path = tmp_path / "out"
    h.write_shards(docs, str(path), 4)
    found = h.read_shards(spark, str(path), docs.schema)
    assert Counter(map(str, found.select("row.*").collect())) == Counter(map(str, docs.collect()))
    for shard in range(4):
        files = sorted(path.glob(f"shard={shard}/bucket=*/*.parquet"), key=lambda f: int(f.parent.name.partition("=")[2]))
        assert len({f.parent for f in files}) == len(files)
        slots = [x for f in files for x in pq.read_table(f, columns=["slot"], partitioning=None)["slot"].to_pylist()]
        assert slots == list(range(75))
    h.write_shards(docs.limit(0), str(tmp_path / "none"), 4)
    assert h.read_shards(spark, str(tmp_path / "none"), docs.schema).count() == 0


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    free = list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
        left -= sum(out[s] for s in over)
    return out


def check_mix(rows, docs):
    sizes, words = Counter(), []
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        words.append((str(r["doc_id"]), n))
    goal = water(sizes)
    assert Counter((str(r["doc_id"]), r["size"]) for r in rows) == Counter(words)
    assert sorted({round(r["target"], 3) for r in rows}) == sorted({round(x, 3) for x in goal.values()})
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] if r["size"] else r["taken"] == 0 for r in rows)
    return goal


def test_mixture(spark, awkward, empty):
    docs = awkward.where("doc_id is null or doc_id <> 13").collect()
    df = make(spark, [(r["doc_id"], r["text"], r["source"]) for r in docs])
    rows = m.mixture(df).collect()
    check_mix(rows, docs)
    again = m.mixture(df.repartition(7)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert m.mixture(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 20])
def test_sources_hit_their_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET", bucket)
    monkeypatch.setattr(m, "FAN_IN", 3)
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.randint(1, 60)), "hot" if i % 3 else rng.choice("abcdef")) for i in range(1500)]
    df = make(spark, data)
    rows = m.mixture(df).collect()
    goal = check_mix(rows, df.collect())
    source, taken = {i: s for i, _, s in data}, Counter()
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 61 for s in goal)


def test_mixed_repeats_rows(spark, awkward, empty):
    got = Counter(str(r) for r in m.mixed(awkward).collect())
    assert set(got) <= {str(r) for r in awkward.collect()}
    assert sum(got.values()) == m.copies(m.sized(awkward)).agg(F.sum("copies")).first()[0]
    assert m.mixed(empty).count() == 0


def test_rows_of_one_id_agree_in_any_layout(spark):
    rows = [(7 if i % 2 else None, f"a{i % 40} b c", "ab"[i % 2]) for i in range(400)] + [(1, "one text", "c")] * 33
    df = make(spark, rows)
    again = df.repartition(7).orderBy("text", "doc_id")
    found = [Counter(str(r) for r in m.mixed(x).collect()) for x in (df, again)]
    assert found[0] == found[1]
    assert Counter(map(str, m.mixture(df).collect())) == Counter(map(str, m.mixture(again).collect()))
    check_mix(m.mixture(df).collect(), df.collect())


def test_a_hot_missing_id_is_spread(spark):
    df = make(spark, [(None, f"text {i}", "s") for i in range(20_000)])
    sizes = m.sized(df)
    salts = sizes.select(F.pmod(F.xxhash64(F.lit(42), "doc_id", "content"), F.lit(5)).alias("salt")).groupBy("salt").count().collect()
    assert len(salts) == 5 and max(r["count"] for r in salts) < 5000
    check_mix(m.mixture(df).collect(), df.collect())


def test_equal_rows_are_one_item(spark):
    df = make(spark, [(None, "same words", "s")] * 5000 + [(i, "w " * (i % 9 + 1), "t") for i in range(300)])
    assert m.copies(m.sized(df)).count() == 301
    check_mix(m.mixture(df).collect(), df.collect())
    assert m.mixed(df).count() == m.copies(m.sized(df)).agg(F.sum("copies")).first()[0]


def test_clashing_names(spark):
    df = make(spark, [(i, f"w{i} x", "s") for i in range(9)])
    for n in ("size", "content", "n", "row", "times", "more", "_id", "_content", "salt"):
        df = df.withColumn(n, F.lit("mine"))
    rows = m.mixed(df).collect()
    assert rows and m.mixed(df).columns == df.columns and all(r["_content"] == r["n"] == "mine" for r in rows)


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_targets_of_many_sources(spark, n):
    rng = random.Random(n)
    sizes = {f"s{i:04d}": rng.randint(0, 500) for i in range(n)} | {None: 40}
    got = m.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    goal = water(sizes)
    assert {r["source"]: round(r["target"], 3) for r in got} == {s: round(x, 3) for s, x in goal.items()}
