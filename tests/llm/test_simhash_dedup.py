import random

import numpy as np
import pytest
import xxhash

from passagework.llm import simhash_dedup as s


def brute_print(text):
    b = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", b) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints(awkward):
    for r in awkward.collect():
        assert s.fingerprint(r["text"]) == brute_print(r["text"])


@pytest.mark.parametrize("tiled", [16384, 8])
def test_bucket_links_find_all_components(monkeypatch, tiled):
    monkeypatch.setattr(s, "TILED", tiled)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << rng.randrange(20) for _ in range(rng.randint(0, 6))) for _ in range(150)}
    fp = np.array(sorted(p & (1 << 64) - 1 for p in prints), np.uint64)
    assert s.bucket_links(fp).tolist() == brute_components([int(x) for x in fp])


def test_links_of_any_three_bits_are_found(spark):
    rng = random.Random(5)
    a = [rng.getrandbits(63) for _ in range(300)]
    b = [x ^ sum(1 << k for k in rng.sample(range(63), 3)) for x in a]
    near = spark.createDataFrame([(x,) for x in {*a, *b}], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in s.links(near).collect()}
    assert got >= {frozenset(p) for p in zip(a, b, strict=True)}
    assert all((x ^ y).bit_count() <= 3 for x, y in map(tuple, got))


def test_hot_keys_are_split_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for _ in range(500)}
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")

    def parts():
        unsigned = sorted(prints)
        place = {p: i for i, p in enumerate(unsigned)}
        found = list(range(len(unsigned)))
        for r in s.links(fps).collect():
            x, y = (found[place[v & (1 << 64) - 1]] for v in (r["a"], r["b"]))
            found = [min(x, y) if z in (x, y) else z for z in found]
        return found

    expected = brute_components(sorted(prints))
    assert s._hot(s._segments(fps)).isEmpty() and parts() == expected
    monkeypatch.setattr(s, "TILED", 6)
    assert not s._hot(s._segments(fps)).isEmpty() and parts() == expected
    sizes = s.variants(fps).groupBy("key").count()
    plain = sizes.where("key & 4194303 = 0").agg({"count": "max"}).first()[0]
    assert plain <= 6 and sizes.where("key & 4194303 <> 0").count() > 0


def test_any_long_is_an_id(spark):
    from llm_rows import make

    ids = [1 << 62, (1 << 62) + 5, (1 << 63) - 1, -(1 << 63), None]
    docs = make(spark, [(i, f"alone {i} with words of its own", "s") for i in ids] + [((1 << 63) - 1, "twin text here", "s"), ((1 << 62) + 7, "twin text here", "s")])
    got = [(r["doc_id"], r["component_id"]) for r in s.simhash_components(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(i, i) for i in ids] + [((1 << 63) - 1, (1 << 62) + 7), ((1 << 62) + 7, (1 << 62) + 7)]))
    assert sorted(str(r["doc_id"]) for r in s.deduplicated(docs).collect()) == sorted(map(str, [*ids, (1 << 62) + 7]))


def test_deduplicated_keeps_clashing_columns_and_one_of_equal_rows(spark):
    from llm_rows import make
    from pyspark.sql import functions as F

    docs = make(spark, [(None, "same text again", "s")] * 3 + [(4, "x y z w", "s")] * 2 + [(3, "x y z w", "s"), (9, "lone words", "s")])
    for n in ("_keep", "_content", "_id", "row", "fp", "content", "label"):
        docs = docs.withColumn(n, F.lit("mine"))
    got = s.deduplicated(docs)
    assert got.columns == docs.columns and all(r["_content"] == r["_keep"] == "mine" for r in got.collect())
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["3", "9", "None"]
    other = docs.withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    assert s.deduplicated(other).count() == 3


def test_large_keys_keep_links_of_both_signs(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = np.array(sorted({*base, *(x ^ sum(1 << k for k in rng.sample(range(64), 3)) for x in base)}), np.uint64)
    rows = np.sort(prints.view(np.int64))  # as Spark sorts them
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array(np.full(len(r), 7)), pa.array(r)], ["key", "fp"])

    def parts():
        place = {int(x): i for i, x in enumerate(rows)}
        label = list(range(len(rows)))
        for out in s._links(iter([batch(rows[:100]), batch(rows[100:])])):
            for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True):
                x, y = label[place[a]], label[place[b]]
                label = [min(x, y) if z in (x, y) else z for z in label]
        return label

    expected = brute_components([int(x) & (1 << 64) - 1 for x in rows])
    assert parts() == expected  # by tiles
    monkeypatch.setattr(s, "TILED", 8)
    assert parts() == expected  # by value


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200)]
    got = {r["node"]: r["label"] for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200


def test_components_against_brute_force(spark, awkward, empty):
    rows = awkward.collect()
    prints = [brute_print(r["text"]) for r in rows]
    label = brute_components(prints)
    least = {}
    for r, k in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    expected = sorted((str(r["doc_id"]), f"{p:016x}", str(least.get(k))) for r, p, k in zip(rows, prints, label, strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in s.simhash_components(awkward).collect()) == expected
    assert s.simhash_components(empty).count() == 0


def test_deduplicated_keeps_one_row_of_each_component(spark, awkward):
    got = s.deduplicated(awkward)
    assert got.columns == awkward.columns
    label = brute_components([brute_print(r["text"]) for r in awkward.collect()])
    assert got.count() == len(set(label))
    assert {5} <= {r["doc_id"] for r in got.collect()} and not {6} & {r["doc_id"] for r in got.collect()}
