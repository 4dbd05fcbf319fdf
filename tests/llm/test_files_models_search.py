import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import make
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm import exact_topk as e
from passagework.llm import common, packing
from passagework.llm import quality_classifier as c
from passagework.llm import token_files as t
from passagework.llm.common import new_folder
from passagework.llm.tokens import default_path


def test_token_files_round_trip(spark, awkward, empty):
    library, at, expected = Tokenizer.from_file(default_path()), 0, []
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"])
    for r in sorted(awkward.withColumn("tie", F.xxhash64("text")).collect(), key=key):
        ids = b"".join(i.to_bytes(4, "little") for i in [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
        expected.append((str(r["doc_id"]), at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = t.round_trip(spark, awkward).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    assert t.round_trip(spark, empty).count() == 0


def test_hot_and_null_ids_are_split_over_shards(spark, awkward):
    docs = awkward.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "text", F.lit(1).alias("tie"), F.lit(2).alias("shard"))
    docs = docs.union(spark.createDataFrame([(None, "the same row", 1, 2)] * 3000, docs.schema))
    manifest = t.write_token_files(docs, new_folder(spark, "hot"), shard_bytes=10_000)
    rows = manifest.orderBy("shard").collect()
    assert len(rows) > 20 and max(r["n_tokens"] for r in rows) < 0.9 * sum(r["n_tokens"] for r in rows)
    got = sorted(tuple(r) for r in t.read_documents(manifest).select("start", "n_tokens", "doc_id").collect())
    assert [a + n for a, n, _ in got[:-1]] == [a for a, _, _ in got[1:]] and len(got) == docs.count()
    ids = [d for _, _, d in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_sequences_are_equal_in_length_and_views_of_the_file(spark, tmp_path):
    folder = new_folder(spark, "one")
    docs = make(spark, [(i, "word " * 300, "s") for i in range(40)])
    rows = t.write_token_files(docs, folder, length=128, rows=4).collect()
    assert sum(r["n_tokens"] for r in rows) == t.read_documents(spark.createDataFrame(rows), 128, 4).agg(F.sum("n_tokens")).first()[0]
    path = rows[0]["name"].removeprefix("file://") + ".arrow"
    with pa.memory_map(path) as source:
        before, reader = pa.total_allocated_bytes(), t.ShardReader(source, 128, 4)
        ids, mask = reader.sequence(5)
        assert len(ids) == len(mask) == 128 and mask.all() and not ids.flags.owndata and not mask.flags.owndata
        last = reader.sequence(-(-rows[0]["n_tokens"] // 128) - 1)[1]
        assert mask.dtype == np.uint8 and int(last.sum()) == (rows[0]["n_tokens"] - 1) % 128 + 1
        assert pa.total_allocated_bytes() - before < 4096


def test_classifier_learns_what_is_not_held_out(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r["doc_id"]: r for r in c.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (c.crc_mod(d) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if c.crc_mod(r["doc_id"]) == 2]
    assert np.mean([p == q for p, q in held]) >= 0.8


def test_classifier_equals_the_formula():
    rng = np.random.default_rng(0)
    d = len(c.FEATURES)
    m = c.Model(0.5, (np.zeros(d), np.ones(d)), (np.eye(d), np.eye(d) * 2), (0.0, -1.0))
    x = rng.normal(size=(5, d))
    log0, log1 = -0.5 * (x**2).sum(1), -1 - 0.5 * (4 * (x - 1) ** 2).sum(1)
    assert np.allclose(m.score(x), 1 / (1 + np.exp(log0 - log1)))


def brute_statistics(text):
    """The statistics in the order of ``FEATURES``, by other means."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, body, lines = max(1, len(words)), (text or "").encode(), [x for x in (text or "").encode().split(b"\n") if x.strip()]
    chars = max(1, sum(b not in b" \t\n\x0b\x0c\r" for b in body))
    count = lambda signs: sum(b in signs for b in body)
    upper, digits = bytes(range(65, 91)), bytes(range(48, 58))
    shares = {
        "distinct": len(set(words)) / n, "duplicate_lines": 1 - len(set(lines)) / max(1, len(lines)), "upper": count(upper) / chars,
        "digits": count(digits) / chars, "symbols": count(b"#*$%&<>@^_~{}[]\\=+") / chars, "exclaims": count(b"!") / n, "bars": count(b"|") / n,
        "stops": count(b".") / n, "commas": count(b",") / n, "long_words": sum(len(w.encode()) > 15 for w in words) / n,
        "non_ascii": sum(b > 127 for b in body) / chars, "single": sum(len(w.encode()) == 1 for w in words) / n,
        "top_word": max(map(words.count, words), default=0) / n,
    }
    logs = {"words": math.log1p(len(words)), "mean_word": math.log1p(chars / n), "lines": math.log1p(n / max(1, len(lines)))}
    return [logs[f] if f in logs else math.sqrt(min(4, max(0, shares[f]))) for f in c.FEATURES]


def test_classifier_agrees_with_numpy(spark, awkward):
    rows = [r for r in awkward.collect() if r["doc_id"] is not None and r["doc_id"] not in (4, 13)]
    for r in rows:
        assert np.allclose(c.statistics(r["text"]), brute_statistics(r["text"]))
    docs = make(spark, [(r["doc_id"], r["text"], "s") for r in rows])
    labels = {r["doc_id"]: r["doc_id"] % 3 == 0 for r in rows}
    got = {r["doc_id"]: r["score"] for r in c.classify(docs, spark.createDataFrame([(d, int(q)) for d, q in labels.items()], "doc_id long, quality int")).collect()}
    x = np.array([brute_statistics(r["text"]) for r in rows])
    y = np.array([labels[r["doc_id"]] if c.crc_mod(r["doc_id"]) != 2 else -1 for r in rows])
    both = [x[y == k] for k in (0, 1)]
    pooled = sum(np.cov(b.T, bias=True) * len(b) for b in both) / sum(map(len, both))
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(x.shape[1])
    logs = []
    for b in both:
        cov, gap = 0.8 * np.cov(b.T, bias=True) + 0.2 * pooled, x - b.mean(0)
        logs.append(np.log(len(b)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", gap @ np.linalg.inv(cov), gap))
    expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose([got[r["doc_id"]] for r in rows], expected, atol=1e-6)


def test_clashing_columns_are_ignored(spark):
    plain = make(spark, [(i, f"some words {i} here", "s") for i in range(30)])
    docs = plain
    for n in ("x", "label", "score", "tie", "salt", "shard", "ids", "content", "fp", "held_out", "piece", "bin"):
        docs = docs.withColumn(n, F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2, "mine") for i in range(30)], "doc_id long, quality int, x string")
    assert c.classify(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"] and c.classify(docs, labels).count() == 30
    assert sorted(t.round_trip(spark, docs).collect()) == sorted(t.round_trip(spark, plain).collect())
    pieces = lambda d: sorted(map(tuple, packing.pack_documents(d).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert pieces(docs) == pieces(plain)


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_classifier_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    rows = c.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert c.classify(empty, labels).count() == 0
    many = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    assert all(np.isfinite(r["score"]) for r in c.classify(awkward, many).collect())


def brute_top(rows, queries, k, others=None):
    """``queries``: which rows ask; or, with ``others``, the rows that ask of another table."""
    usable = lambda i, v: i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ints = lambda v: np.floor(256 * np.array(v, float)).astype(np.int64)
    ok = [(i, ints(v)) for i, v in rows if usable(i, v)]
    asking = [(n, i, v) for n, (i, v) in enumerate(ok) if i in queries] if others is None else [(-1, i, ints(v)) for i, v in others if usable(i, v)]
    out = []
    for at, qi, q in asking:
        scored = sorted((-int(q @ v), i) for n, (i, v) in enumerate(ok) if n != at and len(v) == len(q))
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(
    ("held", "group", "block", "tile", "fan"), [(64 << 20, 262_144, 2048, 512, 16), (200, 7, 3, 4, 2), (64, 1000, 4, 1, 2)]
)
def test_top_k_against_brute_force(spark, monkeypatch, held, group, block, tile, fan):
    for n, v in (("QUERY_BYTES", held), ("GROUP", group), ("BLOCK", block), ("TILE", tile), ("FAN_IN", fan)):
        monkeypatch.setattr(e, n, v)
    rng = np.random.default_rng(1)
    same = [0.5] * 8
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, same) for i in range(30)] + [(400, [1.0, 2.0]), (450, [0.5, 0.5]), (500, None), (None, same), (550, [None, 1.0]), (600, [float("nan")] * 8), (650, [float("inf")] + same[1:])]
    rows += [(50, same), (50, [-0.5] * 8), (100, same), (7, same), (700, []), (750, []), (200, same)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, row int")
    got = sorted(tuple(r) for r in e.search_embeddings(df).collect())
    assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert e.search_embeddings(df.limit(0)).count() == 0
    others = [(7, same), (7, rows[0][1]), (None, same), (8, [1.0, 1.0])]
    asked = spark.createDataFrame(others, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in e.top_k(df, asked, 3).collect()) == brute_top(rows, (), 3, others)


def test_rows_that_share_an_id_are_each_others_candidates(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, e.search_embeddings(df).collect())) == [(50, 1, 50, 0), (50, 1, 50, 0)]


def test_grid_bounds_what_a_query_is_sent_to():
    assert e.grid(20_000_000, 1_000_000_000, 128, 8000) == (306, 3815)
    assert e.grid(0, 0, 0, 8) == (1, 1)


def test_products_beyond_53_bits_stay_exact():
    a = np.array([[2**31, 1]], np.int64)
    assert e.products(a, a)[0, 0] == 2**62 + 1
