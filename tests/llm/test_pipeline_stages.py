"""Each stage's exact rows against brute force, and the whole run against its stages."""

import math
import re
from collections import Counter

import corpus_pipeline as p
import pytest
from test_packing import check
from test_quality_rules import brute as measures
from test_secret_scan import brute as spans
from test_sharding_mixing import water
from test_simhash_dedup import brute_components, brute_print

from passagework.llm import secret_scan


@pytest.fixture(scope="module")
def planted(spark, data, tmp_path_factory):
    """The documents of sf0.001, some with secrets, and copies of some."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    secrets = [' token = "abcdefgh1234" end', " AKIA" + "Q" * 16, " x " + "0f" * 20 + " password: " + "ab" * 20]
    out = []
    for k, r in enumerate(docs.orderBy("doc_id").collect()):
        text = r["text"] + secrets[k % 3] if r["text"] and k % 5 == 0 else r["text"]
        out.append({**r.asDict(), "text": text, "n_chars": len(text or "")})
        if k % 7 == 0:
            out.append({**out[-1], "doc_id": 10**9 + k})
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([tuple(r.values()) for r in out], docs.schema).write.parquet(f"{folder}/documents.parquet")
    return folder


def clean(text):
    n, chars, symbols, upper, lines, dup, repeat = measures(text)
    return not (
        n < 50 or 100 * repeat > 50 * n or 100 * symbols > 50 * n or 10 * dup > 5 * lines or chars < 2 * n or chars > 20 * n
        or 10 * upper > 5 * chars
    )


def masked(text):
    out, at = [], 0
    for start, _, end, _ in spans(text, secret_scan.RULES):
        if end > at:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = end
    return "".join(out) + text[at:]


def stages_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    again = lambda df: spark.createDataFrame(df.collect(), df.schema)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    kept = again(p.quality(spark, docs, data))
    expected = [r for r in docs.orderBy("doc_id").collect() if clean(r["text"])]
    assert 0 < len(expected) < docs.count()
    assert rows(kept) == Counter(map(tuple, expected))
    label = brute_components([brute_print(r["text"]) for r in expected])
    assert len(set(label)) < len(label)
    expected = [expected[k] for k in sorted(set(label))]
    once = again(p.near_duplicates(spark, kept, data))
    assert rows(once) == Counter(map(tuple, expected))
    safe = again(p.secrets(spark, once, data))
    texts = {r["doc_id"]: masked(r["text"]) for r in expected}
    assert any("[SECRET]" in t for t in texts.values())
    assert rows(safe) == Counter(tuple({**r.asDict(), "text": (t := texts[r["doc_id"]]), "n_chars": len(t)}.values()) for r in expected)
    mixed = again(p.mixing_weights(spark, safe, data))
    whole = {r["doc_id"]: r for r in safe.collect()}
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for d, r in whole.items()}
    sizes, taken = Counter(), Counter()
    for d, r in whole.items():
        sizes[r["source"]] += words[d]
    goal = water(sizes)
    assert set(rows(mixed)) <= set(rows(safe))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for d, r in whole.items():
        share = goal[r["source"]] / sizes[r["source"]]
        assert math.floor(share + 1e-9) <= copies[d] <= math.ceil(share - 1e-9), d
        taken[r["source"]] += copies[d] * words[d]
    assert all(abs(taken[s] - goal[s]) <= max(words.values()) for s in goal)
    packed = p.run(spark, data).collect()
    used, bound = check(mixed, packed, 1024)
    assert used <= bound * 1.05 + 1
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, packed)) == Counter(map(piece, p.pack(spark, mixed, data).collect()))


def test_stages_against_brute_force(spark, planted):
    stages_agree(spark, planted)


def test_a_stage_that_drops_or_leaves_rows_is_noticed(spark, planted, monkeypatch):
    for stage, wrong in (
        ("quality", lambda s, docs, d: p.quality_rules.filtered(docs, "v1").where("false")),
        ("secrets", lambda s, docs, d: docs),
        ("mixing_weights", lambda s, docs, d: docs),
    ):
        with monkeypatch.context() as m, pytest.raises(AssertionError):
            m.setattr(p, stage, wrong)
            stages_agree(spark, planted)
