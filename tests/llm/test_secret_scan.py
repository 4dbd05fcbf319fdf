import hashlib
import re

import pytest
from llm_rows import make

from passagework.llm import secret_scan as s


def brute(text, rules):
    out = []
    for place, r in enumerate(rules):
        out += [(m.start(), place, m.end(), r.kind) for m in re.finditer(r.regex, text, re.ASCII) if len(m[r.group]) >= r.least]
    return sorted(out)


TEXTS = [
    None, "", "token:secret:abcdefghij", 'API_KEY = "abcdefgh"', "PassWord=short", "password : 'longenough1' passwd=x secret=abcdefghijk",
    "AKIAAKIA" + "B" * 20, "AKIA" + "C" * 11, "AKIA" + "C" * 12, "f" * 31, "f" * 32, "😀é " + "0123456789abcdef" * 3, "token=" + "ab" * 20,
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-abc", "sk_live_" + "9" * 16, "AIza" + "b" * 35,
    "eyJ" + "a" * 20 + ".eyJ" + "b" * 20, "secret=abcdefgh " * 300, "x " * 5000 + "apikey:12345678", "a" * 40 + "g" + "b" * 40,
]


def test_spans_against_brute_force(spark, empty):
    docs = make(spark, [(i if i % 7 else None, t, "s") for i, t in enumerate(TEXTS)] * 2)
    expected = []
    for i, t in enumerate(TEXTS):
        spans = brute(t or "", s.RULES)
        say = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in x)
        base = say([x for x in spans if x[3] in s.BASE])
        counts = [sum(x[3] == k for x in spans) for k in s.BASE]
        expected.append((str(i if i % 7 else None), *counts, hashlib.sha256(base.encode()).hexdigest(), say(spans)))
    got = sorted((str(r[0]), *r[1:]) for r in s.secret_spans(docs).collect())
    assert got == sorted(expected * 2)
    assert s.secret_spans(empty).count() == 0


def test_candidates_are_joined_at_any_number(spark):
    docs = make(spark, [(i if i % 3 else None, t, "s") for i, t in enumerate(TEXTS * 3)])
    few = sorted(map(str, s.secret_spans(docs).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = s.secret_spans(docs)
        assert sorted(map(str, found.collect())) == few
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_intersect_at_the_texts_that_satisfy_a_query(spark):
    docs = make(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    keys = {r["k"]: (r["text"] or "").lower() for r in docs.withColumn("k", s._key(docs, "doc_id", "text")).collect()}
    expected = {}
    for key, t in keys.items():
        bits = sum(1 << k for k, r in enumerate(s.RULES) if (q := s.trigram_query(r.regex)) and any(all(x in t for x in c) for c in q))
        if bits:
            expected[key] = bits
    assert {r["key"]: r["rules"] for r in s.candidates(s.build_index(docs)).collect()} == expected
    terms = s.vocabulary()
    assert all(terms[r["term"]] in keys[r["key"]] for r in s.build_index(docs).collect())


def test_clashing_names_and_empty_table(spark, empty):
    docs = make(spark, [(1, "token=abcdefgh1 x", "s")])
    for name in ("key", "rules", "found", "row", "_text"):
        docs = docs.withColumn(name, docs["lang"])
    assert [r.asDict()["found"] for r in s.redacted(docs).collect()] == ["en"] and s.redacted(docs).columns == docs.columns
    assert s.secret_spans(docs).first()["n_assign"] == 1
    assert s.redacted(empty).count() == 0


def masked(text):
    out, at = [], 0
    for a, _, b, _ in brute(text, s.RULES):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_many_secrets_in_a_long_text_cost_in_proportion(spark):
    import time

    def seconds(n):
        text = "".join(f"é token=abcdefgh{i:06d} {'0f' * 20} and " for i in range(n))
        docs = make(spark, [(1, text, "s")])
        began = time.perf_counter()
        assert s.redacted(docs).first()["text"] == masked(text)
        assert s.secret_spans(docs).first()["spans"].count(",") == len(brute(text, s.RULES)) - 1
        return time.perf_counter() - began

    seconds(10)
    a, b = seconds(2_000), seconds(16_000)
    assert b < 16 * a + 5


@pytest.mark.parametrize(
    ("regex", "expected"),
    [
        ("abcd", [{"abc", "bcd"}]), ("ab", None), ("[0-9a-f]+", None), ("AKIA[A-Z0-9]+", [{"aki", "kia"}]),
        ("foo|quux", [{"foo"}, {"quu", "uux"}]), ("api_?key", [{"api", "pi_", "i_k", "_ke", "key"}, {"api", "pik", "ike", "key"}]),
        ("(foo)?bar", [{"bar"}]), ("(foo)*bar", [{"bar"}]), ("a.c", None), ("foo.*bar", [{"foo", "bar"}]),
    ],
)
def test_trigram_queries(regex, expected):
    got = s.trigram_query(regex)
    assert (got and {frozenset(x) for x in got}) == (expected and {frozenset(x) for x in expected})


def test_every_match_passes_its_query():
    for t in filter(None, TEXTS):
        for r in s.RULES:
            query = s.trigram_query(r.regex)
            for m in re.finditer(r.regex, t):
                assert query is None or any(all(x in m[0].lower() for x in c) for c in query)


def test_redacted(spark):
    docs = make(spark, [(1, "a token=abcdefgh1 é " + "0f" * 20 + " end", "s"), (2, None, "s"), (3, "clean", "s")])
    got = {r["doc_id"]: r["text"] for r in s.redacted(docs).collect()}
    assert got == {1: "a [SECRET] é [SECRET] end", 2: None, 3: "clean"}
    assert s.redacted(docs).columns == docs.columns


@pytest.mark.parametrize("cut", [3, 1024])
def test_masks_against_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(s, "CUT", cut)
    monkeypatch.setattr(s, "STEP", cut)
    texts = [*filter(None, TEXTS), "token=" + "0f" * 20 + "secret=" + "1a" * 20, "\n😀token=abcdefgh1\n\n" + "0f" * 20]
    docs = make(spark, list(zip(range(len(texts)), texts, "s" * len(texts), strict=True)))
    assert {r["doc_id"]: r["text"] for r in s.redacted(docs).collect()} == {i: masked(t) for i, t in enumerate(texts)}
