"""The rules on the texts of FIXTURES.md and on edge cases."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from passagework.functions import ids, text
from passagework.operators import chunk, context, retrieve, understand
from passagework.sources.tables import path_language, read_chunks, upsert


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("a\n 12 \nb", "a b"), ("sec-\ntion", "section"), ("ﬁ’s x—y", "fi's x-y"), (None, "Unknown"), ("", "")],
)
def test_clean(spark, given, expected):
    assert one(spark, text.clean(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("1.2. Arrest", "arrest"), ("iv. Bail", "bail"), ("- Notes", "notes"), ("1.2 Arrest", "2 arrest"), ("mix. Foo", "foo"), (None, "unknown")],
)
def test_heading(spark, given, expected):
    assert one(spark, text.clean_heading(F.col("t")), t=given) == expected


def test_key_terms(spark):
    got = one(spark, text.key_terms(F.col("t")), t="What is the Dowry Prohibition Act?")
    assert got == ["act", "dowry", "dowry prohibition act", "prohibition", "what"]
    assert one(spark, text.key_terms(F.col("t")), t="how many years") == []


@pytest.mark.parametrize(
    ("question", "language", "route", "kind"),
    [
        ("Hi", "English", "general_chat", "factual"),
        ("What is criminology?", "English", "rag", "factual"),
        ("criminology ante enti?", "Telugu", "rag", "factual"),
        ("నమస్కారం", "Telugu", "general_chat", "factual"),
        ("hi police", "English", "rag", "factual"),
        ("show me the rules", "English", "rag", "explanatory"),
        ("hello " + 40 * "x", "English", "rag", "factual"),
        ("ñela", "English", "rag", "factual"),
    ],
)
def test_understanding(spark, question, language, route, kind):
    got = one(spark, F.struct(understand.language(F.col("t")), understand.route(F.col("t")), understand.query_type(F.col("t"))), t=question)
    assert tuple(got) == (language, route, kind)


@pytest.mark.parametrize(("given", "status"), [("", 400), ("  ", 400), (3000 * "x", 200), (3001 * "x", 400), (None, 400)])
def test_validation(spark, given, status):
    assert one(spark, understand.validated(F.col("t"))[0], t=given) == status


def test_ids(spark):
    assert one(spark, ids.doc_key(F.col("a"), F.col("b")), a="Acts", b="Dowry.pdf") == "f7d4a06b3e7d"
    assert one(spark, ids.uuid5(F.col("a")), a="f7d4a06b3e7d-0000") == "278e16cd-442d-5c4d-9949-5fb3a81228b5"
    names = [f"n{i}" for i in range(60)]
    got = spark.createDataFrame([(n,) for n in names], "a string").select("a", ids.uuid5(F.col("a")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["a"])) for r in got)
    assert spark.range(1).select(ids.chunk_id(F.lit("d"), F.lit(12345))).first()[0] == "d-12345"


def test_ascii_fold(spark):
    t = "ﬁancé — Ünï"
    assert one(spark, text.ascii_fold(F.col("t")), t=t) == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()


def test_boilerplate_and_headings(spark):
    t = "a\nPage 3 of 9\n\n\n\n17\nReferences\nb"
    assert one(spark, text.strip_boilerplate(F.col("t")), t=t) == "a\n\nb"
    t = "CHAPTER - IV Bail\nSec. 12. Arrest\nmodule II x"
    assert one(spark, text.promote_headings(F.col("t")), t=t) == "# CHAPTER - IV Bail\n## Sec. 12. Arrest\n# module II x"


def test_rrf_and_ties(spark):
    dense = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, id string, rank long")
    sparse = spark.createDataFrame([(1, "B", 1), (1, "A", 2)], "query_id int, id string, rank long")
    got = retrieve.rrf(dense, sparse).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["A", "B"]
    assert got[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_windows_cover_text_and_links_meet(spark):
    t = "".join(chr(97 + i % 26) for i in range(4321))
    docs = spark.createDataFrame([(1, t, "en", "s"), (2, "", "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string")
    rows = chunk.linked(chunk.numbered(chunk.fixed(docs))).orderBy("idx").collect()
    assert rows[0]["chunk"] + "".join(r["chunk"][150:] for r in rows[1:]) == t
    assert [r["next_chunk_id"] for r in rows[:-1]] == [r["chunk_id"] for r in rows[1:]]
    assert (rows[0]["prev_chunk_id"], rows[-1]["next_chunk_id"]) == ("", "")


def test_chunkers(spark):
    t = "\n\n".join(" ".join(f"Word{i}x{j} goes on." for j in range(40)) for i in range(6))
    parts = chunk.split_text(t)
    assert all(len(p) <= 1000 for p in parts) and "".join(parts).replace(" ", "")[:50] == t.replace(" ", "")[:50]
    merged = one(spark, chunk.merged(F.col("t")), t=t)
    assert merged and all(200 <= len(p) <= 2000 for p in merged)
    assert chunk.split_text("") == [] and one(spark, chunk.merged(F.col("t")), t="") == []


def test_citation_defaults(spark):
    got = one(spark, F.struct(*context.citation(F.col("a"), F.col("b"), F.col("c"))), a=None, b=None, c=400 * "x")
    assert tuple(got) == ("Unknown", "?", 300 * "x")


def test_upsert_twice_adds_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    once = upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new, "id").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_chunk_files_in_both_forms(spark, tmp_path):
    row = '{"page_content": "x", "metadata": {"doc_id": "d", "page": 3}}'
    (tmp_path / "a.json").write_text(f"[{row}, {row}]")
    (tmp_path / "b.json").write_text(f"{row}\n{row}\n")
    assert read_chunks(spark, str(tmp_path / "a.json")).select("metadata.page").collect() == [("3",)] * 2
    assert read_chunks(spark, str(tmp_path / "b.json"), lines=True).count() == 2


def test_path_language(spark):
    assert one(spark, path_language(F.col("p")), p="x\\english\\a.pdf") == "english"
    assert one(spark, path_language(F.col("p")), p="/x/englishes/a.pdf") is None
