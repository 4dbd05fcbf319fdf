import random

import pytest

from passagework.operators import provenance as p


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_ranges_meet_as_in_brute_force(spark, width):
    rng = random.Random(width)
    made = lambda n, tag: [(rng.choice("ab"), a := rng.randrange(60), a + rng.choice([0, 1, 5, 30]), f"{tag}{i}") for i in range(n)]
    a, b = made(50, "x") + [("a", None, 3, "none"), (None, 0, 9, "key")], made(40, "y") + [("a", 1, None, "none"), (None, 0, 9, "key")]
    left, right = (spark.createDataFrame(r, f"k string, start long, stop long, {n} string") for r, n in ((a, "x"), (b, "y")))
    got = sorted((r["x"], r["y"]) for r in p.overlapping(left, right, "k", width).collect())
    real = lambda r: None not in r and r[1] < r[2]
    assert got == sorted((i[3], j[3]) for i in a for j in b if real(i) and real(j) and i[0] == j[0] and max(i[1], j[1]) < min(i[2], j[2]))


def test_pages_cover_the_text(spark):
    texts = ["", None, "one", "a\nb\n\n", "\n".join(f"line {i}" for i in range(100)), "é😀\n" * 25, "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pages = {}
    for r in p.page_ranges(docs).orderBy("doc_id", "page").collect():
        pages.setdefault(r["doc_id"], []).append(r)
    assert set(pages) == {i for i, t in enumerate(texts) if t}
    for i, found in pages.items():
        lines = texts[i].split("\n")
        assert found[0]["start"] == 0 and found[-1]["stop"] == len(texts[i]) + 1
        assert all(a["stop"] == b["start"] for a, b in zip(found, found[1:], strict=False))
        for r in found:
            assert (texts[i] + "\n")[r["start"] : r["stop"]] == "".join(x + "\n" for x in lines[r["page"] * p.LINES : (r["page"] + 1) * p.LINES])
            assert r["heading"] == lines[r["page"] * p.LINES][: p.HEADING]


def test_every_chunk_has_its_pages(spark):
    pages = spark.createDataFrame([(1, 0, "h0", 0, 50), (1, 1, "h1", 50, 90), (1, 2, "h2", 90, 91)], "doc_id long, page long, heading string, start long, stop long")
    chunks = spark.createDataFrame([(1, "a", 0, 50), (1, "b", 49, 51), (1, "c", 60, 91), (2, "d", 0, 9)], "doc_id long, chunk_id string, start long, stop long")
    got = {r["chunk_id"]: (r["first_page"], r["last_page"], r["heading"]) for r in p.located(chunks, pages).collect()}
    assert got == {"a": (0, 0, "h0"), "b": (0, 1, "h0"), "c": (1, 2, "h1")}


def test_meets_by_equality(spark):
    d = spark.range(10).selectExpr("id as k", "id as start", "id + 5 as stop", "id as x")
    plan = p.overlapping(d, d.withColumnRenamed("x", "y"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
