from passagework.functions.text import page_corrupted
from passagework.sources.providers import embed, extract_pages, in_batches, needs_ocr, relevance


def test_pages_errors_and_ranges(spark):
    files = spark.createDataFrame([("a", b"p0\fp1\fp2\fp3\fp4"), ("bad", b"\xff\fx"), ("none", None)], "path string, content binary")
    rows = {(r["path"], r["page"]): (r["content"], r["error"]) for r in extract_pages(files, batch=2).collect()}
    assert [rows["a", i][0] for i in range(5)] == ["p0", "p1", "p2", "p3", "p4"]
    assert rows["bad", 0][0] is None and "UnicodeDecodeError" in rows["bad", 0][1]
    assert rows["none", 0] == ("", None)


def test_pages_of_one_file_use_every_task(spark):
    pages = [f"page {i}" for i in range(1000)]
    files = spark.createDataFrame([("big", "\f".join(pages).encode())], "path string, content binary")

    def parser(content, n):
        if b"page 401" in content:
            raise ValueError("no")
        return content.decode().split("\f")

    found = extract_pages(files, parser, tasks=8).selectExpr("*", "spark_partition_id() as task").collect()
    assert len({r["task"] for r in found}) == 8
    by_page = {r["page"]: r for r in found}
    assert sorted(by_page) == list(range(1000)) and len(found) == 1000
    assert [i for i in range(1000) if by_page[i]["error"]] == [400, 401, 402, 403]
    assert all(by_page[i]["content"] == pages[i] for i in range(1000) if not 400 <= i < 404)


def test_files_that_cannot_be_cut(spark):
    files = spark.createDataFrame([("late", b"late"), ("never", b"never"), ("ok", b"a")], "path string, content binary")

    def cut(content, batch):
        if content == b"never":
            raise OSError("never")
        yield 0, 1, content
        if content == b"late":
            raise OSError("late")

    found = sorted((r["path"], r["page"], r["content"], r["error"]) for r in extract_pages(files, cut=cut).na.fill({"page": -1}).collect())
    assert found == [("late", -1, None, "OSError: late"), ("late", 0, "late", None), ("never", -1, None, "OSError: never"), ("ok", 0, "a", None)]
    assert extract_pages(files.limit(0)).count() == 0


def test_failed_embeddings_leave_their_rows_out(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "boom"), (3, "y"), (4, None)], "id int, text string")

    def model(texts):
        if "boom" in texts:
            raise ValueError("boom")
        return [[float(len(t))] for t in texts]

    assert sorted(r["id"] for r in embed(rows, model).collect()) == [1, 3]
    assert embed(rows.limit(0), model).count() == 0


def test_batches_are_tried_value_by_value():
    seen = []

    def model(values):
        seen.append(list(values))
        if 3 in values:
            raise ValueError("3")
        return [v * 10 for v in values]

    assert in_batches(model, [1, None, 2, 3, 4], 2) == [10, None, 20, None, 40]
    assert seen == [[1, 2], [3, 4], [3], [3], [4]]
    assert in_batches(lambda v: v[:1], [1, 2], 2) == [1, 2] and in_batches(model, [], 2) == []


def test_pairs_are_cut_and_failures_have_no_score(spark):
    rows = [(1, "a b", "x " * 600), (2, "a", None), (3, "boom", "y"), (4, "c " * 700, "z")]

    def model(pairs):
        if any(q == "boom" for q, _ in pairs):
            raise ValueError("boom")
        return [float(len(q.split()) * 1000 + len(t.split())) for q, t in pairs]

    df = spark.createDataFrame(rows, "id int, q string, t string").coalesce(1)
    found = {r["id"]: r["s"] for r in df.select("id", relevance(df["q"], df["t"], model).alias("s")).collect()}
    assert found == {1: 2510.0, 2: None, 3: None, 4: 512000.0}


def test_reroute_to_ocr(spark):
    rows = [("ok", 0, "The court and the police of the state. " * 3), ("odd", 0, "ÐÑÒÓ×ØÙÚÛ" * 20), ("blank", 0, " ")]
    pages = spark.createDataFrame(rows, "path string, page int, content string")
    got = {r["path"]: r["needs_ocr"] for r in needs_ocr(pages, page_corrupted).collect()}
    assert got == {"ok": False, "odd": True, "blank": True}
