import json

from pyspark.sql import functions as F

from passagework.operators import stages, understand
from passagework.sources.tables import chunk_forms, outputs, raw_files, read_chunks, write_chunks


def record(i):
    return {"page_content": f"text {i}", "metadata": {"doc_id": "d", "chunk_id": f"d-{i:04d}", "chunk_index": i}}


def test_each_files_form_is_told(spark, tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([record(0), record(1)], indent=2))
    (folder / "b.jsonl").write_text("\n\n".join(json.dumps(record(i)) for i in (2, 3)) + "\n")
    (folder / "c.json").write_text(json.dumps([record(4), record(5)]) + "\n" + json.dumps([record(6)]))
    (folder / "d.json").write_text("[\n" + ",\n".join(json.dumps(record(i)) for i in (7, 8)) + "\n]")
    (folder / "e.json").write_text(json.dumps([record(9)], ensure_ascii=True).replace("text", "\\u0c05"))
    (folder / "f.json").write_text("")
    (folder / "g.json").write_text("[]")
    forms = {r["file"][-6:]: r["lines"] for r in chunk_forms(spark, f"file://{folder}").collect()}
    assert forms == {"a.json": False, ".jsonl": True, "c.json": True, "d.json": False, "e.json": True, "g.json": True}
    rows = read_chunks(spark, f"file://{folder}").orderBy("file", "pos").collect()
    assert [r["metadata"]["chunk_index"] for r in rows] == list(range(10))
    assert [r["pos"] for r in rows] == [1, 2, 1, 2, 1, 2, 3, 1, 2, 1]
    assert rows[9]["page_content"] == "అ 9" and rows[0]["size"] == (folder / "a.json").stat().st_size


def test_sizes_of_outputs(spark, tmp_path):
    for n in (999, 1000, 1001):
        (tmp_path / f"{n}.md").write_bytes(b"x" * n)
    found = outputs(spark, f"file://{tmp_path}", "*.md")
    wanted = spark.createDataFrame([("999",), ("1000",), ("1001",), ("new",)], "name string")
    met = wanted.join(found.withColumn("name", F.regexp_extract("path", r"(\w+)\.md$", 1)), "name", "left")
    assert {r[0]: r[1] for r in met.select("name", understand.output_action(F.col("size"))).collect()} == {"999": "remake", "1000": "remake", "1001": "skip", "new": "make"}
    assert outputs(spark, f"file://{tmp_path}/none").count() == 0


def test_raw_files_of_a_tree(spark, tmp_path):
    for name in ("english/law/b.pdf", "telugu/tax/a.pdf", "other/c.txt", "c.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    rows = raw_files(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r["filename"], r["language"]) for r in rows] == [("c.pdf", None), ("b.pdf", "english"), ("a.pdf", "telugu")]
    assert [r["subject"] for r in rows[1:]] == ["law", "tax"]


def test_stages_count_failures_and_empty_tables(spark, tmp_path):
    for n, rows in enumerate(([(1, "a"), (2, None), (None, "b")], [])):
        seen = stages.Stages(spark)
        df = seen.watch(spark.createDataFrame(rows, "id int, text string"), "read", F.col("text").isNull())
        seen.watch(df.where("id is not null"), "keyed", F.length("text") > 5).write.parquet(f"file://{tmp_path}/{n}")
        assert [tuple(r) for r in seen.counts().orderBy("pos").collect()] == [(0, "read", len(rows), 1 if rows else 0), (1, "keyed", 2 if rows else 0, 0)]


def test_array_files_hold_many_documents(spark, tmp_path):
    """Files don't grow in number with the documents; a document's chunks stay in order."""
    rows = [{"page_content": f"a\n{d} {i}", "metadata": {"doc_id": f"d{d}", "chunk_id": f"d{d}-{i:04d}", "chunk_index": i}} for d in range(60) for i in (2, 0, 1)]
    chunks = spark.createDataFrame(rows, "page_content string, metadata struct<doc_id string, chunk_id string, chunk_index int>")
    for each, most in ((20, 3), (1, 60)):
        path = f"{tmp_path}/{each}"
        write_chunks(chunks, f"file://{path}/arrays", each=each)
        write_chunks(chunks, f"file://{path}/lines")
        files = chunk_forms(spark, f"file://{path}").groupBy("lines").count().collect()
        assert {r["lines"]: r["count"] for r in files}[False] <= most
        found = read_chunks(spark, f"file://{path}")
        seen = {}
        for r in found.orderBy("file", "pos").collect():
            assert r["page_content"] == f"a\n{r['metadata']['doc_id'][1:]} {r['metadata']['chunk_index']}"
            seen.setdefault((r["file"], r["metadata"]["doc_id"]), []).append(r["metadata"]["chunk_index"])
        assert len(seen) == 120 and set(map(tuple, seen.values())) == {(0, 1, 2)}
