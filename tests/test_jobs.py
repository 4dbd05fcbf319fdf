"""The jobs over growing copies of the tables, and after interruptions."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import same_rows

import __spark_entry__ as entry
from jobs import answer_questions, ingest_corpus
from jobs import queries as jobs
from passagework.operators.term_index import TermIndex

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_job_agrees_with_sql(spark, data, name):
    assert entry.queries()[name] is jobs.QUERIES[name]
    same_rows(spark, data, jobs.QUERIES[name], jobs.SQL[name])


def test_ingestion_of_growing_input(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    run = lambda: ingest_corpus.run(spark, source, out, mark, ingest_corpus.DEFAULTS | {"files_per_batch": 1})
    docs.where("doc_id % 3 = 0").coalesce(1).write.parquet(source)
    first = run()
    assert first["rows_read"] == first["documents_written"] == docs.where("doc_id % 3 = 0").count()
    assert run() == {"batches": 0, "rows_read": 0, "documents_written": 0, "chunks_written": 0}
    kept = rows(ingest_corpus.chunks(spark, out))
    files = {f: f.stat().st_mtime_ns for f in Path(out).rglob("*.parquet")}
    docs.where("doc_id % 3 <> 2").coalesce(1).write.mode("append").parquet(source)  # a third of them again
    second = run()
    assert second["rows_read"] == docs.where("doc_id % 3 <> 2").count() and second["documents_written"] == docs.where("doc_id % 3 = 1").count()
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())  # what was there isn't touched
    assert set(kept) < set(rows(ingest_corpus.chunks(spark, out)))
    docs.where("doc_id % 3 = 2").repartition(3).write.mode("append").parquet(source)
    run()
    ingest_corpus.run(spark, f"{data}/documents.parquet", str(tmp_path / "whole"), str(tmp_path / "whole-mark"))
    for read in (ingest_corpus.chunks, ingest_corpus.documents):
        assert rows(read(spark, out).drop("batch")) == rows(read(spark, str(tmp_path / "whole")).drop("batch"))


def test_ingestion_cut_off_in_a_batch(spark, data, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs.repartition(4).write.parquet(source)
    config = ingest_corpus.DEFAULTS | {"files_per_batch": 1}
    write, calls = ingest_corpus.write_batch, []

    def failing(df, path, batch, *by):
        calls.append(batch)
        write(df, path, batch, *by)
        if len(calls) == 3:  # the second batch's chunks are written, its documents aren't
            raise OSError("cut off")

    monkeypatch.setattr(ingest_corpus, "write_batch", failing)
    with pytest.raises(Exception, match="cut off"):
        ingest_corpus.run(spark, source, out, mark, config)
    assert ingest_corpus.documents(spark, out).select("batch").distinct().count() == 1
    told = ingest_corpus.run(spark, source, out, mark, config)
    assert told["batches"] == 3 and calls[:4] == [0, 0, 1, 1]
    ingest_corpus.run(spark, source, str(tmp_path / "whole"), str(tmp_path / "whole-mark"))
    for read in (ingest_corpus.chunks, ingest_corpus.documents):
        assert rows(read(spark, out).drop("batch")) == rows(read(spark, str(tmp_path / "whole")).drop("batch"))


def test_ingestion_of_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, batch int"
    given = [(1, None, "en", "s", 1), (2, "", None, "s", 1), (3, "x" * 39, "", None, 1), (4, "y" * 40, "de", "s", 1), (None, "z" * 90, "en", "s", 1),
             (5, "qq rr " * 40, "en", "s", 2), (5, "qq rr " * 40, "en", "s", 2), (5, "b" * 60, "fr", "s", 2), (6, "long " * 100_000, "fr", "s", 3)]
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = ingest_corpus.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert told["rows_read"] == 9 and told["documents_written"] == 6
    got = {r["doc_id"]: (r["status"], r["lang"], r["n_chunks"]) for r in ingest_corpus.documents(spark, str(tmp_path / "out")).collect()}
    assert got == {1: ("empty", "en", 0), 2: ("empty", None, 0), 3: ("short", "", 0), 4: ("ready", "de", 1), 5: ("ready", "fr", 1), 6: ("ready", "fr", 589)}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert ingest_corpus.run(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "m"))["documents_written"] == 0
    assert ingest_corpus.documents(spark, str(tmp_path / "o")).count() == 0


def test_answers_over_growing_documents(spark, data, tmp_path):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), str(tmp_path / "out")
    docs.where("doc_id % 2 = 0").write.parquet(str(tmp_path / "docs"))
    run = lambda: answer_questions.run(spark, str(tmp_path / "docs"), f"{data}/benchmark.parquet", out)
    assert run()["documents_added"] == docs.where("doc_id % 2 = 0").count()
    kept = rows(answer_questions.answers(spark, out))
    assert run()["documents_added"] == 0 and rows(answer_questions.answers(spark, out)) == kept
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(str(tmp_path / "docs"))
    assert run()["documents_added"] == docs.where("doc_id % 2 = 1").count()
    assert TermIndex(spark, f"{out}/index").batches() == [0, 1]
    answer_questions.run(spark, f"{data}/documents.parquet", f"{data}/benchmark.parquet", str(tmp_path / "whole"))
    assert rows(answer_questions.answers(spark, out)) == rows(answer_questions.answers(spark, str(tmp_path / "whole")))
    answer_questions.run(spark, str(tmp_path / "docs"), f"{data}/benchmark.parquet", out, answer_questions.DEFAULTS | {"label": "two", "kept": 1})
    by = {r["label"]: r["count"] for r in answer_questions.answers(spark, out).groupBy("label").count().collect()}
    assert by["two"] < by["all"] and spark.read.parquet(f"{out}/summary").where("label = 'two'").count() > 0


def test_refused_questions_keep_their_rows(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    asked = [(1, "what is alpha"), (2, ""), (3, None), (4, "hello"), (5, "omega"), (None, "alpha"), (6, "x" * 3001), (1, "zeta")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "q"))
    told = answer_questions.run(spark, str(tmp_path / "d"), str(tmp_path / "q"), str(tmp_path / "o"))
    got = {r["query_id"]: (r["status"], r["route"], r["id"]) for r in answer_questions.answers(spark, str(tmp_path / "o")).collect()}
    assert told["rows_written"] == 6 and told["documents_found"] == 1
    assert got == {1: (200, "rag", 1), 2: (400, "rag", None), 3: (400, "rag", None), 4: (200, "general_chat", None), 5: (200, "rag", None), 6: (400, "rag", None)}


def test_command_line(data, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"size": 500, "overlap": 50}))
    made = subprocess.run(
        [sys.executable, str(ROOT / "jobs/ingest_corpus.py"), "--source", f"{data}/documents.parquet", "--output", str(tmp_path / "o"),
         "--checkpoint", str(tmp_path / "c"), "--config", str(tmp_path / "c.json")], capture_output=True, text=True, timeout=300,
    )
    assert made.returncode == 0, made.stderr[-2000:]
    assert "wrote 200 documents" in made.stderr and list((tmp_path / "o/chunks/batch=0").glob("lang=*"))


def test_jobs_import_nothing_of_the_training_operators():
    code = "import sys, jobs.queries, jobs.ingest_corpus, jobs.answer_questions; assert not [m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=100).returncode == 0


def test_questions_are_searched_once(spark, tmp_path, monkeypatch):
    """What the index finds is kept, since it is used several times."""
    rows = [(i, f"alpha w{i % 3} beta", "s") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/d")
    spark.createDataFrame([(1, "alpha w1"), (2, "w2")], "item_id long, text string").write.parquet(f"file://{tmp_path}/q")
    plans, kept = [], answer_questions.staged
    monkeypatch.setattr(answer_questions, "staged", lambda df, name: plans.append(df) or kept(df, name))
    answer_questions.run(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/q", f"file://{tmp_path}/out")
    assert len(plans) == 1
    assert answer_questions.answers(spark, f"file://{tmp_path}/out").where("id is not null").count() == 8
