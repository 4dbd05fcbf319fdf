import pytest

from passagework.operators import retrieve, term_index
from passagework.operators.term_index import TermIndex
from passagework.plans.retrieval_queries import asked
from passagework.plans.text_queries import _docs


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("idf", [False, True])
def test_same_rows_as_a_scan(spark, data, tmp_path, monkeypatch, idf):
    monkeypatch.setattr(term_index, "BLOCK", 16)
    docs, q = _docs(spark, data).repartition(5), asked(spark, data)
    index = TermIndex(spark, str(tmp_path / "ix"), buckets=7)
    assert index.add(docs.where("doc_id % 3 <> 1")) > 0
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "ix").rglob("*.parquet")}
    assert index.add(docs) == docs.where("doc_id % 3 = 1").count() and index.add(docs) == 0
    assert all(f.stat().st_mtime_ns == t for f, t in files.items()) and index.batches() == [0, 1]
    found = index.search(q, 10, idf)
    assert rows(found) == rows(retrieve.sparse(q, docs, 10, idf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "bucket" in plan


def test_blocks_that_cannot_reach_the_kth_score_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 4)
    docs = [(i, "common " * (1 + i % 9) + "filler " * (9 - i % 9)) for i in range(400)] + [(1000, "common rare")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "common"), (2, "common rare"), (3, "nothing"), (4, ""), (5, None)], "query_id long, text string")
    index = TermIndex(spark, str(tmp_path / "ix"))
    index.add(df)
    read = []
    monkeypatch.setattr(term_index, "ranked", lambda scored, k: read.append(scored.count()) or retrieve.ranked(scored, k))
    assert rows(index.search(q, 5)) == rows(retrieve.sparse(q, df, 5))
    assert read[0] < 500  # of 802 pairs of a question and a document with one of its terms


def test_repeated_null_and_missing(spark, tmp_path):
    index = TermIndex(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "b a")], "query_id long, text string")
    assert index.batches() == [] and rows(index.search(q, 3)) == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "b"), (1, "a"), (1, "a"), (2, None), (3, ""), (4, "A b a")], "doc_id long, text string")
    assert index.add(df) == 4 and index.add(df) == 0
    assert rows(index.lengths()) == [(1, 1), (2, 0), (3, 0), (4, 3)]
    assert [r[1] for r in rows(index.search(q, 3))] == [1, 4]
    assert rows(index.search(q.limit(0), 3)) == []


def test_an_addition_that_was_cut_off_is_made_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} all") for i in range(20)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "all w7")], "query_id long, text string")
    index = TermIndex(spark, str(tmp_path / "ix"))
    index.add(df.where("doc_id < 10"))
    with monkeypatch.context() as m:
        m.setattr(TermIndex, "_bucket", lambda self: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            index.add(df)
    assert index.batches() == [0] and index.lengths().count() == 10
    assert index.add(df) == 10 and index.lengths().count() == 20
    assert rows(index.search(q, 20)) == rows(retrieve.sparse(q, df, 20))


def test_memory_of_a_task_is_bounded_by_tokens(spark, tmp_path, monkeypatch):
    """Whatever the batches that Spark makes, a segment holds few tokens, and each gives a question's best only."""
    monkeypatch.setattr(term_index, "SEGMENT", 60)
    monkeypatch.setattr(term_index, "ASKED", 2)
    docs = [(i, f"all w{i % 5} " + "x " * (i % 7)) for i in range(500)] + [(1000, "all y " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(i, f"all w{i} y") for i in range(5)] + [(None, "all"), (7, "w1"), (7, "all")], "query_id long, text string")
    index = TermIndex(spark, str(tmp_path / "ix"))
    index.add(df)
    sizes = [r["n"] for r in index.blocks().selectExpr("segment", "explode(tfs) t").groupBy("segment").agg({"t": "sum"}).withColumnRenamed("sum(t)", "n").collect()]
    assert sorted(sizes)[-1] == 600 and sorted(sizes)[-2] <= 60
    read = []
    monkeypatch.setattr(term_index, "ranked", lambda scored, k: read.append(scored.groupBy("query_id").count().agg({"count": "max"}).first()[0]) or retrieve.ranked(scored, k))
    for idf in (False, True):
        assert rows(index.search(q, 3, idf)) == rows(retrieve.sparse(q.where("query_id is not null"), df, 3, idf))
    assert max(read) <= 3 * len(sizes)
