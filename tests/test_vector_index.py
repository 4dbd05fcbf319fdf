import numpy as np
import pytest

from passagework.operators import retrieve
from passagework.operators.vector_index import OTHER, VectorIndex
from passagework.plans import retrieval_queries

SCHEMA = "id long, v array<float>, label int"


def table(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v", "label")


def asked(rows):
    return rows.selectExpr("id as query_id", "v as q", "label")


def found(rows):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows.collect())


def test_recall_and_exact_search(spark, data, tmp_path):
    v = table(spark, data)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v)
    exact = found(retrieve.dense(asked(v), v, 10))
    assert found(index.search(asked(v), 10, exact=True)) == exact
    assert found(index.search(asked(v), 10, exact=True, same=True)) == found(retrieve.dense(asked(v), v, 10, "label"))
    near = {(q, i) for q, _, i, _ in found(index.search(asked(v), 10))}
    share = len(near & {(q, i) for q, _, i, _ in exact}) / len(exact)
    assert share >= 0.9
    again = VectorIndex(spark, f"file://{tmp_path}/index").load()
    assert again.probes == index.probes and found(again.search(asked(v), 10)) == found(index.search(asked(v), 10))


def test_far_cells_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = np.eye(8)
    rows = [(i, [float(x) for x in 10 * centres[i % 8] + rng.normal(size=8) * 0.1], 0) for i in range(640)]
    v = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v)
    assert index.probes < len(index.centres)
    q = asked(v).where("query_id < 16")
    plan = index.search(q.where("query_id = 3"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    exact = {(a, c) for a, _, c, _ in found(retrieve.dense(q, v, 5))}
    assert len(exact & {(a, c) for a, _, c, _ in found(index.search(q, 5))}) >= 0.9 * len(exact)


def test_hot_cells_and_blocks(spark, tmp_path, monkeypatch):
    """Equal vectors share a cell, which is split over many blocks; ties go by id."""
    monkeypatch.setattr(retrieve, "QUERIES", 7)
    monkeypatch.setattr(retrieve, "VECTORS", 20)
    rows = [(i, [1.0, 2.0], 0) for i in range(200)] + [(200 + i, [float(i), -1.0], 1) for i in range(50)]
    v = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v)
    assert found(index.search(asked(v), 4, exact=True)) == found(retrieve.dense(asked(v), v, 4))
    assert [i for q, _, i, _ in found(index.search(asked(v).where("query_id = 1"), 4)) if q == 1] == [0, 2, 3, 4]


def test_additions_odd_vectors_and_empty_tables(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [], 0), (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
            (9, [0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], None), (12, [0.0, 1.0, 0.0], 1)]
    v = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/odd").fit(v.where("id < 10"))
    index.add(v)
    index.add(v)
    assert index._stored().count() == 6
    assert {r["id"] for r in index._stored().where(f"cell = {OTHER}").collect()} == {3, 12}
    assert found(index.search(asked(v), 5, exact=True)) == found(retrieve.dense(asked(v), v, 5))
    assert found(index.search(asked(v), 5, exact=True, same=True)) == found(retrieve.dense(asked(v), v, 5, "label"))
    empty = VectorIndex(spark, f"file://{tmp_path}/empty").fit(v.limit(0))
    assert empty.search(asked(v), 5).count() == 0
    empty.add(v)
    assert found(empty.search(asked(v), 5)) == found(retrieve.dense(asked(v), v, 5))
    assert index.search(asked(v).limit(0), 5).count() == 0


def test_small_cells_cost_a_file_each_and_exact_search_no_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(900)], SCHEMA)
    index = VectorIndex(spark, f"file://{tmp_path}/index").fit(v)
    files = list((tmp_path / "index" / "vectors").rglob("*.parquet"))
    assert len(files) <= len(index.centres) + spark.sparkContext.defaultParallelism
    blocks, made = spark.sparkContext.accumulator(0), retrieve.cell_scores

    def counted(keep):
        run = made(keep)

        def counting(left, right):
            blocks.add(1)
            return run(left, right)

        return counting

    monkeypatch.setattr(retrieve, "cell_scores", counted)
    assert found(index.search(asked(v).where("id < 20"), 3, exact=True)) == found(retrieve.dense(asked(v).where("id < 20"), v, 3))
    assert blocks.value <= 4  # of two searches


@pytest.mark.parametrize("name", ["dense_recall"])
def test_measured_recall(spark, data, name):
    rows = getattr(retrieval_queries, name)(spark, data).collect()
    assert rows and sum(r["n_found"] for r in rows) >= 0.9 * sum(r["n_exact"] for r in rows)
