import numpy as np

from passagework.operators import retrieve

SCHEMA = "id long, v array<float>, label int"


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [], 0), (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0),
            (9, [0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], None), (12, [0.0, 1.0, 0.0], 1)]
    v = spark.createDataFrame(rows, SCHEMA)
    q = v.selectExpr("id as query_id", "v as q", "label")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieve.dense(q, v, 5).collect()}
    plain = [1, 2, 10, 11]
    assert set(got) == {(a, b) for a in plain for b in plain if a != b} | {(3, 12), (12, 3)}
    assert got[1, 10] == 1.0 and got[1, 2] == round(np.sqrt(0.5), 6)
    same = {(r["query_id"], r["id"]) for r in retrieve.dense(q, v, 5, "label").collect()}
    assert same == {(1, 2), (2, 1)}
    assert retrieve.dense(q.limit(0), v, 5).count() == 0 and retrieve.dense(q, v.limit(0), 5).count() == 0


def test_labels_are_in_the_cells_key(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "embedding as v", "label")
    q = v.where("id < 30").selectExpr("id as query_id", "v as q", "label")
    label = {r["id"]: r["label"] for r in v.collect()}
    unit = {r["id"]: np.array(r["v"], float) / np.linalg.norm(np.array(r["v"], float)) for r in v.collect()}
    for r in retrieve.dense(q, v, 3, "label").collect():
        near = sorted((-round(float(unit[r["query_id"]] @ unit[i]), 6), i) for i in unit if label[i] == label[r["query_id"]] and i != r["query_id"])
        assert near[r["rank"] - 1][1] == r["id"]
