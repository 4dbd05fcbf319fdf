import pytest
from oracle import same_rows

from passagework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, data, name):
    same_rows(spark, data, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stage_by_stage(spark, data):
    import corpus_pipeline as p
    from test_packing import check
    from test_quality_rules import brute
    from test_simhash_dedup import brute_components, brute_print

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = p.quality(spark, docs, data)
    n = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    left = {r["doc_id"] for r in kept.collect()}
    assert all(n[d][0] >= 50 and 100 * n[d][6] <= 50 * n[d][0] for d in left)
    once = p.near_duplicates(spark, kept, data)
    rows = kept.orderBy("doc_id").collect()
    label = brute_components([brute_print(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted({rows[k]["doc_id"] for k in label})
    safe = p.secrets(spark, once, data)
    mixed = p.mixing_weights(spark, safe, data)
    for df in (kept, once, safe, mixed):
        assert df.dtypes == docs.dtypes
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    used, bound = check(mixed, p.pack(spark, mixed, data).collect(), 1024)
    assert used <= bound * 1.05 + 1
    assert [name for name, _ in p.STAGES][:2] == ["quality_rules", "simhash_dedup"]
    assert p.run(spark, data).count() > 0
