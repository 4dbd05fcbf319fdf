from passagework.operators import retrieve
from passagework.plans import retrieval_queries as r
from passagework.plans.text_queries import _docs, query_expand


def test_every_row_of_query_expand_is_searched(spark, data):
    subs = query_expand(spark, data).collect()
    last = {}
    for x in subs:
        last[x["query_id"]] = max(x["sub_query"], last.get(x["query_id"], 0))
    assert any(last.values())
    expected = {}
    for k in sorted(set(last.values()) | {0}):
        rows = [(x["query_id"], x["text"]) for x in subs if x["sub_query"] == k]
        mine = spark.createDataFrame(rows, "query_id long, text string")
        for x in retrieve.sparse(mine, _docs(spark, data), r.K).collect():
            expected.setdefault(x["query_id"], set()).add(x["id"])
    for x in r.dense_topk(spark, data).collect():
        expected.setdefault(x["query_id"], set()).add(x["id"])
    got = r.searched(spark, data).collect()
    found = {}
    for x in got:
        found.setdefault(x["query_id"], set()).add(x["id"])
    assert found == expected and len(got) == sum(map(len, expected.values()))
    old = {(x["query_id"], x["id"]) for x in r.fused(spark, data).collect()}
    assert {(q, i) for q, ids in found.items() for i in ids} > old


def test_answers_cite_what_the_subqueries_find(spark, data):
    best = {}
    for x in r.reranked(spark, data, r.united(spark, data)).orderBy("query_id", "rank").collect():
        best.setdefault(x["query_id"], []).append((x["rank"], x["source"] or "Unknown"))
    rows = r.answer(spark, data).collect()
    assert rows and {x["query_id"] for x in rows} == {x["query_id"] for x in r.asked(spark, data).collect()}
    cited = {x["query_id"]: [(c[0], c[1]) for c in x["citations"]] for x in rows if x["citations"] is not None}
    assert cited and all(c == best[q] for q, c in cited.items())
