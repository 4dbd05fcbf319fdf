import regex
from pyspark.sql import functions as F

from passagework.operators import language_model as m
from passagework.plans import text_queries as q


def test_held_out_accuracy(spark, data):
    lang = {r["doc_id"]: r["lang"] for r in q._docs(spark, data).collect()}
    rows = q.language_of_documents(spark, data).collect()
    assert len(rows) == len(lang)
    held = [r["predicted"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 30 and sum(held) / len(held) > 0.95


def test_nulls_ties_and_empty_samples(spark):
    sample = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), (None, "fr"), ("der hund", None), ("the dog", "en")], "text string, lang string")
    rows = spark.createDataFrame([(1, "the cow"), (2, "le lait"), (3, None), (4, ""), (5, "zzz"), (1, "the cow"), (None, "le")], "row long, text string")
    got = sorted((tuple(r) for r in m.identified(rows, m.learned(sample)).collect()), key=repr)
    assert got == [(1, "en"), (1, "en"), (2, "fr"), (3, "en"), (4, "en"), (5, "en"), (None, "fr")]
    assert {r["predicted"] for r in m.identified(rows, m.learned(sample.limit(0))).collect()} == {None}
    even = spark.createDataFrame([("ab", "y"), ("ab", "x")], "text string, lang string")
    assert {r["predicted"] for r in m.identified(rows, m.learned(even)).collect()} == {"x"}


def test_shuffled_model_gives_the_same(spark, data, monkeypatch):
    docs = q._docs(spark, data)
    rows = docs.select("doc_id", "text")
    found = lambda: sorted(map(tuple, m.identified(rows, m.learned(docs)).collect()))
    sent = found()
    monkeypatch.setattr(m, "BROADCAST", 0)
    assert found() == sent


def test_trigrams(spark):
    from passagework.operators.language_model import trigrams

    texts = ["Ab a", "", None, "??", "😀 x", "a_b 𐐷𐐷𐐷 ab", "aaaa aaaa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", trigrams(F.col("text")).alias("t"))
    wanted = {}
    for i, t in enumerate(texts):
        made = []
        for w in regex.findall(r"[\p{L}\p{N}_]+", (t or "").lower()):
            made += [f"_{w}_"[j : j + 3] for j in range(len(w))]
        wanted[i] = list(dict.fromkeys(made))
    assert {r["i"]: r["t"] for r in rows.collect()} == wanted


def test_nothing_is_shuffled_and_few_trigrams_are_looked_up_at_a_time(spark, data, monkeypatch):
    docs = q._docs(spark, data)
    model = m.learned(docs)
    rows = docs.select("doc_id", "text")
    found = m.identified(rows, model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(m, "LOOKED_UP", 50)
    assert sorted(map(tuple, m.identified(rows, model).collect())) == whole
