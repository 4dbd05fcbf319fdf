from passagework.operators import context, generate
from passagework.plans import retrieval_queries as queries

SCHEMA = "id int, question string, context string, query_type string, language string"


def answers(spark, rows, model):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: (r["outcome"], r["answer"]) for r in generate.answered(df, model).collect()}


def test_outcomes(spark):
    def model(prompt):
        if "in Telugu" in prompt or "boom" in prompt:
            raise RuntimeError("no")
        return " " if "blank" in prompt else f"said {'English' if 'in English' in prompt else 'other'}"

    rows = [(1, "q", "c", "factual", "English"), (2, "q", "c", "explanatory", "Telugu"), (3, "boom", "c", "factual", "Telugu"), (4, "boom", "c", "factual", None),
            (5, "q", " ", "factual", "English"), (6, "q", None, "factual", "Telugu"), (7, "blank", "c", "factual", "French"), (8, "q", "c", "factual", "French")]
    assert answers(spark, rows, model) == {
        1: ("own", "said English"), 2: ("english", "In English: said English"), 3: ("failed", generate.FAILED_IN["Telugu"]), 4: ("failed", generate.FAILED),
        5: ("empty", context.NOTHING), 6: ("empty", context.NOTHING), 7: ("failed", generate.FAILED), 8: ("own", "said other"),
    }
    assert answers(spark, [], model) == {}


def test_the_first_best_sentence_is_taken(spark):
    rows = [(1, "red fox", "A dog. The red hen. A red fox! A fox, red.", "factual", "English"), (2, "owl", "One. Two.", "factual", "English")]
    assert answers(spark, rows, generate.extractive) == {1: ("own", "A red fox!"), 2: ("own", "One.")}


def test_fallback_over_the_questions(spark, data):
    found = queries.gen_fallback(spark, data).collect()
    assert len(found) == spark.read.parquet(f"{data}/benchmark.parquet").count()
    for r in found:
        if r["outcome"] != "empty":
            assert r["outcome"] == ("own" if r["language"] in ("English", "French") else "english")
            assert r["answer"].startswith(generate.BANNER) == (r["outcome"] == "english")
