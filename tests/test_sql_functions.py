from pyspark.sql import functions as F

from passagework.functions import sql, text
from passagework.operators import chunk, retrieve
from passagework.plans.chunk_queries import sql_functions


def test_functions_are_those_of_the_library(spark):
    sql.register(spark)
    rows = [(None, "x"), ("", ""), ("  a\tÉ b ", "a b"), ("Ünï çödé తె 😀 " * 200, "çödé zz"), ("x" * 1000, None), ("y" * 1001, "y")]
    df = spark.createDataFrame([(i, *r, "en", "s") for i, r in enumerate(rows)], "doc_id long, text string, q string, lang string, source string")
    got = df.select(F.expr("passage_sanitize(text)"), F.expr("passage_tokens(text)"), F.expr("passage_share(q, text)")).collect()
    t = F.coalesce("text", F.lit(""))
    own = df.select(text.sanitize(F.col("text")), text.tokens(t), retrieve.overlap(F.coalesce("q", F.lit("")), t)).collect()
    assert list(map(tuple, got)) == list(map(tuple, own))
    cut = df.selectExpr("doc_id", "passage_chunks(text, 1000, 150) AS made").selectExpr("doc_id", "inline(made)")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, chunk.fixed(df).select("doc_id", "idx", "chunk").collect()))


def test_inlined_without_a_join(spark, data):
    plan = sql_functions(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
