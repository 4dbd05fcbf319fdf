"""Finds the best documents for every question of a table, through the stored term index.

    python jobs/answer_questions.py --documents DOCUMENTS --questions QUESTIONS --output FOLDER [--config jobs/answer_questions.json]

The index is kept in ``index``; a run adds the documents that it doesn't hold yet and reads no text but those of the documents found.
Results go to ``answers/label=L/query_type=T`` and, by route and type, to ``summary/label=L``; a run
overwrites its label's folders alone, so running it again gives the same rows.

Defined results. Rows without an id are left out; of several with one id the least text counts. Refused questions (empty, too long), small talk and
questions without any hit keep a row without a document. Ties: by the index's rank, then by the smaller id.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main
from passagework.operators import retrieve, understand
from passagework.operators.term_index import TermIndex
from passagework.sources.tables import one_each, staged, stored

DEFAULTS = {"format": "parquet", "label": "all", "query_id": "item_id", "query_text": "text", "found": 10, "kept": 4}
ANSWERS = "query_id long, route string, status long, rank long, id long, score double, relevance double, source string, label string, query_type string"


def understood(questions: DataFrame) -> DataFrame:
    """(query_id, text, status, route, query_type)."""
    status, _ = understand.validated(F.col("text"))
    said = F.coalesce("text", F.lit(""))
    return questions.select("query_id", said.alias("text"), status.alias("status"), understand.route(said).alias("route"), understand.query_type(said).alias("query_type"))


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict = DEFAULTS) -> dict[str, int]:
    """Brings the index up to date and answers the questions; returns and logs how many rows were read and written."""
    docs = spark.read.format(config["format"]).load(documents)
    index = TermIndex(spark, f"{output}/index")
    added = index.add(docs)
    read, wrote = Observation(), Observation()
    given = spark.read.format(config["format"]).load(questions).select(F.col(config["query_id"]).cast("long").alias("query_id"), F.col(config["query_text"]).alias("text"))
    asked = understood(one_each(given, "query_id"))
    searched = asked.where("status = 200 and route = 'rag'").select("query_id", "text")
    hits = staged(index.search(searched, config["found"]), "found")  # used three times
    texts = one_each(docs.select(F.col("doc_id").alias("id"), "text", "source").join(hits.select("id").distinct(), "id", "left_semi"), "id")
    judged = hits.join(texts, "id").join(searched.withColumnRenamed("text", "question"), "query_id").withColumn(
        "relevance", retrieve.overlap(F.col("question"), F.coalesce("text", F.lit("")))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    best = judged.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= config["kept"])
    found = best.select("query_id", F.col("nth").alias("rank"), "id", "score", "relevance", "source")
    rows = asked.drop("text").observe(read, F.count(F.lit(1)).alias("n")).join(found, "query_id", "left")
    at = f"label={config['label']}"
    rows.observe(wrote, F.count(F.lit(1)).alias("n"), F.count("id").alias("found")).write.mode("overwrite").partitionBy("query_type").parquet(f"{output}/answers/{at}")
    counted = answers(spark, output).where(F.col("label") == config["label"]).groupBy("route", "query_type").agg(
        F.count_distinct("query_id").alias("questions"), F.count("id").alias("documents")
    )
    counted.write.mode("overwrite").parquet(f"{output}/summary/{at}")
    told = {"documents_added": added, "questions_read": read.get["n"], "rows_written": wrote.get["n"], "documents_found": wrote.get["found"]}
    log.info("%s, %s: %s", documents, questions, told)
    return told


def answers(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, f"{output}/answers", ANSWERS)


if __name__ == "__main__":
    main("answer_questions", ("documents", "questions", "output"), DEFAULTS, run)
