"""The jobs as queries: each is run twice into a new shared folder, whose whole content is returned, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.plans import chunk_queries, retrieval_queries, text_queries
from passagework.plans.registry import Query, whole
from passagework.sources.tables import scratch

from . import answer_questions, ingest_corpus

_SETTINGS = ingest_corpus.DEFAULTS


def job1_ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its status, and its chunks."""
    out = scratch(spark, "job1", keep=True)
    for _ in range(2):
        ingest_corpus.run(spark, f"{sf_dir}/documents.parquet", f"{out}/corpus", f"{out}/checkpoint")
    docs = ingest_corpus.documents(spark, f"{out}/corpus").drop("batch")
    made = ingest_corpus.chunks(spark, f"{out}/corpus").withColumn("md5", F.md5("chunk")).drop("batch", "lang", "chunk")
    return docs.join(made, "doc_id", "left")


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the documents found for it."""
    out = scratch(spark, "job2", keep=True)
    for _ in range(2):
        answer_questions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return answer_questions.answers(spark, out).drop("label")


_STEP = _SETTINGS["size"] - _SETTINGS["overlap"]
_JUDGED = text_queries.CORRUPT_SQL.replace("given_rows", "cleaned")
JOB1_SQL = f"""
WITH given AS (SELECT * EXCLUDE (nth) FROM (
  SELECT doc_id, text, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST, lang NULLS FIRST, source NULLS FIRST) AS nth FROM documents
  WHERE doc_id IS NOT NULL) WHERE nth = 1),
cleaned AS (SELECT doc_id, lang, source, coalesce({text_queries._SANE}, '') AS text FROM given),
judged AS (SELECT c.*, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < {_SETTINGS["least_chars"]} THEN 'short'
  WHEN lang = 'en' AND corrupted THEN 'corrupted' ELSE 'ready' END AS status FROM cleaned c JOIN ({_JUDGED}) USING (doc_id)),
cut AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - {_SETTINGS["size"]}) / {_STEP}.0))::BIGINT + 1)) AS idx FROM judged WHERE status = 'ready'),
named AS (SELECT doc_id, idx, {chunk_queries._NAME} || '-' || printf('%04d', idx) AS chunk_id, md5(substring(text, idx::INTEGER * {_STEP} + 1, {_SETTINGS["size"]})) AS md5 FROM cut),
chunks AS (SELECT *, {text_queries.uuid5_sql("chunk_id")} AS point_id, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id
  FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, lang, source, status, length(text) AS n_chars, count(idx) OVER (PARTITION BY doc_id) AS n_chunks,
  idx, chunk_id, point_id, prev_chunk_id, next_chunk_id, idx // {_SETTINGS["per_page"]} AS page, md5 FROM judged LEFT JOIN chunks USING (doc_id)
"""

_R = retrieval_queries
_Q, _D = _R.E.format("b.text"), _R.E.format("coalesce(d.text, '')")
JOB2_SQL = f"""
SELECT b.item_id AS query_id, t.route, t.status, f.rank, f.id, f.score, f.relevance, f.source, t.query_type
FROM benchmark b JOIN (SELECT item_id, {text_queries.ROUTE_SQL} AS route, {text_queries.TYPE_SQL} AS query_type,
  CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 3000 THEN 200 ELSE 400 END::BIGINT AS status FROM benchmark) t USING (item_id)
LEFT JOIN (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS rank, id, score, relevance, source FROM (
  SELECT s.*, d.source, round(CASE WHEN len(list_distinct({_Q})) > 0 THEN len(list_intersect(list_distinct({_Q}), {_D})) / len(list_distinct({_Q})) ELSE 0 END, 6) AS relevance
  FROM sparse s JOIN documents d ON d.doc_id = s.id JOIN benchmark b ON b.item_id = s.query_id)) f
ON f.query_id = b.item_id AND f.rank <= {answer_questions.DEFAULTS["kept"]} AND t.route = 'rag' AND t.status = 200
"""

QUERIES: dict[str, Query] = {"job1_ingest_corpus": job1_ingest_corpus, "job2_answer_questions": job2_answer_questions}
SQL: dict[str, str] = {"job1_ingest_corpus": JOB1_SQL.strip(), "job2_answer_questions": whole(JOB2_SQL)}
