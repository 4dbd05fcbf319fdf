"""Retrieval, fusion, reranking, contexts and answers over the benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, TOKEN, key_terms, tokens
from ..operators import chunk, context, generate, language_model, retrieve, understand
from ..operators.term_index import TermIndex
from ..operators.vector_index import VectorIndex
from ..sources import providers
from ..sources.tables import Store, scratch, staged, table
from ..streaming import ingest
from .chunk_queries import PER_PARENT, TOKENS, chunks
from .registry import PARTS, query
from .text_queries import EXPAND_SQL, ROUTE_SQL, TERMS_SQL, TYPE_SQL, _docs, language_model_of, query_expand

K, FUSED, RERANKED = 10, 10, 4
E = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


PARTS["doc_tokens"] = f"SELECT doc_id, {TOKENS} AS t FROM documents"
PARTS["mean"] = "SELECT avg(len(t)) AS avgdl, count(*) AS n FROM doc_tokens"
_WEIGHT = "round(tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 6)"
PARTS["postings"] = f"""SELECT doc_id, term, tf, {_WEIGHT} AS weight FROM (
SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM doc_tokens) GROUP BY ALL), mean"""
PARTS["query_postings"] = f"""SELECT query_id, term, {_WEIGHT} AS wq FROM (
SELECT query_id, dl, term, count(*) AS tf FROM (SELECT query_id, len(t) AS dl, unnest(t) AS term FROM (SELECT item_id AS query_id, {TOKENS} AS t FROM benchmark)) GROUP BY ALL), mean"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
PARTS["sparse"] = f"""SELECT * FROM (SELECT *, {_RANK} FROM (
SELECT query_id, doc_id AS id, round(sum(wq * weight), 6) AS score FROM query_postings JOIN postings USING (term) GROUP BY ALL)) WHERE rank <= {K}"""
PARTS["sparse_idf"] = f"""SELECT * FROM (SELECT *, {_RANK} FROM (
SELECT query_id, doc_id AS id, round(sum(wq * weight * ln(1 + (n - df + 0.5e0) / (df + 0.5e0))), 6) AS score FROM query_postings JOIN postings USING (term)
JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term), mean GROUP BY ALL)) WHERE rank <= {K}"""
_COS = "round(list_inner_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_inner_product(b::DOUBLE[], b::DOUBLE[]))), 6)"
PARTS["pairs"] = """SELECT q.vec_id AS query_id, d.vec_id AS id, q.embedding AS a, d.embedding AS b, q.label AS la, d.label AS lb
FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)"""
PARTS["dense"] = f"SELECT * FROM (SELECT *, {_RANK} FROM (SELECT query_id, id, {_COS} AS score FROM pairs)) WHERE rank <= {K}"
PARTS["dense_lang"] = f"SELECT * FROM (SELECT *, {_RANK} FROM (SELECT query_id, id, {_COS} AS score FROM pairs WHERE la = lb)) WHERE rank <= {K}"
PARTS["fused"] = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, id) AS rank FROM (
SELECT query_id, id, max(d) AS dense_rank, max(s) AS sparse_rank, round(coalesce(1e0 / (60 + max(d)), 0e0) + coalesce(1e0 / (60 + max(s)), 0e0), 9) AS rrf FROM (
SELECT query_id, id, rank AS d, NULL AS s FROM dense UNION ALL SELECT query_id, id, NULL, rank FROM sparse) GROUP BY query_id, id)"""


@query("SELECT doc_id, term, tf, weight FROM postings")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return retrieve.postings(docs, "doc_id", docs)


#: (Application, folder of tables) -> the term index of its documents.
_indexes: dict[tuple[str, str], TermIndex] = {}


def term_index(spark: SparkSession, sf_dir: str) -> TermIndex:
    """The stored index of the documents: made by the first query that asks for it, brought up to date by the others."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes[key] = TermIndex(spark, scratch(spark, "terms"))
    _indexes[key].add(_docs(spark, sf_dir))
    return _indexes[key]


@query("SELECT query_id, id, score, rank FROM sparse")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_index(spark, sf_dir).search(asked(spark, sf_dir), K)


@query("SELECT query_id, id, score, rank FROM sparse_idf")
def sparse_topk_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_index(spark, sf_dir).search(asked(spark, sf_dir), K, idf=True)


def _vectored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that have a vector."""
    own = asked(spark, sf_dir).select(F.col("query_id").alias("id"))
    return vectors(spark, sf_dir).join(own, "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label")


def _dense(spark: SparkSession, sf_dir: str, same: str | None = None) -> DataFrame:
    return retrieve.dense(_vectored(spark, sf_dir), vectors(spark, sf_dir), K, same)


@query("SELECT query_id, id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query("SELECT query_id, id, score, rank FROM dense_lang")
def dense_topk_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "label")


#: (Application, folder of tables) -> the cells of its vectors.
_cells: dict[tuple[str, str], VectorIndex] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored index of the vectors: made by the first query that asks for it, brought up to date by the others."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _cells:
        _cells[key] = VectorIndex(spark, scratch(spark, "cells")).fit(vectors(spark, sf_dir))
    else:
        _cells[key].add(vectors(spark, sf_dir))
    return _cells[key]


@query("SELECT query_id, id, score, rank FROM dense")
def dense_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search through the index: every cell is probed."""
    return vector_index(spark, sf_dir).search(_vectored(spark, sf_dir), K, exact=True)


@query("SELECT query_id, id, score, rank FROM dense_lang")
def dense_indexed_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index(spark, sf_dir).search(_vectored(spark, sf_dir), K, exact=True, same=True)


@query()
def dense_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the cells that a query probes."""
    return vector_index(spark, sf_dir).search(_vectored(spark, sf_dir), K)


@query()
def dense_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question, how many of its exact neighbours the probed cells gave."""
    found = dense_approx(spark, sf_dir).select("query_id", "id", F.lit(1).alias("hit"))
    return dense_topk(spark, sf_dir).join(found, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")
    )


@query(f"SELECT query_id, id, score FROM (SELECT query_id, id, {_COS} AS score FROM pairs) WHERE score >= 0.3")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors that are close to one of the benchmark's."""
    return retrieve.cosines(_vectored(spark, sf_dir), vectors(spark, sf_dir), lambda score: score >= 0.3)


def fused(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return retrieve.rrf(dense_topk(spark, sf_dir), sparse_topk(spark, sf_dir), limit)


@query("SELECT query_id, id, rrf, rank FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "id", "rrf", "rank")


@query(f"SELECT query_id, id, rrf, rank FROM fused WHERE rank <= {FUSED}")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir, FUSED).select("query_id", "id", "rrf", "rank")


@query("""SELECT query_id, id, round(1e0 / (60 + rank), 9) AS rrf, rank FROM dense""")
def hybrid_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval where the sparse index isn't there: the dense list alone is fused."""
    postings = Store(spark, scratch(spark, "no-postings"), "doc_id long, term string, weight double", "doc_id")
    found = retrieve.hybrid(dense_topk(spark, sf_dir), lambda: postings.read().select("doc_id"))
    return found.select("query_id", "id", "rrf", "rank")


PARTS["hits"] = """SELECT f.query_id, f.id, f.rrf, f.rank, d.text, d.source, d.lang, b.text AS question
FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id"""


def hits(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Fused results with their texts, which join in at the end."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", "lang")
    return fused(spark, sf_dir, limit).select("query_id", "id", "rrf", "rank").join(docs, "id").join(
        asked(spark, sf_dir).withColumnRenamed("text", "question"), "query_id"
    )


@query("SELECT query_id, id, rrf, md5(text) AS md5 FROM hits")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "id", "rrf", F.md5("text").alias("md5"))


PARTS["sub_queries"] = EXPAND_SQL
PARTS["sub_postings"] = f"""SELECT query_id, sub_query, term, {_WEIGHT} AS wq FROM (
SELECT query_id, sub_query, dl, term, count(*) AS tf FROM (SELECT query_id, sub_query, len(t) AS dl, unnest(t) AS term FROM (SELECT query_id, sub_query, {TOKENS} AS t FROM sub_queries)) GROUP BY ALL), mean"""
PARTS["sub_sparse"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_query ORDER BY score DESC, id) AS rank FROM (
SELECT query_id, sub_query, doc_id AS id, round(sum(wq * weight), 6) AS score FROM sub_postings JOIN postings USING (term) GROUP BY ALL)) WHERE rank <= {K}"""
PARTS["sub_fused"] = """SELECT *, row_number() OVER (PARTITION BY query_id, sub_query ORDER BY rrf DESC, d ASC NULLS LAST, s ASC NULLS LAST, id) AS rank FROM (
SELECT query_id, sub_query, id, max(d) AS d, max(s) AS s, round(coalesce(1e0 / (60 + max(d)), 0e0) + coalesce(1e0 / (60 + max(s)), 0e0), 9) AS rrf FROM (
SELECT query_id, sub_query, id, rank AS d, NULL AS s FROM dense JOIN (SELECT query_id, max(sub_query) AS sub_query FROM sub_queries GROUP BY query_id) USING (query_id)
UNION ALL SELECT query_id, sub_query, id, NULL, rank FROM sub_sparse) GROUP BY query_id, sub_query, id)"""
PARTS["unioned"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY sub_query, rank) AS nth FROM sub_fused) WHERE nth = 1"


@query("SELECT query_id, sub_query, id FROM unioned")
def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten and the original question are searched, their results united."""
    return searched(spark, sf_dir).select("query_id", "sub_query", "id")


@query(f"""SELECT query_id, id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM (
SELECT query_id, id, len(terms) = 0 OR len(list_filter(terms, lambda t: contains(lower(body), t) OR contains(lower(coalesce(source, '')), t))) > 0 AS hit FROM (
SELECT query_id, id, text AS body, source, {TERMS_SQL.replace('text', 'question')} AS terms FROM hits))) WHERE hit OR NOT any_hit""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).withColumn("terms", key_terms(F.col("question")))
    return retrieve.keyword_filter(found).select("query_id", "id")


PARTS["reranked"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM (
SELECT query_id, id, text, source, lang, question, rank AS fused_rank,
round(CASE WHEN len(list_distinct({E.format('question')})) > 0 THEN len(list_intersect(list_distinct({E.format('question')}), {E.format('text')})) / len(list_distinct({E.format('question')})) ELSE 0 END, 6) AS score
FROM hits)) WHERE rank <= {RERANKED}"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sub_query, id, rank: each row of ``query_expand`` is searched, and a question's results are united.

    Every sub-query has its sparse list; only the question itself has a vector, so its list alone is fused with a dense one.
    """
    subs = query_expand(spark, sf_dir)
    keyed = subs.select(F.struct("query_id", "sub_query").alias("query_id"), "text")
    found = term_index(spark, sf_dir).search(keyed, K)
    own = subs.groupBy("query_id").agg(F.max("sub_query").alias("sub_query"))  # the question comes last
    vectored = dense_topk(spark, sf_dir).join(own, "query_id").withColumn("query_id", F.struct("query_id", "sub_query")).drop("sub_query")
    lists = retrieve.rrf(vectored, found).select("query_id.query_id", "query_id.sub_query", "id", "rank")
    return retrieve.union_subqueries(lists)


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of ``searched`` with their texts, ranked by sub-query and place."""
    order = Window.partitionBy("query_id").orderBy("sub_query", "rank")
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", "lang")
    ids = searched(spark, sf_dir).select("query_id", "id", F.row_number().over(order).cast("long").alias("rank"))
    return ids.join(docs, "id").join(asked(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")


def reranked(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = hits(spark, sf_dir) if found is None else found
    scored = found.withColumn("score", retrieve.overlap(F.col("question"), F.col("text"))).withColumnRenamed("rank", "fused_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= RERANKED)


@query("SELECT query_id, id, score, rank FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query_id", "id", "score", "rank")


def _words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{BLANK[1:-1]}]+')"


_CUT = f"array_to_string(({_words_sql('text')})[:greatest(512 - least(len({_words_sql('question')}), 512), 0)], ' ')"
_LESS = f"array_to_string(({_words_sql('question')})[:512], ' ')"


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """The default relevance model for batches: the share of the query's distinct tokens that the text has."""
    import regex

    words = [(set(regex.findall(TOKEN, q.lower())), set(regex.findall(TOKEN, t.lower()))) for q, t in pairs]
    return [len(q & t) / len(q) if q else 0.0 for q, t in words]


@query(f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM (
SELECT query_id, id, rank AS fused_rank, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS score FROM (
SELECT query_id, id, rank, list_distinct({E.format(_LESS)}) AS q, {E.format(_CUT)} AS t FROM hits)) QUALIFY rank <= {RERANKED}""")
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by a model that is given batches of pairs of at most 512 words."""
    score = F.round(providers.relevance(F.col("question"), F.col("text"), shared_words), 6)
    return best_pairs(hits(spark, sf_dir).withColumn("score", score))


def best_pairs(scored: DataFrame) -> DataFrame:
    """The best by (score, fused rank); pairs without a score come last."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    ranks = scored.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= RERANKED)
    return ranks.select("query_id", "id", "score", F.col("nth").alias("rank"))


# A hit is placed on the page of its document that has most of the question's words, the first of equal ones.
def _placed_sql(found: str) -> str:
    share = f"len(list_intersect(list_distinct({E.format('h.question')}), {E.format('p.text')})) / greatest(len(list_distinct({E.format('h.question')})), 1)"
    return f"""SELECT h.*, h.id AS doc_id, b.page FROM {found} h LEFT JOIN (SELECT query_id, id, page FROM (
SELECT h.query_id, h.id, p.page, row_number() OVER (PARTITION BY h.query_id, h.id ORDER BY round({share}, 6) DESC, p.page) AS nth
FROM {found} h JOIN parents p ON p.doc_id = h.id) WHERE nth = 1) b ON b.query_id = h.query_id AND b.id = h.id"""


PARTS["child_hits"] = _placed_sql("reranked")
PARTS["first_hits"] = _placed_sql(f"(SELECT * FROM hits WHERE rank <= {RERANKED})")
PARTS["expanded"] = """SELECT c.*, CASE WHEN length(p.text) > 0 THEN p.text ELSE c.text END AS final_text, p.text IS NOT NULL AS has_parent
FROM child_hits c LEFT JOIN parents p ON p.doc_id = c.doc_id AND p.page = c.page"""


def expanded(spark: SparkSession, sf_dir: str, strict: bool = False, found: DataFrame | None = None) -> DataFrame:
    return context.expand_to_parents(*_placed(spark, sf_dir, reranked(spark, sf_dir, found)), strict)


def _placed(spark: SparkSession, sf_dir: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the page that they lie on, null without one; the pages of their documents, of which alone pages are built)."""
    found = staged(found.withColumn("doc_id", F.col("id")), "hits")
    pages = staged(chunk.parents(chunks(spark, sf_dir, found)), "pages")
    shown = found.select("query_id", "doc_id", "question").join(pages.select("doc_id", "page", "text"), "doc_id")
    order = F.struct(retrieve.overlap(F.col("question"), F.col("text")), -F.col("page"))
    best = shown.groupBy("query_id", "doc_id").agg(F.max_by("page", order).alias("page"))
    return found.join(best, ["query_id", "doc_id"], "left"), pages


@query("SELECT query_id, rank, md5(final_text) AS md5 FROM expanded")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir).select("query_id", "rank", F.md5("final_text").alias("md5"))


@query("""SELECT query_id, rank, md5(final_text) AS md5 FROM (SELECT *, bool_or(has_parent) OVER (PARTITION BY query_id) AS any_hit FROM expanded)
WHERE has_parent OR (NOT any_hit AND rank <= 5)""")
def parent_expand_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hits with a parent; a query without any keeps its first five as they are."""
    found, pages = _placed(spark, sf_dir, reranked(spark, sf_dir))
    joined = found.join(pages.select("doc_id", "page", F.col("text").alias("parent")), ["doc_id", "page"], "left").withColumn("has", F.col("parent").isNotNull())
    some = F.max("has").over(Window.partitionBy("query_id"))
    return joined.withColumn("some", some).where("has or (not some and rank <= 5)").select("query_id", "rank", F.md5(F.coalesce("parent", "text")).alias("md5"))


@query(f"""SELECT h.query_id, h.rank, p.label, md5(p.text) AS md5 FROM child_hits h JOIN (
SELECT doc_id, min(page) AS a, max(page) AS b, min(page) || '-' || max(page) AS label, string_agg(text, ' ' ORDER BY page) AS text FROM (
SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // {PER_PARENT} AS batch FROM parents) GROUP BY doc_id, batch) p
ON p.doc_id = h.doc_id AND h.page BETWEEN p.a AND p.b""")
def merged_parent_of_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged parent that a hit's page belongs to, whichever of its pages that is."""
    found, pages = _placed(spark, sf_dir, reranked(spark, sf_dir))
    merged = chunk.by_page(chunk.merged_pages(pages, PER_PARENT)).select("doc_id", "page", "label", F.col("text").alias("merged"))
    return found.join(merged, ["doc_id", "page"]).select("query_id", "rank", "label", F.md5("merged").alias("md5"))


PARTS["distinct_texts"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, final_text ORDER BY rank) AS nth FROM expanded) WHERE nth = 1"


@query("SELECT query_id, rank, md5(final_text) AS md5 FROM distinct_texts")
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.distinct_texts(expanded(spark, sf_dir)).select("query_id", "rank", F.md5("final_text").alias("md5"))


PARTS["contexts"] = "SELECT query_id, count(*) AS n_parts, string_agg(final_text, chr(10) || chr(10) || '===== PAGE BREAK =====' || chr(10) || chr(10) ORDER BY rank) AS context FROM distinct_texts GROUP BY query_id"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.contexts(context.distinct_texts(expanded(spark, sf_dir)))


@query("SELECT query_id, n_parts, md5(context) AS md5, length(context) AS n_chars FROM contexts")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("query_id", "n_parts", F.md5("context").alias("md5"), F.length("context").cast("long").alias("n_chars"))


@query("SELECT query_id, length(context) > 6000 AS compressed FROM contexts")
def compress_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("query_id", (F.length("context") > context.MAX_CONTEXT).alias("compressed"))


@query("SELECT query_id, rank, coalesce(source, 'Unknown') AS file, coalesce(page::VARCHAR, '?') AS page, left(coalesce(text, ''), 300) AS text FROM child_hits")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expanded(spark, sf_dir)
    return found.select("query_id", "rank", *context.citation(F.col("source"), F.col("page").cast("string"), F.col("text")))


_KIND = TYPE_SQL.replace("text", "b.text")
_CHOSEN = f"CASE WHEN {_KIND} = 'factual' THEN '{context.INSTRUCTIONS['factual']}' ELSE '{context.INSTRUCTIONS['explanatory']}' END"


@query(f"""SELECT query_id, md5('{context.BASE_PROMPT}' || chr(10) || chr(10) || replace({_CHOSEN}, '{{lang}}', 'English') || chr(10) || chr(10)
|| 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || b.text) AS md5 FROM contexts JOIN benchmark b ON b.item_id = query_id""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = contexts(spark, sf_dir).join(asked(spark, sf_dir), "query_id")
    made = context.prompt(F.col("text"), F.col("context"), understand.query_type(F.col("text")), F.lit("English"))
    return joined.select("query_id", F.md5(made).alias("md5"))


@query("""SELECT query_id, 'child' AS chunk_type, doc_id || '::page' || page AS source_key, rrf AS score FROM first_hits WHERE page IS NOT NULL
UNION ALL SELECT DISTINCT query_id, 'parent', doc_id || '::page' || page, NULL FROM first_hits WHERE page IS NOT NULL""")
def retrieve_full_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, then the parents that they belong to, told apart by type; hits without a page are left out."""
    key = F.concat(F.col("doc_id").cast("string"), F.lit("::page"), F.col("page").cast("string")).alias("source_key")
    found, pages = _placed(spark, sf_dir, hits(spark, sf_dir, RERANKED))
    child = found.where("page is not null")
    parent = child.select("query_id", "doc_id", "page").distinct().join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return child.select("query_id", F.lit("child").alias("chunk_type"), key, F.col("rrf").alias("score")).unionByName(
        parent.select("query_id", F.lit("parent").alias("chunk_type"), key), allowMissingColumns=True
    )


@query(f"""SELECT q.item_id AS query_id, r.route, CASE WHEN r.route = 'rag' THEN count(f.id) ELSE 0 END AS n_results
FROM benchmark q JOIN (SELECT item_id, {ROUTE_SQL} AS route FROM benchmark) r USING (item_id) LEFT JOIN fused f ON f.query_id = q.item_id GROUP BY q.item_id, r.route""")
def route_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small talk isn't searched for; questions without results stay."""
    routed = asked(spark, sf_dir).select("query_id", understand.route(F.col("text")).alias("route"))
    found = fused(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("route") == "rag", F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return routed.join(found, "query_id", "left").select("query_id", "route", n.alias("n_results"))


#: Names of the languages that the model tells apart; others keep their code.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def understood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question, language, route, query_type of every question."""
    rows = asked(spark, sf_dir).select(
        "query_id", "text", F.col("text").alias("question"), understand.language(F.col("text"), F.lit(None)).alias("sure"),
        understand.route(F.col("text")).alias("route"), understand.query_type(F.col("text")).alias("query_type"),
    )
    found = language_model.identified(rows, language_model_of(spark, sf_dir))
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.col("predicted")), F.col("predicted"))
    return found.select("query_id", "question", F.coalesce("sure", named).alias("language"), "route", "query_type")


def halting(prompt: str) -> str:
    """The default generator, which knows English and French only and fails on prompts in other languages."""
    if not any(f" in {name}.\n" in prompt for name in ("English", "French")):
        raise RuntimeError("this language isn't spoken here")
    return generate.extractive(prompt)


@query()
def gen_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a generator that fails in some languages: the English answer stands in, behind a banner."""
    rows = understood(spark, sf_dir).join(contexts(spark, sf_dir), "query_id", "left")
    return generate.answered(rows, halting).select("query_id", "language", "outcome", "answer")


@query()
def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's answer with language, route, type and citations; small talk and empty results keep their rows."""
    found = expanded(spark, sf_dir, found=united(spark, sf_dir))
    cited = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *context.citation(F.col("source"), F.col("page").cast("string"), F.col("text"))))).alias("citations")
    )
    made = context.contexts(context.distinct_texts(found))
    talk = F.col("route") == "general_chat"
    rows = understood(spark, sf_dir).join(made, "query_id", "left").join(cited, "query_id", "left")
    short = F.when(~talk, context.compressed(F.col("question"), F.col("context"), tokens))
    replied = generate.answered(rows.withColumn("context", short))
    return replied.select(
        "query_id", F.col("question").alias("query"), "language", F.when(talk, F.lit("Hello! Ask about the documents.")).otherwise(F.col("answer")).alias("answer"),
        "route", F.when(~talk, F.col("query_type")).alias("query_type"), F.when(~talk, F.col("citations")).alias("citations"),
    )


@query("SELECT doc_id, idx FROM chunks")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(spark, sf_dir)


@query("SELECT DISTINCT doc_id FROM documents")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dedup(spark, sf_dir)
