"""Sparse and dense retrieval, fusion and reranking; many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..shipping import ship

K1, B = 1.2, 0.75
RRF = 60


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, dl): how often each term occurs in a text and the text's length in tokens."""
    listed = rows.select(F.col(key).alias("id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    return (
        listed.select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
        .groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        .select(F.col("id").alias(key), "term", "tf", "dl")
    )


def mean_length(rows: DataFrame) -> DataFrame:
    return rows.select(F.avg(F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN))).alias("avgdl"))


def weight() -> Column:
    """Saturated term weight; no inverse document frequency."""
    tf, norm = F.col("tf"), (1 - B) + B * F.col("dl") / F.col("avgdl")
    return F.round(tf * (K1 + 1) / (tf + K1 * norm), 6)


def postings(rows: DataFrame, key: str, corpus: DataFrame) -> DataFrame:
    """(key, term, tf, weight), lengths held against the corpus mean: one value, so it is broadcast."""
    counts = term_counts(rows, key)
    return counts.join(F.broadcast(mean_length(corpus))).select(key, "term", "tf", weight().alias("weight"))


def ranked(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best by (score descending, id), with rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def sparse(queries: DataFrame, docs: DataFrame, k: int, idf: bool = False) -> DataFrame:
    """query_id, id, score, rank: dot products of term weights, over terms that both have.

    Only the documents' tokens that some query asks for are counted and shuffled.
    """
    q = postings(queries, "query_id", docs).select("query_id", "term", F.col("weight").alias("wq"))
    listed = docs.select(F.col("doc_id").alias("id"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    told = listed.select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    counts = told.join(q.select("term").distinct(), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    d = counts.join(F.broadcast(mean_length(docs))).select("id", "term", weight().alias("weight"))
    hits = q.join(d, "term")
    product = F.col("wq") * F.col("weight")
    if idf:
        n = docs.agg(F.count(F.lit(1)).alias("n"))
        df = d.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        hits = hits.join(df, "term").join(F.broadcast(n))
        product = product * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return ranked(hits.groupBy("query_id", "id").agg(F.round(F.sum(product), 6).alias("score")), k)


#: Queries and vectors in one cell of the grid of products.
QUERIES, VECTORS = 4_096, 65_536


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


SCORED = "query_id long, id long, score double"


def usable(v: Column, key: str) -> Column:
    """A vector with a cosine: not empty, no null, NaN or infinite part, not of length nought, and with an id."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()


def nearest(k: int):
    """Marks each query's ``k`` best of a cell and what ties with the last of them."""

    def best(score: np.ndarray) -> np.ndarray:
        at = max(0, score.shape[1] - k)
        return score >= np.partition(score, at, axis=1)[:, at : at + 1]

    return best


def cell_scores(keep):
    """Cosines of the cell's queries and vectors, all of one length, as one product; only what ``keep`` marks becomes rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q_ids = right["id"].to_numpy(), left["query_id"].to_numpy()
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(ids) and len(q_ids):
            q, v, parts = _unit(left["q"]), _unit(right["v"]), []
            for a in range(0, len(q), 256):
                score = np.round(q[a : a + 256] @ v.T, 6)
                score[(q_ids[a : a + 256, None] == ids[None, :]) | np.isnan(score)] = -np.inf
                i, j = np.nonzero(keep(score) & (score > -np.inf))
                parts.append((q_ids[a + i], ids[j], score[i, j]))
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def cosines(queries: DataFrame, vectors: DataFrame, keep, same: str | None = None) -> DataFrame:
    """query_id, id, score of the pairs that ``keep`` marks in a matrix of scores, whose rows are queries.

    Queries and vectors are dealt over a grid of bounded cells, which meet by equality: a query is sent to every
    group of vectors, a vector to every group of queries. ``same`` names a column that must agree; it and the vectors' length are
    part of a cell's key, so other labels and lengths are never multiplied. Vectors that are null or empty, hold a null, a NaN or an
    infinite part, or have no length, and rows without an id or label take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    down, across = max(1, -(-m // QUERIES)), max(1, -(-n // VECTORS), min(2 * cores, -(-n // 1024)))
    group = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    label = (F.col(same).cast("string") if same else F.lit("")).alias("_label")
    left = queries.where(usable(F.col("q"), "query_id")).select("query_id", "q", label, F.size("q").alias("_length"), group("query_id", down).alias("row"), every(across).alias("column"))
    right = vectors.where(usable(F.col("v"), "id")).select("id", "v", label, F.size("v").alias("_length"), every(down).alias("row"), group("id", across).alias("column"))
    cell = ["row", "column", "_length", "_label"]
    left, right = (d.where("_label is not null") for d in (left, right))
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(cell_scores(keep), SCORED)


def dense(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """query_id, id, score, rank by cosine; ``same`` names a column that must agree.

    A cell gives each query's k best and what ties with the last of them, so little is shuffled.
    """
    return ranked(cosines(queries, vectors, nearest(k), same), k)


def hybrid(dense_list: DataFrame, sparse_list, limit: int | None = None) -> DataFrame:
    """The fused lists; where ``sparse_list()`` cannot be made, because its index or model isn't there, the dense list alone."""
    try:
        found = sparse_list()
    except (AnalysisException, OSError, RuntimeError):
        found = dense_list.limit(0)
    return rrf(dense_list, found, limit)


def rrf(dense_list: DataFrame, sparse_list: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, id, rrf, dense_rank, sparse_rank, rank; ties in order of the dense, then the sparse list."""
    both = dense_list.select("query_id", "id", F.col("rank").alias("dense_rank"), F.lit(None).cast("long").alias("sparse_rank")).union(
        sparse_list.select("query_id", "id", F.lit(None).cast("long"), "rank")
    )
    one = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    fused = (
        both.groupBy("query_id", "id").agg(F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))
        .withColumn("rrf", F.round(one("dense_rank") + one("sparse_rank"), 9))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id")
    out = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= limit) if limit else out


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: the default relevance model."""
    q = F.array_distinct(tokens(query))
    return F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0), 6)


def union_subqueries(lists: DataFrame) -> DataFrame:
    """Results of a query's sub-queries, each id once, at its first place."""
    order = Window.partitionBy("query_id", "id").orderBy("sub_query", "rank")
    return lists.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def keyword_filter(hits: DataFrame) -> DataFrame:
    """Keeps hits whose text or source has one of the query's terms; all if there are none or nothing is left."""
    has = F.exists("terms", lambda t: F.contains(F.lower("text"), t) | F.contains(F.lower(F.coalesce("source", F.lit(""))), t))
    flagged = hits.withColumn("hit", (F.size("terms") == 0) | has)
    some = F.max("hit").over(Window.partitionBy("query_id"))
    return flagged.withColumn("some", some).where("hit or not some").drop("hit", "some")
