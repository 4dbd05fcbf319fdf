"""Exact top-k search by tiled matrix products.

Vectors are turned into integers and numbered, so that each row is a candidate, and a query, of
its own. Queries and candidates are dealt into groups, and every pair of groups is a cell of a grid: one task
holds the queries of a cell, multiplies them tile by tile with one block of candidates after
another, and keeps the k best of each query by partial selection. The lists of a query are then merged
up a tree over its cells.

A query is sent to each group of candidates and a candidate to each group of queries, so n candidates and
m queries cost n * m / (queries in a group) + m * n / (candidates in a group) rows of shuffle. Queries in
a group are as many as ``QUERY_BYTES`` hold; candidates stream through, so their groups may be large.

Products are floating-point matrix products where all sums fit in 53 bits, so they are exact, and
integer ones otherwise.

Defined results. Vectors that are null, or hold null or non-finite components, and rows
without an id take no part. Vectors of different lengths are not compared. Components beyond
the range of a long after scaling are clipped to it, and scores wrap as longs do. Empty
vectors score 0. Repeated rows and repeated ids: each row is a candidate and, if asked for, a query of its
own, and leaves out only itself. Ties go to the smaller vec_id. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged

SCALE = 256
K = 5
EVERY = 50
#: Bytes that the queries of a cell take, candidates in a group, rows in a product, queries in a tile, lists merged at once.
QUERY_BYTES = 64 << 20
GROUP = 262_144
BLOCK = 2_048
TILE = 512
FAN_IN = 16
LEAST = np.iinfo(np.int64).min


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", asks: Column | bool = False) -> DataFrame:
    """(vec_id, asks, dim, v) of the vectors that take part, v being floor(256 * x) as longs."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    limit = float(1 << 62)
    scaled = lambda e: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(e.cast("double") * SCALE).cast("double")))
    asked = asks if isinstance(asks, Column) else F.lit(asks)
    return (
        rows.where(F.col(vec_id).isNotNull() & x.isNotNull() & ~bad)
        .select(F.col(vec_id).cast("long").alias("vec_id"), asked.alias("asks"), F.size(x).alias("dim"),
                F.transform(x, lambda e: scaled(e).cast("long")).alias("v"))
    )


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact wherever they fit in a long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Lists:
    """The k best (score descending, then id, then row) that each query of a cell has met so far."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, k: int) -> None:
        self.rows, self.v, self.k, n = rows, v, k, len(rows)
        self.score = np.full((n, k), LEAST)
        self.ids, self.at = np.zeros((n, k), np.int64), np.full((n, k), -1)
        self.count = np.zeros(n, np.int64)

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Partial selection: only scores that reach the k-th best of a query, here or so far, are ordered."""
        for a in range(0, len(self.rows), TILE):
            tile = slice(a, min(a + TILE, len(self.rows)))
            s = products(self.v[tile], v)
            own = self.rows[tile, None] == rows[None, :]
            bar = np.where(self.count[tile] >= self.k, self.score[tile, -1], LEAST)
            if s.shape[1] > self.k:  # the k + 1 best of the block hold k others than the query itself
                bar = np.maximum(bar, np.partition(s, s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1])
            q, c = np.nonzero((s >= bar[:, None]) & ~own)
            had, place = np.nonzero(np.arange(self.k) < self.count[tile, None])
            who = np.concatenate((had, q))
            score = np.concatenate((self.score[tile][had, place], s[q, c]))
            one = np.concatenate((self.ids[tile][had, place], ids[c]))
            at = np.concatenate((self.at[tile][had, place], rows[c]))
            order = np.lexsort((at, one, -score, who))
            who, score, one, at = who[order], score[order], one[order], at[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            who, score, one, at, nth = (x[nth < self.k] for x in (who, score, one, at, nth))
            self.score[a + who, nth], self.ids[a + who, nth], self.at[a + who, nth] = score, one, at
            self.count[tile] = np.bincount(who, minlength=tile.stop - a)


_OUT = ["query", "query_id", "vec_id", "score", "row", "part"]


def _search(k: int):
    """The rows of one cell follow each other: its queries first, then its candidates in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, lists = None, [], None

        def answer() -> Iterator[pa.RecordBatch]:
            if lists is None:
                return
            q, nth = np.nonzero(np.arange(k) < lists.count[:, None])
            cols = lists.rows[q], lists.query_ids[q], lists.ids[q, nth], lists.score[q, nth], lists.at[q, nth], np.full(len(q), here[2])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], _OUT)

        for batch in batches:
            dims, asks, cells, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows, ids, flat = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)
            starts, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            change = (np.diff(dims) != 0) | (np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(asks) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (dims[a], cells[a], parts[a]) != here:
                    yield from answer()
                    here, asked, lists = (dims[a], cells[a], parts[a]), [], None
                m = values[starts[a] : starts[b]].reshape(b - a, dims[a])
                if asks[a]:
                    asked.append((rows[a:b].copy(), ids[a:b].copy(), m.copy()))
                    continue
                if asked:
                    held = [np.concatenate(x) for x in zip(*asked, strict=True)]
                    lists, asked = Lists(held[0], held[2], k), []
                    lists.query_ids = held[1]
                if lists is not None:
                    for i in range(0, b - a, BLOCK):
                        lists.meet(rows[a:b][i : i + BLOCK], ids[a:b][i : i + BLOCK], m[i : i + BLOCK])
        yield from answer()

    return run


def merged(lists: DataFrame, k: int, by: Column) -> DataFrame:
    """The k best of each query's lists within one group."""
    order = Window.partitionBy("query", by).orderBy(F.desc("score"), "vec_id", "row")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grid(n_queries: int, n_candidates: int, dim: int, cores: int) -> tuple[int, int]:
    """(groups of queries, groups of candidates); at least two cells a core where the blocks suffice."""
    down = max(1, -(-n_queries * 8 * max(1, dim) // QUERY_BYTES))
    across = max(1, -(-n_candidates // GROUP), min(-(-n_candidates // BLOCK), -(-2 * cores // down)))
    return down, across


def _top(sides: DataFrame, k: int) -> DataFrame:
    """``sides``: (asks, listed, dim, vec_id, v), each row a query, a candidate or both."""
    rows = staged(sides.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers stay as written
    m, n, dim = rows.agg(F.count_if("asks"), F.count_if("listed"), F.coalesce(F.max("dim"), F.lit(0))).first()
    down, across = grid(m, n, dim, rows.sparkSession.sparkContext.defaultParallelism)
    group = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(k)).cast("long")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    last = ["row", "vec_id", "v"]
    asked = rows.where("asks").select("dim", F.lit(True).alias("asks"), group(1, down).alias("cell"), every(across).alias("part"), *last)
    listed = rows.where("listed").select("dim", F.lit(False).alias("asks"), every(down).alias("cell"), group(2, across).alias("part"), *last)
    cells = asked.union(listed).repartition(max(1, down * across), "dim", "cell", "part")
    side = cells.sortWithinPartitions("dim", "cell", "part", F.desc("asks"))
    lists = mapped(side, _search(k), "query long, query_id long, vec_id long, score long, row long, part long")
    while across > FAN_IN:
        across = -(-across // FAN_IN)
        lists = merged(lists.withColumn("part", F.pmod("part", F.lit(across))), k, F.col("part")).drop("rank")
    return merged(lists, k, F.lit(0)).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``rows`` for each of ``queries``, which are rows of another table."""
    one = integers(rows, vec_id, vector).withColumn("listed", F.lit(True))
    return _top(one.union(integers(queries, vec_id, vector, True).withColumn("listed", F.lit(False))), k)


def search_embeddings(rows: DataFrame, every: int = EVERY, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stated queries: rows whose id is divisible by ``every``, each against all rows but itself."""
    asks = F.col(vec_id) % every == 0
    return _top(integers(rows, vec_id, vector, asks).withColumn("listed", F.lit(True)), k)
