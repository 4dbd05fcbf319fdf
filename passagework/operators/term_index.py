"""A stored term index: postings in blocks, by buckets of terms, that questions read without the texts.

A block holds at most ``BLOCK`` postings of one term, the best ones first: ids, term frequencies and document lengths, and beside them the
range of both. It is made inside a task from one segment, documents of ``SEGMENT`` tokens together (a longer document is one of its own), which bears the
name of its first one, so no term is ever gathered anywhere and a task's memory doesn't grow with the table. Weights depend on the
mean length of all documents, which changes as documents come, so blocks hold what weights are made of and
bounds follow at reading.

New documents are a further batch: blocks, lengths and one row of totals of their own. Nothing stored is read back but ids,
and nothing is rewritten. The totals are written last; a batch without them isn't there for readers and is
written again by the next ``add``, so an addition that was cut off, or is made twice, changes nothing.

A question reads the buckets of its terms. From the bounds alone follows a score that its k-th document
has at least; blocks whose documents cannot reach it, whatever their other terms give, are left out. The others meet by segment
and group of ``ASKED`` questions, so a task holds the scores of one segment's documents for a few questions at a time, and gives each question's best.

Defined results. Rows without an id aren't indexed. Of several new rows with one id the least text counts. Null or empty text: a length of
zero, no postings. Ties: the smaller id. Empty index or question without terms: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, tokens
from ..shipping import ship
from ..sources.tables import one_each, staged, stored
from .retrieve import B, K1, ranked, term_counts

BLOCK = 1024
BUCKETS = 64
#: Tokens of a segment, and questions that meet it at a time.
SEGMENT, ASKED = 1 << 20, 1024
#: Terms of questions, of about 50 bytes each, up to which they are broadcast.
BROADCAST = 1_000_000
#: What rounding may move a score by.
SLACK = 1e-3

_HEAD = "term string, n int, max_tf int, min_tf int, min_dl int, max_dl int"
_LISTS = "segment long, ids array<long>, tfs array<int>, dls array<int>"
_SCHEMA = f"{_HEAD}, {_LISTS}, block long, batch int, bucket int"


def _segments(listed: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of lists that hold at most ``most`` tokens together, or one longer list."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(listed), 0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to - at
        at = to


def _blocks(size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most ``size`` postings of segments of at most ``most`` tokens."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, listed = np.asarray(b.column(0)), b.column(1)
        dl = np.asarray(pc.fill_null(pc.list_value_length(listed), 0)).astype(np.int64)
        flat = pc.dictionary_encode(listed.flatten())
        key = np.asarray(flat.indices).astype(np.int64) * max(1, len(ids)) + np.repeat(np.arange(len(ids)), dl)
        key, tf = np.unique(key, return_counts=True)
        if not len(key):
            return None
        term, row = np.divmod(key, len(ids))
        order = np.lexsort((ids[row], dl[row], -tf, term))
        term, row, tf = term[order], row[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        nth = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        start = np.flatnonzero(nth % size == 0)
        ends = pa.array(np.append(start, len(term)), pa.int32())
        ints = lambda x: pa.array(x.astype(np.int32))
        length, over = dl[row], lambda f, x: ints(f.reduceat(x, start))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(ids[row]), ints(tf), ints(length))]
        segment = pa.array(np.full(len(start), ids[0]))
        heads = [ints(np.diff(np.append(start, len(term)))), over(np.maximum, tf), over(np.minimum, tf), over(np.minimum, length), over(np.maximum, length)]
        return pa.RecordBatch.from_arrays(
            [flat.dictionary.take(pa.array(term[start])), *heads, segment, *lists], ["term", "n", "max_tf", "min_tf", "min_dl", "max_dl", "segment", "ids", "tfs", "dls"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in _segments(b.column(1), most):
                made = work(b.slice(at, n))
                if made is not None:
                    yield made

    return run


def _weight(tf: Column, dl: Column, mean: float) -> Column:
    return F.round(tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / F.lit(mean))), 6)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


FOUND = "q long, id long, score double"


def _best(k: int, mean: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each question's k best documents of one segment, from the segment's blocks and (question, block) pairs."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        lists = {c: blocks[c].combine_chunks() for c in ("ids", "tfs", "dls")}
        flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists["ids"]), np.int64)))
        tf, norm = flat["tfs"].astype(np.float64), (1 - B) + B * flat["dls"] / mean
        weight = _rounded(tf * (K1 + 1) / (tf + K1 * norm))
        ids, at = np.unique(flat["ids"], return_inverse=True)
        held = blocks.select(["term", "block"]).to_pandas()
        held["i"] = np.arange(len(held))
        met = asked.to_pandas().merge(held, on=["term", "block"]).sort_values(["q", "order", "i"], kind="stable")
        if len(met):
            q, i, wq, factor = (met[c].to_numpy() for c in ("q", "i", "wq", "factor"))
            cut, parts = np.flatnonzero(np.diff(q)) + 1, []
            for a, b in zip(np.append(0, cut), np.append(cut, len(q)), strict=True):
                spans = [(slice(ends[j], ends[j + 1]), x, f) for j, x, f in zip(i[a:b], wq[a:b], factor[a:b], strict=True)]
                row = np.concatenate([at[s] for s, _, _ in spans])
                score = _rounded(np.bincount(row, np.concatenate([x * weight[s] * f for s, x, f in spans]), len(ids)))
                seen = np.zeros(len(ids), bool)
                seen[row] = True
                some = np.flatnonzero(seen)
                if len(some) > k:
                    some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
                some = some[np.lexsort((ids[some], -score[some]))[:k]]
                parts.append((np.full(len(some), q[a]), ids[some], score[some]))
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.table({"q": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """Rows that are few enough go to every task, so that the index stays where it is; others are shuffled with it."""
    return F.broadcast(rows) if n <= BROADCAST else rows


class TermIndex:
    """The index in the folder ``path``, which may be remote; ``buckets`` must be the same for all additions."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of the whole batches."""
        found = stored(self.spark, f"{self.path}/{name}", schema)
        return found if name == "totals" else found.where(F.col("batch").isin(self.batches()))

    def _totals(self) -> DataFrame:
        return self._read("totals", "n_docs long, n_tokens long, batch int")

    def batches(self) -> list[int]:
        return sorted(r[0] for r in self._totals().select("batch").distinct().collect())

    def lengths(self) -> DataFrame:
        """(doc_id, dl) of all documents that are indexed."""
        return self._read("lengths", "doc_id long, dl long, batch int").select("doc_id", "dl")

    def blocks(self) -> DataFrame:
        return self._read("postings", _SCHEMA)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> int:
        """Indexes the documents whose id isn't indexed yet, as one batch; tells how many they are."""
        given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        done = self.batches()
        fresh = one_each(given.join(self.lengths().select("doc_id"), "doc_id", "left_anti") if done else given, "doc_id")
        if fresh.isEmpty():
            return 0
        batch = max(done, default=-1) + 1
        at = lambda name: f"{self.path}/{name}/batch={batch}"
        counts = fresh.select("doc_id", F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("dl"))
        counts.write.mode("overwrite").parquet(at("lengths"))
        written = self.spark.read.schema("doc_id long, dl long").parquet(at("lengths"))
        totals = written.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))
        ship(self.spark)
        made = fresh.select("doc_id", tokens(F.col("text")).alias("t")).mapInArrow(_blocks(BLOCK, SEGMENT), f"{_HEAD}, {_LISTS}")
        named = made.withColumn("block", F.xxhash64("ids")).withColumn("bucket", self._bucket())  # no two blocks of a term have an id in common
        dealt = named.repartition("bucket", F.pmod(F.col("block"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        totals.write.mode("overwrite").parquet(at("totals"))
        return totals.first()[0]

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")

    def search(self, queries: DataFrame, k: int, idf: bool = False) -> DataFrame:
        """query_id, id, score, rank: the k best documents by the dot product of term weights, as ``retrieve.sparse`` has them."""
        n, total = self._totals().agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        mean = total / n if total else 1.0
        ship(self.spark)
        names = staged(queries.select("query_id").where("query_id is not null").distinct().withColumn("q", F.monotonically_increasing_id()), "questions")
        n_questions = names.count()
        counts = term_counts(queries, "query_id").join(_sent(names, n_questions), "query_id").select("q", "term", _weight(F.col("tf"), F.col("dl"), mean).alias("wq"))
        asked = staged(counts.groupBy("q", "term").agg(F.sum("wq").alias("wq")).withColumn("bucket", self._bucket()), "asked")
        # The buckets are a bounded list, and so prune folders when the plan is made.
        per = asked.groupBy("bucket").count().collect()
        n_terms, key = sum(r[1] for r in per), ["bucket", "term"]
        stored = lambda: self.blocks().where(F.col("bucket").isin([r[0] for r in per]))
        most, least = _weight(F.col("max_tf"), F.col("min_dl"), mean), _weight(F.col("min_tf"), F.col("max_dl"), mean)
        heads = stored().select("segment", "block", "batch", *key, "n", most.alias("most"), least.alias("least"))
        # The least weight of a term's k-th document: that of the block in which it is, blocks taken from the best one on.
        better = Window.partitionBy(*key).orderBy(F.desc("least"), "batch", "block").rowsBetween(Window.unboundedPreceding, 0)
        kth = F.when(F.sum("n").over(better) >= k, F.col("least")).otherwise(F.lit(0.0))
        held = heads.join(_sent(asked.select(*key).distinct(), n_terms), key, "left_semi").withColumn("kth", kth)
        terms = held.groupBy(*key).agg(F.max("most").alias("top"), F.max("kth").alias("kth"), F.sum("n").alias("df"))
        factor = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
        valued = staged(asked.join(terms, key).withColumn("factor", factor).withColumn("share", F.col("wq") * F.col("factor")), "terms")
        limits = valued.groupBy("q").agg(F.sum(F.col("share") * F.col("top")).alias("all"), F.max(F.col("share") * F.col("kth")).alias("limit"))
        # A block can reach a question's limit if its best weight is at least ``need``.
        need = (F.col("limit") - SLACK - F.col("all")) / F.col("share") + F.col("top")
        wanted = staged(valued.join(limits, "q").select("q", *key, "wq", "factor", need.alias("need")), "wanted")
        # Blocks of one segment of documents meet in one task, and with them all that a document's score is made of.
        down = max(1, -(-n_questions // ASKED))
        every = F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("group")
        needed = wanted.groupBy(*key).agg(F.min("need").alias("need"))
        opened = stored().join(_sent(needed, n_terms), key).where(most >= F.col("need"))
        lists = opened.select("segment", "term", "block", "ids", "tfs", "dls", every)
        pairs = heads.join(_sent(wanted, n_terms), key).where(F.col("most") >= F.col("need")).select(
            "segment", F.pmod(F.xxhash64("q"), F.lit(down)).cast("int").alias("group"), "term", "block", F.xxhash64("term").alias("order"), "q", "wq", "factor"
        )
        met = ["segment", "group"]
        found = lists.groupBy(*met).cogroup(pairs.groupBy(*met)).applyInArrow(_best(k, mean), FOUND)
        return ranked(found.join(_sent(names, n_questions), "q").select("query_id", "id", "score"), k)
