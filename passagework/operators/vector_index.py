"""A stored index of vectors in k-means cells: a query is compared with the cells nearest to it only.

Cells are fitted on a bounded sample; every row is stored, in the folder of its cell. How many cells a query probes is
measured when the index is made, from exact searches, so it follows the data; probing every cell gives exact results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import staged, stored
from . import retrieve

#: Rows that the cells are fitted on, at most: those with the least hashes.
SAMPLED = 65_536
#: Cells, at most; below that, the root of the number of rows. They go to every task: 4,096 x 1,024 parts are 16 MB.
CELLS = 4_096
#: Rows that are searched for exactly to choose the number of probed cells, and the share of their neighbours to be found.
ASKED, FOUND, NEIGHBOURS = 256, 0.98, 10
#: The cell of rows whose length isn't that of the fitted ones; queries of other lengths look here.
OTHER = -1

_ROW = "id long, v array<float>, label string, cell int"


def _cells(spark: SparkSession, centres: np.ndarray, n: int):
    """A column's function: the ``n`` cells nearest to a vector of unit length, nearest first."""
    sent = spark.sparkContext.broadcast(centres.astype(np.float32))

    def run(vectors: pd.Series) -> pd.Series:
        c = sent.value.astype(np.float64)
        half, out = (c * c).sum(axis=1) / 2, [[OTHER]] * len(vectors)
        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == c.shape[1]] if len(c) else []
        for a in range(0, len(at), 512):
            v = np.stack([vectors.iloc[i] for i in at[a : a + 512]]).astype(np.float64)
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            for i, row in zip(at[a : a + 512], np.argsort(half - v @ c.T, axis=1, kind="stable")[:, :n], strict=True):
                out[i] = row.tolist()
        return pd.Series(out)

    return F.pandas_udf(run, "array<int>")


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))


class VectorIndex:
    """Vectors (``id``, ``v``, ``label``) by cell in a Parquet folder that is only appended to.

    Rows without an id, and vectors that exact search leaves out (null, empty, a null, NaN or infinite part, no length), aren't
    stored. Rows of other lengths than the commonest share a cell of their own. Rows with one id are all stored if they come
    together; an id that is stored already is not added again. An empty table makes an empty index, whose cells are all ``OTHER``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.centres = np.empty((0, 0))
        self.probes = 1

    def _stored(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/vectors", _ROW)

    def fit(self, vectors: DataFrame) -> VectorIndex:
        """Makes the cells, stores all rows and measures how many cells must be probed."""
        ship(self.spark)
        rows = vectors.where(retrieve.usable(F.col("v"), "id"))
        length = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
        if length:
            alike = rows.where(F.size("v") == length["n"]).select("id", "v")
            sample = staged(alike.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLED), "sample")
            cells = min(CELLS, math.isqrt(length["rows"]))
            dealt = sample.repartition(self.spark.sparkContext.defaultParallelism)  # it was written by one task
            model = KMeans(k=max(2, cells), seed=1, maxIter=20).fit(dealt.select(array_to_vector(_unit(F.col("v"))).alias("features")))
            self.centres = np.array(model.clusterCenters())
        self.add(vectors)
        if length:
            self.probes = self._needed(sample)
        cells = [(i, c.tolist(), self.probes) for i, c in enumerate(self.centres)]
        self.spark.createDataFrame(cells, "cell int, centre array<double>, probes int").write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def load(self) -> VectorIndex:
        """Takes up an index that was made before."""
        made = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # CELLS at most
        if made:
            self.centres, self.probes = np.array([r["centre"] for r in made]), made[0]["probes"]
        return self

    def _needed(self, sample: DataFrame) -> int:
        """The cells to probe so that ``FOUND`` of the sampled queries' exact neighbours lie in them."""
        asked = staged(sample.orderBy(F.xxhash64("v", "id"), "id").limit(ASKED).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "asked")
        exact = retrieve.dense(asked, self._stored(), NEIGHBOURS).select("query_id", "id")
        order = asked.select("query_id", F.posexplode(_cells(self.spark, self.centres, len(self.centres))("q")).alias("place", "cell"))
        places = exact.join(self._stored().select("id", "cell"), "id").join(F.broadcast(order), ["query_id", "cell"])
        place = places.agg(F.percentile("place", FOUND)).first()[0]
        return 1 if place is None else math.ceil(place) + 1

    def add(self, vectors: DataFrame) -> None:
        """Stores the rows whose id isn't stored, in the cells that there are; run again, it adds nothing."""
        ship(self.spark)
        rows = vectors.where(retrieve.usable(F.col("v"), "id")).select("id", F.col("v").cast("array<float>").alias("v"), F.col("label").cast("string").alias("label"))
        new = rows.join(self._stored().select("id"), "id", "left_anti")
        placed = new.withColumn("cell", F.element_at(_cells(self.spark, self.centres, 1)("v"), 1))
        # Ranges of equal size: small cells share a task and are one file each, a cell with most of the rows is dealt over several tasks.
        dealt = placed.repartitionByRange(self.spark.sparkContext.defaultParallelism, "cell", F.xxhash64("id"))
        dealt.write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, same: bool = False) -> DataFrame:
        """query_id, id, score, rank of the ``k`` best by (cosine descending, id), from (``query_id``, ``q``, and ``label`` if ``same``).

        ``exact`` reads every cell: all rows and queries meet in a grid of blocks of bounded size, whatever their cells, so small cells don't
        each cost a block. Otherwise cells and their queries meet in blocks of bounded size: a cell that many rows share, or that
        many queries probe, is split over tasks. Only probed cells are read.
        """
        if exact:
            return retrieve.dense(queries, self._stored(), k, "label" if same else None)
        n = min(probes or self.probes, len(self.centres))
        label = (F.col("label").cast("string") if same else F.lit("")).alias("_label")
        asked = queries.where(retrieve.usable(F.col("q"), "query_id")).select(
            "query_id", "q", label, F.size("q").alias("_length"), F.explode(_cells(self.spark, self.centres, max(1, n))("q")).alias("cell")
        )
        asked = staged(asked.where("_label is not null"), "probes")
        probed = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row a cell
        rows = self._stored().where(F.col("cell").isin(list(probed)))
        sizes = rows.groupBy("cell").count().collect()  # a row a cell, of the folders' names and the files' counts
        split = [(r["cell"], -(-probed[r["cell"]] // retrieve.QUERIES), -(-r["count"] // retrieve.VECTORS)) for r in sizes]
        blocks = F.broadcast(self.spark.createDataFrame(split, "cell int, down int, across int"))
        group = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = asked.join(blocks, "cell").select("query_id", "q", "_label", "_length", "cell", group("query_id", "down").alias("row"), every("across").alias("column"))
        right = rows.join(blocks, "cell").select("id", "v", label, F.size("v").alias("_length"), "cell", every("down").alias("row"), group("id", "across").alias("column"))
        met = ["cell", "row", "column", "_length", "_label"]
        found = left.groupBy(*met).cogroup(right.where("_label is not null").groupBy(*met)).applyInArrow(retrieve.cell_scores(retrieve.nearest(k)), retrieve.SCORED)
        return retrieve.ranked(found, k)
