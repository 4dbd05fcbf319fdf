"""Language identification by character trigrams: counts by language, log odds by a join, the best language.

A text is the set of the trigrams of its words, which are padded by a mark at both ends. A language's weight for a trigram is the
logarithm of the share of its texts that have it, smoothed; a text's score is the sum over its trigrams and the
logarithm of the language's share of texts. A trigram that no text of the sample had says nothing.

The model goes to every task as long as it has at most ``BROADCAST`` trigrams in eight languages (or fewer in more); a text's trigrams are then looked up and summed in its
row, and nothing is shuffled. A larger model meets the trigrams by a shuffle. Languages are a list of at most ``MOST``.

Defined results. Texts without words: the most frequent language. Ties: the first language by code point. Rows without a
language or text don't teach; an empty sample makes no prediction (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from ..functions.text import tokens
from ..shipping import ship
from ..sources.tables import staged

BROADCAST, MOST = 1_000_000, 200
#: Trigrams that are looked up at a time.
LOOKED_UP = 1 << 20


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words: at every character but a word's last two, what stands there and the two that follow."""
    words = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    padded = F.concat(F.lit("_"), F.array_join(words, "_ _"), F.lit("_"))
    return F.when(F.size(words) > 0, F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=([^ ]{3}))[^ ]"), F.lit(1)))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Model:
    weights: DataFrame  # trigram, w: one weight for each language
    few: bool
    languages: list[str]
    prior: list[float]


def learned(sample: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """The model of the rows of ``sample``."""
    from math import log

    taught = sample.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("_l"), F.col(text).alias("_t"))
    sizes = sorted(map(tuple, taught.groupBy("_l").count().limit(MOST + 1).collect()), key=lambda r: r[0].encode())
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    total = sum(n for _, n in sizes)
    seen = taught.select("_l", F.explode(trigrams(F.col("_t"))).alias("trigram"))
    counts = seen.groupBy("trigram").agg(*(F.count(F.when(F.col("_l") == name, 1)).alias(f"c{i}") for i, (name, _) in enumerate(sizes)), F.count(F.lit(1)).alias("_n"))
    weights = staged(counts.select("trigram", F.array(*(F.log((F.col(f"c{i}") + 0.5) / F.lit(n + 1.0)) for i, (_, n) in enumerate(sizes))).alias("w")), "trigrams")
    return Model(weights, weights.count() * len(sizes) <= 8 * BROADCAST, [name for name, _ in sizes], [log(n / total) for _, n in sizes])


def _looked_up(sent, languages: list[str], prior: list[float]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The best language of each list of trigrams, by the broadcast trigrams and weights."""

    def best(listed: pa.ListArray, known: pa.Array, weights: np.ndarray) -> list[str]:
        n = np.asarray(pc.fill_null(pc.list_value_length(listed), 0)).astype(np.int64)
        at = np.asarray(pc.fill_null(pc.index_in(listed.flatten(), known), len(weights) - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(row, weights[at, i], len(n)) + p for i, p in enumerate(prior)]
        place = np.argmax(np.floor(np.stack(sums, axis=1) * 1e6 + 0.5), axis=1)  # the first of equal ones
        return [languages[i] for i in place.tolist()]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, weights = sent.value
        weights = np.vstack([weights, np.zeros((1, len(languages)))])  # what isn't known says nothing
        for c in columns:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(c), 0)), dtype=np.int64)
            out, at = [], 0
            while at < len(c):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED_UP, side="right")))
                out += best(c.slice(at, to - at), known, weights)
                at = to
            yield pa.array(out, pa.string())

    return run


def identified(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without their text, and ``predicted``."""
    kept = [c for c in rows.columns if c != text]
    if not model.languages:
        return rows.select(*kept, F.lit(None).cast("string").alias("predicted"))
    if model.few:
        spark = rows.sparkSession
        ship(spark)
        known = model.weights.toArrow()  # a bounded number of rows
        weights = np.array(known["w"].combine_chunks().flatten()).reshape(-1, len(model.languages))
        sent = spark.sparkContext.broadcast((known["trigram"].combine_chunks(), weights))
        named = F.arrow_udf(_looked_up(sent, model.languages, model.prior), "string", ArrowUDFType.SCALAR_ITER)
        return rows.select(*kept, named(trigrams(F.col(text))).alias("predicted"))
    numbered = rows.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("_id"), trigrams(F.col(text)).alias("_t"))
    keyed = numbered.select("row", "_id", F.explode_outer("_t").alias("trigram"))
    met = keyed.join(model.weights, "trigram", "left")
    sums = met.groupBy("_id").agg(F.any_value("row").alias("row"), *(F.sum(F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"s{i}") for i in range(len(model.languages))))
    scores = [F.struct(F.round(F.col(f"s{i}") + F.lit(p), 6).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(zip(model.languages, model.prior, strict=True))]
    return sums.select("row.*", F.array_max(F.array(*scores))["name"].alias("predicted"))
