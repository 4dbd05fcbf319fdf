"""Quality classifier: regularised quadratic discriminant on document statistics.

Statistics of each whole text are taken once (one pass over the texts) and transformed
so that they are roughly normal. Per class, sums and outer products are added up in each
task and then over tasks, so all labelled rows count and only matrices of the number of
statistics squared reach the driver. The class covariances are shrunk towards their pooled
covariance and its diagonal; scores are differences of Mahalanobis log densities through
Cholesky factors that are computed once.

Defined results. Null or empty text: the statistics of no words, scored like any other. Very long
texts: taken whole. Ties and repeated rows: each row is scored by itself, equal texts alike; sums of floats depend on
the order of tasks, so scores may differ in their last bits between runs. Null
labels or ids are not learnt from; repeated label rows count as often as they come. A class
without rows: the score is the share of label 1 (one half if there are no labels). Null ids
are scored and not held out. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged

FEATURES = (
    "words", "mean_word", "distinct", "lines", "duplicate_lines", "upper", "digits", "symbols", "exclaims",
    "bars", "stops", "commas", "long_words", "non_ascii", "single", "top_word",
)
#: Shares of the pooled covariance, and of its diagonal within that.
SHRINK, DIAGONAL = 0.2, 0.1
THRESHOLD = 0.7
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&<>@^_~{}[]\\=+", np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text: logs of counts, square roots of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(raw) - int(count[9:14].sum() + count[32]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    shares = np.array(
        [
            len(kinds) / n, 1 - len(set(lines)) / max(1, len(lines)),
            count[_UPPER].sum() / chars, count[_DIGIT].sum() / chars, count[_SYMBOL].sum() / chars,
            count[33] / n, count[124] / n, count[46] / n, count[44] / n,
            sum(len(w) > 15 for w in words) / n, count[128:].sum() / chars,
            sum(len(w) == 1 for w in words) / n, max(kinds.values(), default=0) / n,
        ]
    )
    roots = np.sqrt(np.clip(shares, 0, 4))
    return np.concatenate(
        ([np.log1p(len(words)), np.log1p(chars / n)], roots[:1], [np.log1p(n / max(1, len(lines)))], roots[1:])
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t.as_py()) for t in b.column(1)]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
        sizes = pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(sizes, flat)], ["doc_id", "x"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): an array in the order of ``FEATURES``."""
    return mapped(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)), _features, "doc_id long, x array<double>"
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    sums = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
    for b in batches:
        label = b.column(0).to_numpy(zero_copy_only=False)
        x = np.hstack([np.ones((b.num_rows, 1)), _matrix(b.column(1))])
        for c, s in sums.items():
            s += x[label == c].T @ x[label == c]
    for c, s in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([c] * s.size, pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], ["label", "at", "sum"]
        )


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log terms of the two classes."""

    share: float
    means: tuple[np.ndarray, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()
    offsets: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not self.means:
            return np.full(len(x), self.share)
        logs = [k - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, k in zip(self.means, self.inverses, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Model:
    """From (label 0 or 1, x)."""
    d = len(FEATURES)
    rows = (
        mapped(labelled.select(F.col("label").cast("int").alias("label"), "x"), _moments, "label int, at int, sum double")
        .groupBy("label", "at").agg(F.sum("sum").alias("sum")).collect()
    )  # 2 * (d + 1)**2 rows, however many documents
    sums = np.zeros((2, (d + 1) ** 2))
    for r in rows:
        sums[r["label"], r["at"]] = r["sum"]
    sums = sums.reshape(2, d + 1, d + 1)
    n = sums[:, 0, 0]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if not n.all():
        return Model(share)
    means = [s[0, 1:] / s[0, 0] for s in sums]
    scatter = [s[1:, 1:] - s[0, 0] * np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pooled = sum(scatter) / n.sum()
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    inverses, offsets = [], []
    for s, k in zip(scatter, n, strict=True):
        factor = np.linalg.cholesky((1 - shrink) * s / k + shrink * pooled)
        inverses.append(np.linalg.inv(factor))
        offsets.append(float(np.log(k / n.sum()) - np.log(np.diag(factor)).sum()))
    return Model(share, tuple(means), tuple(inverses), tuple(offsets))


def held_out(doc_id: str = "doc_id"):
    """Whether the crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labelled rows that aren't held out."""
    x = staged(features(docs), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out())
    model = fit(x.join(known, "doc_id").select("label", "x"))
    return mapped(
        x.select("doc_id", held_out().alias("held_out"), "x"), _scores(model), "doc_id long, held_out boolean, score double, predicted int"
    )


def crc_mod(doc_id: int) -> int:
    """The remainder by which rows are held out, for checks outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 4
