"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most three bits differ in at most one bit in one of the segments, so
they agree on that segment with one bit masked out. Each distinct fingerprint is
therefore indexed under 64 keys (2 segments x 32 masked bits); an equality shuffle
on the key brings every candidate pair together, and the pair is verified by its
Hamming distance. Within a key no list of pairs leaves the task: a key yields at
most one link per fingerprint, to the first member of its connected part, which
keeps the same components. Copies meet as one fingerprint before any of this.

A segment value that more than half of ``TILED`` distinct fingerprints share makes hot keys, which are
indexed once more in the same way: the other segment is cut into two halves of 16 bits, one of which
differs by at most one bit, so 32 one-wildcard variants of the halves split the key. What agrees in a key
and a variant of it differs in 18 bits only, so no more than 2**18 fingerprints ever meet in one task's group.

Components are found by label propagation with hooking and pointer jumping: joins
and pre-aggregated minima over the links only, each round written to the shared
folder. Nothing about documents or links is collected by the driver.

Defined results. Null or empty text: fingerprint zero, linked like any other.
Fewer than three words: the whole sequence is the one shingle. Very long texts: hashed in
parts. A null doc_id keeps its row; its component_id is the smallest id of the others, or null; any
long is an id. Repeated rows and ties: one result row each; ``deduplicated`` keeps the smallest id, null ids
last, of several rows with that id the one with the least row hash, and of equal rows one. Empty table: empty
result. Extra columns are ignored by ``simhash_components`` and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collecting, mapped, remove, row_hash, row_struct, staged

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Parts into which the rows of one node or label are dealt in the joins of ``components``.
SALTS = 8
#: Members of one key up to which all pairs are compared in tiles; above it each
#: member looks its neighbours up by value, which is linear in the members. Keys that
#: may have more are split.
TILED = 16384


def fingerprint(text: str | None) -> int:
    """SimHash over 3-word shingles, repeats included; 0 for a text without words."""
    if not text:
        return 0
    # On bytes, lower() and split() act on ASCII letters and ASCII blanks only.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - SHINGLE + 1].tolist()
        cuts = map(slice, starts, ends[SHINGLE - 1 :].tolist())
        hashes = list(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)))
    half, bits = len(hashes), np.zeros(64, np.int64)
    for at in range(0, half, 65536):  # a bounded bit matrix for any text
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > half, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), "<u8", b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f.view("<i8"))], ["doc_id", "content", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fp): a hash of the row, and the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text), row_hash(docs).alias("content"))
    return mapped(rows, _fingerprints, "doc_id long, content long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """(fp, s, v, o): for both segments s its value v and the other one's o."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    return fps.selectExpr("fp", f"inline(array(struct(0 as s, {low} as v, {high} as o), struct(1 as s, {high} as v, {low} as o)))")


def _hot(segments: DataFrame) -> DataFrame:
    """(s, v, hot): bit b of ``hot`` is set if the key of segment value v without bit b may be a hot one."""
    shared = staged(segments.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILED // 2), "shared")
    near = "concat(array(struct(v, 4294967295L as hot)), transform(sequence(0, 31), b -> struct(v ^ shiftleft(1L, b) as v, shiftleft(1L, b) as hot)))"
    return shared.select("s", F.expr(f"inline({near})")).groupBy("s", "v").agg(F.bit_or("hot").alias("hot"))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp) for the 64 one-wildcard segment variants of each fingerprint, hot ones split by 32 more.

    The key holds the masked bit's place (0 to 63) over the masked segment over the second variant, or 0.
    """
    segments = _segments(fps)
    hot = _hot(segments)
    if hot.isEmpty():
        marked = segments.withColumn("hot", F.lit(0).cast("long"))
    else:  # the values to look up are the ones with the most rows
        each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = segments.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        marked = salted.join(hot.select("*", each), ["s", "v", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long")))
    plain = "shiftleft(cast(s * 32 + b as bigint), 32) | (v & ~shiftleft(1L, b))"
    half = "if(c < 16, o & 65535L, shiftrightunsigned(o, 16)) & ~shiftleft(1L, c % 16)"
    more = f"if(hot & shiftleft(1L, b) != 0, transform(sequence(0, 31), c -> 1L + (shiftleft(cast(c as bigint), 16) | ({half}))), array(0L))"
    return marked.select("*", F.expr("explode(sequence(0, 31)) as b")).selectExpr("fp", f"shiftleft({plain}, 22) as k", f"explode({more}) as second").selectExpr(
        "k | second as key", "fp"
    )


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of both ends of each link (a, b); ``label`` holds each place's first member."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _balls(fp: np.ndarray, label: np.ndarray) -> None:
    """Links by value: looks up all values within three bits of each of the sorted ``fp``."""
    one = [np.uint64(1) << np.uint64(i) for i in range(64) if ((fp ^ fp[0]) >> np.uint64(i) & np.uint64(1)).any()]
    masks = [*one]
    masks += [x | y for i, x in enumerate(one) for y in one[:i]]
    masks += [x | y | z for i, x in enumerate(one) for j, y in enumerate(one[:i]) for z in one[:j]]
    for m in masks:
        at = np.searchsorted(fp, fp ^ m)
        at[at == len(fp)] = 0
        hit = np.flatnonzero(fp[at] == fp ^ m)
        if len(hit):
            _spread(label, hit, at[hit])


def _tiles(fp: np.ndarray, label: np.ndarray) -> None:
    for i in range(0, len(fp), 512):
        a, b = np.nonzero(np.bitwise_count(fp[i : i + 512, None] ^ fp[None, i:]) <= MAX_BITS)
        _spread(label, a + i, b + i)


def bucket_links(fp: np.ndarray) -> np.ndarray:
    """For the sorted, distinct fingerprints of one key: the place of each one's first connected member."""
    label = np.arange(len(fp))
    (_tiles if len(fp) <= TILED else _balls)(fp, label)
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key. Small keys are compared all at once, by distance in the order.

    A large key is sorted here as unsigned: Spark's order of signed longs is another one.
    """

    def work(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size, a, b = end - start, [], []
        big = size > 64
        step = np.repeat(np.where(big, 0, size), size)
        for d in range(1, int(step.max(initial=1))):
            i = np.flatnonzero((step[:-d] > d) & (key[d:] == key[:-d]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
            a.append(i)
            b.append(i + d)
        label = np.arange(len(key))
        if a:
            _spread(label, np.concatenate(a), np.concatenate(b))
        for s, e in zip(start[big], end[big], strict=True):
            fp[s:e].sort()
            label[s:e] = s + bucket_links(fp[s:e])
        i = np.flatnonzero(label != np.arange(len(key)))
        pairs = np.unique(np.stack([fp[label[i]], fp[i]], axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        k = np.asarray(batch.column(0))
        if not len(k):
            continue
        parts.append((k, np.asarray(batch.column(1)).view(np.uint64)))
        if k[0] == k[-1] and len(parts) > 1 and k[-1] == parts[-2][0][-1]:
            continue  # the key goes on
        held_k, held_f = (np.concatenate(x) for x in zip(*parts, strict=True))
        whole = int(np.searchsorted(held_k, held_k[-1]))  # all but the last key, which may go on
        parts = [(held_k[whole:], held_f[whole:])]
        if whole:
            yield work(held_k[:whole], held_f[:whole])
    if parts and len(parts[-1][0]):
        yield work(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints whose components are those of all links of <= 3 bits."""
    keyed = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    return mapped(keyed, _links, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the same smallest node for all nodes that links connect.

    ``edges`` (a, b) is read from where it is staged. Each round takes the least
    label among neighbours, hooks it onto the node's own root and jumps pointers;
    the number of rounds grows with the logarithm of the longest chain.
    """
    both = staged(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))),
        "edges",
    )
    spark = edges.sparkSession
    with collecting() as old:
        labels = staged(
            both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels"
        )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).alias("salt")
    for _ in range(max_rounds):
        with collecting() as made:
            near = (
                both.select("u", "v", salt("u"))
                .join(labels.select(F.col("node").alias("v"), "label", each), ["v", "salt"])
                .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
            )
            seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
            hooks = seen.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
            hooked = staged(
                seen.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("low", "hook").alias("label")),
                "hooked",
            )
            up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"), each)
            new = staged(
                hooked.select("*", salt("node")).join(up, ["label", "salt"], "left").select("node", "old", F.least("label", "up").alias("label")),
                "labels",
            )
        # What this round has read: the labels of the one before and those without their jumps.
        remove(spark, old + made[:-1])
        old, labels = made[-1:], new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(staged fingerprints of all rows; fp -> (label, component_id))."""
    rows = staged(fingerprints(docs, doc_id, text), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = staged(links(fps.select("fp")), "links")
    if edges.isEmpty():
        return rows, fps.select("fp", F.col("fp").alias("label"), F.col("first_id").alias("component_id"))
    named = fps.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows, named.join(least, "label").select("fp", "label", "component_id")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows, named = labelled(docs, doc_id, text)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, one for each component: that of the smallest doc_id.

    Rows are chosen by id and row hash; texts are shuffled once, to the chosen keys, and not sorted.
    """
    rows, named = labelled(docs, doc_id, text)
    first = rows.join(named, "fp").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("k"))
    key = lambda c: F.struct(F.col(c).cast("long").alias("doc_id"))  # a struct that holds a null equals another one
    keep = staged(first.select(key("k.doc_id").alias("_id"), F.col("k.content").alias("_content")), "kept")
    keyed = docs.select(row_struct(docs).alias("row"), key(f"`{doc_id}`").alias("_id"), row_hash(docs).alias("_content"))
    keys = ["_id", "_content"]
    repeated = rows.groupBy(key("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = staged(keep.join(repeated, keys, "left_semi"), "repeated")
    if twice.isEmpty():
        return keyed.join(keep.hint("shuffle_hash"), keys, "left_semi").select("row.*")
    once = keyed.join(keep.join(twice, keys, "left_anti").hint("shuffle_hash"), keys, "left_semi").select("row.*")
    return once.union(keyed.join(twice, keys, "left_semi").dropDuplicates(keys).select("row.*"))
