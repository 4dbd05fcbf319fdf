"""Jaccard join of word n-grams through a grouped prefix join.

A document is the set of its distinct 4-word shingles, as 64-bit hashes. Two documents link at a similarity
of 85 % or more, so they share at least 85 % of the larger set's shingles, and therefore one of the first
15 % (and one more) of each in any common order: the prefix. The order puts frequent shingles last, so that
passages which many documents share aren't in the prefix of a document that has other words.

Documents with the same prefix and size are one group. Groups that share a prefix shingle are paired, filtered by
size and by the places of the shingle, and only then expanded to members, whose whole sets are compared.

What keeps it linear where many documents are alike: equal sets are one class from the start. Buckets of more
than ``SMALL`` groups try each group with its first fitting one and ``TRIED`` others, and again, as long as that finds
links, with others of another component; only groups whose components still differ after that are compared each with each. All links found
count for components, and no pair of different components goes uncompared, so the components are those of all links.

How often a shingle occurs is counted over all documents, by 32-bit slots of the hashes, two bytes each. The at
most ``MOST_HOT`` most frequent slots (16 MB) go to every task; they decide on the order only, never on results.
The texts of compared documents are found by a broadcast of their keys up to ``BROADCAST`` of them, by a shuffle beyond.

Defined results. Null text, empty text, text without words: size 0, linked with nothing, its own component. Fewer
than four words: the whole sequence is the one shingle. Very long texts: whole, in pieces of bounded
memory but for the set itself. Null doc_id: keeps its row; its component is the smallest id of the others, or null.
Repeated rows and ties: one result row each. Empty table: no rows. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged
from .simhash_dedup import components

WORDS = 4
#: Percent of the united set that two documents must share.
SIMILAR = 85
#: Groups of one shingle up to which all pairs are taken at once.
SMALL = 8
#: In larger ones, how many others each group is tried with, and how far apart, time after time.
TRIED, STRIDES = 8, (1, 3, 31, 211)
#: Occurrences from which a slot of shingles counts as frequent, and how many such slots are used.
FREQUENT, MOST_HOT = 4, 1 << 22
#: Compared classes whose keys are broadcast to find their texts, and pairs that are broadcast to their sets.
BROADCAST = 1_000_000
#: Parts of the pairs of a bucket or group of more than ``HOT`` members, so that the set of its first member isn't met in one task.
SALTS, HOT = 32, 1024
#: Entries of the table that tells most of the other slots from frequent ones.
SIEVE = 1 << 24
#: Groups that a task remembers, so that copies don't give their prefix again.
SEEN = 1 << 20
#: Bytes of text worked on at a time, and shingles counted at a time.
BLOCK, COUNTED = 1 << 21, 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[:] = made
    return _powers


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: a polynomial over its lower-cased bytes, from running sums, then mixed."""
    arr = np.frombuffer(text + b"\n", np.uint8)
    blank = _BLANK[arr]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(arr) + 1)
    sums = np.zeros(len(arr) + 1, _U)
    np.cumsum((_LOWER[arr].astype(_U) + _U(1)) * power[: len(arr)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)), start


def _blocks(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text, several short texts at a time; a long one in pieces that end at blanks."""
    held: list[bytes] = []
    size = 0

    def joined() -> list[np.ndarray]:
        hashes, start = word_hashes(b"\n".join(held))
        at = np.cumsum([0, *(len(t) + 1 for t in held)])
        cut = np.searchsorted(start, at)
        return [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    for t in texts:
        if held and size + len(t) > BLOCK:
            yield from joined()
            held, size = [], 0
        if len(t) <= BLOCK:
            held.append(t)
            size += len(t) + 1
            continue
        if held:
            yield from joined()
            held, size = [], 0
        parts, at = [], 0
        while at < len(t):
            end = min(len(t), at + BLOCK)
            while end < len(t) and not _BLANK[t[end]]:
                end += 1
            parts.append(word_hashes(t[at:end])[0])
            at = end
        yield np.concatenate(parts)
    if held:
        yield from joined()


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted, distinct shingles of a sequence of word hashes."""
    n = min(WORDS, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, _U)
    for k in range(n):
        total = total * _U(0x2545F4914F6CDD1D) + words[k : len(words) - n + 1 + k]
    return np.unique(_mix(total))


def _encoded(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, in order."""
    return map(shingles, _blocks(_encoded(column)))


# How often: a slot is the upper half of a hash. Its upper ten bits name a part, the next six a block of the part.

PARTS, INNER = 1024, 64


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, slots): the slots of a lot of documents, sorted; 64 counts and then two bytes each."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(held))
        high = (slots >> np.uint32(16)).astype(np.int64)
        count = np.bincount(high, minlength=PARTS * INNER).astype("<u4").reshape(PARTS, INNER)
        cut = np.concatenate(([0], np.cumsum(count.sum(axis=1, dtype=np.int64))))
        low = (slots & np.uint32(0xFFFF)).astype("<u2")
        some = np.flatnonzero(np.diff(cut))
        blobs = [count[p].tobytes() + low[cut[p] : cut[p + 1]].tobytes() for p in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["part", "slots"])

    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for s in sets(b.column(0)):
            held.append((s >> _U(32)).astype(np.uint32))
            size += len(s)
            if size >= COUNTED:
                yield emit(held)
                held, size = [], 0
    if size:
        yield emit(held)


def _counted(least: int) -> Callable:
    """Rows arrive sorted by part; gives the slots that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, dense = None, [], 0, None

        def fold() -> None:
            nonlocal dense, held, size
            if dense is None:
                dense = np.zeros(INNER << 16, np.int64)
            dense += np.bincount(np.concatenate(held), minlength=INNER << 16)
            held, size = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal dense, held, size
            if dense is None:
                slot, n = np.unique(np.concatenate(held), return_counts=True)
            else:
                if held:
                    fold()
                slot = np.flatnonzero(dense)
                n = dense[slot]
            keep = n >= least
            out = pa.RecordBatch.from_arrays(
                [pa.array((part << 22) + slot[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["slot", "n"]
            )
            held, size, dense = [], 0, None
            return out

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield emit()
                    part = p
                count = np.frombuffer(blob, "<u4", INNER)
                held.append((np.repeat(np.arange(INNER), count) << 16) + np.frombuffer(blob, "<u2", offset=4 * INNER))
                size += len(held[-1])
                if size > 1 << 22:
                    fold()
        if part is not None:
            yield emit()

    return run


def frequent(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(slots, levels): at most ``MOST_HOT`` frequent slots, sorted, and the logarithm of how often they occur."""
    parts = mapped(docs.select(F.col(text)), _slots, "part int, slots binary")
    counted = staged(mapped(parts.repartition("part").sortWithinPartitions("part"), _counted(FREQUENT), "slot long, n long"), "slots")
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = sorted((r[0], r[1]) for r in counted.groupBy(level).count().collect())
    while sizes and sum(n for _, n in sizes) > MOST_HOT:
        sizes.pop(0)
    if not sizes:
        return np.empty(0, np.uint32), np.empty(0, np.int8)
    rows = counted.select("slot", level).where(F.col("level") >= sizes[0][0]).toArrow()
    slot = np.asarray(rows["slot"]).astype(np.uint32)
    order = np.argsort(slot)
    return slot[order], np.asarray(rows["level"]).astype(np.int8)[order]


def least_shared(n: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-SIMILAR * n // 100)


def _described(hot) -> Callable:
    """doc_id, text hash, size, the set's and the group's hash and the prefix of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, levels = hot.value
        given: set[int] = set()
        sieve = np.zeros(SIEVE, bool)
        sieve[slots & np.uint32(SIEVE - 1)] = True

        def ordered(s: np.ndarray) -> np.ndarray:
            slot = (s >> _U(32)).astype(np.uint32)
            maybe = np.flatnonzero(sieve[slot & np.uint32(SIEVE - 1)])
            if not len(maybe):
                return s
            at = np.minimum(np.searchsorted(slots, slot[maybe]), len(slots) - 1)
            level = np.zeros(len(s), np.int8)
            level[maybe] = np.where(slots[at] == slot[maybe], levels[at], 0)
            return s[np.argsort(level, kind="stable")]

        for b in batches:
            size, sid, gid, prefix = [], [], [], []
            for s in sets(b.column(2)):
                n = len(s)
                first = np.ascontiguousarray(ordered(s)[: n - least_shared(n) + 1] if n else s)
                size.append(n)
                sid.append(xxhash.xxh64_intdigest(s.tobytes()))
                gid.append(xxhash.xxh64_intdigest(first.tobytes(), n & 0xFFFFFFFF))
                if gid[-1] in given:  # a group's prefix is given once in a task
                    first = first[:0]
                elif len(given) < SEEN:
                    given.add(gid[-1])
                prefix.append(first.view(np.int64))
            longs = lambda x: pa.array(np.array(x, _U).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32())
            flat = pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), longs(sid), longs(gid), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "content", "n", "sid", "gid", "prefix"],
            )

    return run


def _fits(na: np.ndarray, pos_a: np.ndarray, nb: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose first common shingle has these places can be similar enough."""
    most = np.minimum(na - pos_a, nb - pos_b)
    return (100 + SIMILAR) * most >= SIMILAR * (na + nb)


def bucket_pairs(n: np.ndarray, pos: np.ndarray, label: np.ndarray | None, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one bucket, whose groups are sorted by size: those that fit and aren't of one label (0: of several).

    With a ``stride``, each group's first fitting one and ``TRIED`` others at multiples of it, else all.
    """
    k = len(n)
    parts = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        near = (i != j) & _fits(n[i], pos[i], n[j], pos[j])
        if label is not None:
            near &= (label[i] != label[j]) | (label[i] == 0)
        parts.append((np.minimum(i[near], j[near]), np.maximum(i[near], j[near])))

    if stride:
        all_ = np.arange(k)
        take(np.searchsorted(100 * n, SIMILAR * n), all_)
        for d in range(1, TRIED + 1):
            take(all_, (all_ + d * stride) % k)
    else:
        for a in range(0, k, 512):
            i, j = np.nonzero(np.arange(a, min(a + 512, k))[:, None] < np.arange(k)[None, :])
            take(i + a, j)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _buckets(stride: int, first: bool, few: int) -> Callable:
    """Rows (token, gid, n, pos, label) arrive sorted by token and size; gives pairs of groups.

    The first time, buckets of up to ``few`` rows give all pairs and larger ones their rows as well, for the next times.
    """

    def work(token, gid, n, pos, label) -> pa.RecordBatch:
        new = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1]))
        token, gid, n, pos, label = (c[new] for c in (token, gid, n, pos, label))
        cut = np.flatnonzero(np.diff(token)) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(token)]))
        size = end - start
        small = (size <= few) & first
        step, a, b = np.repeat(np.where(small, size, 0), size), [], []
        for d in range(1, int(step.max(initial=1))):
            i = np.flatnonzero((step[:-d] > d) & (token[d:] == token[:-d]))
            near = _fits(n[i], pos[i], n[i + d], pos[i + d])
            a.append(i[near])
            b.append(i[near] + d)
        large, crowd = np.zeros(len(token), bool), np.repeat(size > HOT, size)
        for s, e in zip(start[~small], end[~small], strict=True):
            i, j = bucket_pairs(n[s:e], pos[s:e], None if first else label[s:e], stride)
            a.append(i + s)
            b.append(j + s)
            large[s:e] = True
        x, y = np.concatenate([*a, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.empty(0, np.int64)]).astype(np.int64)
        hot = crowd[x]
        pairs = np.unique(np.stack([np.minimum(gid[x], gid[y]), np.maximum(gid[x], gid[y]), hot.astype(np.int64)], axis=1), axis=0)
        again = np.flatnonzero(large) if first else np.empty(0, np.int64)
        cols = [
            np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(again), np.int32)]),
            np.concatenate([pairs[:, 0], token[again]]), np.concatenate([pairs[:, 1], gid[again]]),
            np.concatenate([pairs[:, 2], n[again]]), np.concatenate([np.zeros(len(pairs), np.int64), pos[again]]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            if len(held) > 1 and cols[0][0] == cols[0][-1] == held[-2][0][-1]:
                continue  # the bucket goes on
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(whole[0] == whole[0][-1])[0])
            held = [[c[cut:] for c in whole]]
            if cut:
                yield work(*(c[:cut] for c in whole))
        if held:
            yield work(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


PAIRS = "kind int, a long, b long, n long, pos long"


def _paired(rows: DataFrame, stride: int, first: bool = False) -> DataFrame:
    sorted_rows = rows.select("token", "gid", "n", "pos", "label").repartition("token").sortWithinPartitions("token", "n", "gid")
    return mapped(sorted_rows, _buckets(stride, first, SMALL), PAIRS)


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [s.tobytes() for s in sets(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["sid", "set"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * shared >= SIMILAR * (len(x) + len(y) - shared):
                keep.append(i)
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The (a, b) of distinct ``pairs`` (a, b, hot) whose sets, from ``whole``, are similar."""
    hot = pairs.where("hot > 0").select(F.col("a").alias("sid")).distinct().withColumn("parts", F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt")
    left = whole.join(hot, "sid", "left").select(F.col("sid").alias("a"), F.col("set").alias("x"), salts)
    dealt = pairs.withColumn("salt", F.when(F.col("hot") > 0, F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0))
    few = pairs.count() <= BROADCAST
    both = whole.select(F.col("sid").alias("b"), F.col("set").alias("y")).join(F.broadcast(dealt) if few else dealt, "b").join(left, ["a", "salt"])
    return mapped(both.select("a", "b", "x", "y"), _similar, "a long, b long")


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hot").groupBy("a", "b").agg(F.max("hot").alias("hot"))


def _labels(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sid, gid, label): label is the component's, as far as the links go."""
    found = components(edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return staged(
        classes.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "gid", F.coalesce("label", "sid").alias("label")), "labelled"
    )


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows with doc_id, n and the hash of their set; sid -> component_id, or nothing where no row has words)."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent(docs, text))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    described = mapped(keyed, _described(hot), "doc_id long, content long, n long, sid long, gid long, prefix array<long>")
    rows = staged(described, "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("k")
    classes = staged(
        rows.where("n > 0").groupBy("sid").agg(first, F.min("gid").alias("gid")).select("sid", "gid", "k.doc_id", "k.content"), "classes"
    )
    tokens = rows.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    none = F.lit(0).cast("long").alias("label")
    found = staged(_paired(tokens.select("token", "gid", "n", F.col("pos").cast("long").alias("pos"), none), STRIDES[0], first=True), "group-pairs")
    as_pairs = lambda d: d.where("kind = 0").groupBy("a", "b").agg(F.max("n").alias("hot"))
    large = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("gid"), "n", "pos")
    groups = staged(classes.groupBy("gid").agg(F.min("sid").alias("lead"), F.count(F.lit(1)).alias("k")), "groups")

    def leads(pairs: DataFrame) -> DataFrame:
        one = lambda c: groups.select(F.col("gid").alias(c), F.col("lead").alias(f"{c}_lead"))
        return pairs.join(one("a"), "a").join(one("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"), "hot")

    pairs = staged(as_pairs(found), "pairs")
    own = classes.join(groups.where("k > 1"), "gid").select(F.col("lead").alias("a"), F.col("sid").alias("b"), (F.col("k") > HOT).cast("long").alias("hot"))
    tried = staged(_distinct(leads(pairs).union(own)), "tried")
    # Whole sets are made of what may be compared at any time.
    several = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct().union(groups.where("k > 1").select("gid")).union(large.select("gid")).distinct()
    wanted = staged(classes.join(several, "gid", "left_semi").select("sid", "doc_id", "content"), "wanted")
    id_of = lambda c: F.struct(F.col(c).alias("doc_id"))  # a struct that holds a null equals another one
    keys = wanted.select("sid", id_of("doc_id").alias("_id"), F.col("content").alias("_content"))
    texts = docs.select(F.struct(F.col(doc_id).cast("long").alias("doc_id")).alias("_id"), F.xxhash64(text).alias("_content"), F.col(text).alias("_text"))
    small = wanted.count() <= BROADCAST
    met = texts.join(F.broadcast(keys) if small else keys.hint("shuffle_hash"), ["_id", "_content"]).select("sid", "_text")
    made = mapped(met, _with_set, "sid long, set binary")
    repeated = rows.groupBy(id_of("doc_id").alias("_id"), F.col("content").alias("_content")).count().where("count > 1").join(keys, ["_id", "_content"], "left_semi")
    whole = staged(made if repeated.isEmpty() else made.dropDuplicates(["sid"]), "whole-sets")
    edges = staged(_verified(tried, whole), "links")
    label = _labels(classes, edges)

    def again(more: DataFrame) -> bool:
        """Compares those of the pairs of classes that weren't compared before; tells whether some link."""
        nonlocal tried, edges, label
        new = staged(_distinct(more).join(tried, ["a", "b"], "left_anti"), "tried")
        if new.isEmpty():
            return False
        linked = staged(_verified(new, whole), "links")
        tried = tried.union(new)
        if linked.isEmpty():
            return False
        edges = edges.union(linked)
        label = _labels(classes, edges)
        return True

    def labelled_rows() -> DataFrame:
        """The large buckets' rows, labelled where all members of the group have one label."""
        one = label.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return large.join(one, "gid").select("token", "gid", "n", "pos", F.when(F.expr("low = high and low <> 0"), F.col("low")).otherwise(F.lit(0).cast("long")).alias("label"))

    if not large.isEmpty():
        for stride in STRIDES[1:]:
            if not again(leads(as_pairs(_paired(labelled_rows(), stride)))):
                break
        pairs = staged(pairs.union(as_pairs(_paired(labelled_rows(), 0))).groupBy("a", "b").agg(F.max("hot").alias("hot")), "pairs")
    # Expansion: members of paired groups, and of one group, that are in different components as yet.
    mixed = label.groupBy("gid").agg((F.min("label") != F.max("label")).alias("mixed"), F.min("label").alias("one"))
    at = lambda c: mixed.select(F.col("gid").alias(c), F.col("mixed").alias(f"{c}_mixed"), F.col("one").alias(f"{c}_one"))
    open_pairs = pairs.join(at("a"), "a").join(at("b"), "b").where("a_mixed or b_mixed or a_one <> b_one").select("a", "b", "hot")
    inner = mixed.where("mixed").select(F.col("gid").alias("a"), F.col("gid").alias("b"), F.lit(0).cast("long").alias("hot"))
    member = lambda c: label.select(F.col("gid").alias(c), F.col("sid").alias(f"{c}_sid"), F.col("label").alias(f"{c}_label"))
    rest = open_pairs.union(inner).join(member("a"), "a").join(member("b"), "b").where("a_label <> b_label")
    again(rest.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), "hot"))
    ids = classes.select("sid", "doc_id").join(label, "sid")
    least = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows, ids.join(least, "label").select("sid", "component_id")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows, named = _classes(docs, doc_id, text)
    linked = rows.where("n > 0").select("doc_id", "n", "sid").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
