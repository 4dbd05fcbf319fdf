"""Conversation prefix trie by preorder-interval encoding.

A node is a distinct sequence of first turns. It is known by its depth and by the exclusive or of hashes of its
turns and their places (128 bits), which are running values along a conversation. Nodes with the same
conversations below one another are a chain, known by its conversations' number and smallest id; a conversation's path is
the list of its chains. Distinct paths are ranked in lexicographic order, a chain's interval reaches from the first to the
last path that has it, and chains in order of (interval's start, depth) are in preorder. Prefix sums of nodes,
leaves and savings over that order, stored with each interval's end, give every subtree's sums by differences;
inside a chain the sum of what lies above is taken off.

Nothing is held by conversation or node in one task. Running values and totals by key (``within``) are made in
ranges of the sorted rows, which cut through a long conversation or a common prefix wherever it is; only one row for each
range and key meets by key. A path with k chains needs k conversations that leave it one after another, whose
turns are 1 + 2 + ... + k at least, so the longest path in memory has the square root of twice the number of turns. The list
that a node's digest covers is joined in pieces of ``PIECE`` ids and hashed as a stream.

Defined results. Null role or text: empty. Null turn: before the others. Turns of one number: in the order of a hash of
role and text; equal ones are interchangeable. Rows without a conv_id belong to no conversation and are left out.
Remainders have the sign of the id. Very long texts: hashed in the scan and not moved. Repeated rows: turns of
their own. Empty table, or no conv_id at all: no rows, not even a root. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, running, staged

#: Conversations that share a beginning: runs of ids, and the turns taken over, by checksum.
RUN, TAKEN = 5, 9
#: Ids of one piece of a node's list.
PIECE = 65_536


def within(
    df: DataFrame, key: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None, extra: DataFrame | None = None,
) -> DataFrame:
    """``df`` with sums and exclusive ors over the rows before of the same ``key``, totals by key, and ``extra``'s columns by key.

    ``order`` makes rows of a key distinct, so that ranges of (key, order) cut any key. ``totals`` are sums, or
    minima where the name ends in _min.
    """
    sums, xors, totals = sums or {}, xors or {}, totals or {}
    ranged = staged(df.repartitionByRange(*key, *order).select("*", F.spark_partition_id().alias("_range")), "ranges")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    total = lambda n, c: F.min(c) if n.endswith("_min") else F.sum(c)
    per = ranged.groupBy("_range", *key).agg(
        *(F.sum(c).alias(f"_{n}") for n, c in sums.items()), *(F.bit_xor(c).alias(f"_{n}") for n, c in xors.items()),
        *(total(n, c).alias(f"_{n}") for n, c in totals.items()),
    )
    all_, before = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(
        "_range", *key, *(zero(F.sum(f"_{n}").over(before)).alias(f"_{n}") for n in sums),
        *(zero(F.bit_xor(f"_{n}").over(before)).alias(f"_{n}") for n in xors), *(total(n, F.col(f"_{n}")).over(all_).alias(n) for n in totals),
    )
    if extra is not None:
        bases = bases.join(extra, list(key))
    inside = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *(zero(F.sum(c).over(inside)).alias(f"_in_{n}") for n, c in sums.items()), *(zero(F.bit_xor(c).over(inside)).alias(f"_in_{n}") for n, c in xors.items())
    )
    more = [c for c in (extra.columns if extra is not None else []) if c not in key]
    return local.join(bases, ["_range", *key]).select(
        *df.columns, *((F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in sums),
        *(F.col(f"_in_{n}").bitwiseXOR(F.col(f"_{n}")).alias(n) for n in xors), *totals, *more,
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, bytes): the turns of every rebuilt conversation from depth 1, and a row of depth 0 for each."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.xxhash64(F.lit(k), *said).alias(f"h{k}") for k in (1, 2)),
        F.octet_length(said[1]).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"),
    )
    sizes = staged(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), "sizes")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TAKEN)).alias("taken")
    first = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % RUN).alias("base"), taken)
    begun = first.join(sizes.select(F.col("conv_id").alias("base"), "n_turns"), "base", "left").select(
        "conv_id", "base", "taken", F.least("taken", F.coalesce("n_turns", F.lit(0).cast("long"))).alias("shift")
    )
    begun = staged(begun, "begun")
    placed = staged(within(turns, ["conv_id"], ["turn", "h1", "tie"], sums={"place": F.lit(1)}, extra=begun.select("conv_id", "taken", "shift")), "placed")
    shown = ["h1", "h2", "bytes"]
    own = placed.where("place >= taken").select("conv_id", (F.col("place") + 1 - F.col("taken") + F.col("shift")).alias("depth"), *shown)
    heads = placed.where((F.col("place") < TAKEN - 1) & (F.col("conv_id") % RUN == 0)).select(F.col("conv_id").alias("base"), "place", *shown)
    head = heads.join(begun, "base").where("place < taken").select("conv_id", (F.col("place") + 1).alias("depth"), *shown)
    none = F.lit(0).cast("long")
    return own.union(head).union(sizes.select("conv_id", none.alias("depth"), *(none.alias(c) for c in shown)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces arrive sorted by node and number; gives the digest of each node's whole list."""
    node = digest = None
    for b in batches:
        low, n, made = [], [], []
        for a, k, piece in zip(*(b.column(c).to_pylist() for c in ("low", "n", "piece")), strict=True):
            if (a, k) == node:
                digest.update(b"," + piece.encode())
                continue
            if node is not None:
                low.append(node[0]), n.append(node[1]), made.append(digest.hexdigest())
            node, digest = (a, k), hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(made, pa.string())], ["low", "n", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, digest.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["low", "n", "ends"])


def _digests(ends: DataFrame) -> DataFrame:
    """(low, n, ends): from (low, n, conv_id), the digest of each chain's ids in ascending order."""
    numbered = within(ends, ["low", "n"], ["conv_id"], sums={"nth": F.lit(1)}).select("low", "n", "conv_id", F.expr(f"nth div {PIECE}").alias("part"))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece")
    pieces = numbered.groupBy("low", "n", "part").agg(piece)
    return mapped(pieces.repartition("low", "n").sortWithinPartitions("low", "n", "part"), _hashed, "low long, n long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position, subtree_end.

    ``position`` is the node's place in preorder, from 0, ``subtree_end`` that of the last node below it.
    """
    zero = F.lit(0).cast("long")
    said = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "h1", "h2")).otherwise(zero) for k in (3, 4)]
    hashed = rebuilt(conversations).select("conv_id", "depth", "bytes", *(c.alias(f"g{k}") for k, c in enumerate(said)))
    along = within(hashed, ["conv_id"], ["depth"], xors={"x0": F.col("g0"), "x1": F.col("g1")})
    named = along.select("conv_id", "depth", "bytes", *(F.col(f"x{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (0, 1)))
    node = ["depth", "p0", "p1"]
    seen = staged(within(named, node, ["conv_id"], totals={"n": F.lit(1), "low_min": F.col("conv_id")}).withColumnRenamed("low_min", "low"), "seen")
    nodes = staged(seen.groupBy(*node).agg(*(F.min(c).alias(c) for c in ("n", "low", "bytes"))), "nodes")

    # A conversation's path: the first node of each of its chains, and the chain.
    tops = seen.groupBy("conv_id", "low", "n").agg(F.min(F.struct(*node)).alias("top"))
    steps = F.array_sort(F.collect_list(F.struct("top.depth", "top.p0", "top.p1", "low", "n"))).alias("path")
    paths = staged(tops.groupBy("conv_id").agg(steps), "paths")
    last = F.element_at("path", -1)
    ended = paths.select(last["low"].alias("low"), last["n"].alias("n"), "conv_id", "path")
    distinct = ended.groupBy("low", "n").agg(F.any_value("path").alias("path")).select("path")
    ranked = running(distinct, [F.col("path")], r=F.lit(1)).select("r", "path", F.posexplode("path").alias("at", "step"))
    up = F.get("path", F.col("at") - 1)
    spans = staged(
        ranked.select("r", "step.low", "step.n", "step.depth", up["low"].alias("up_low"), up["n"].alias("up_n")).groupBy("low", "n").agg(
            F.min("r").alias("first"), F.max("r").alias("last"), F.min("depth").alias("top"), F.min("up_low").alias("up_low"), F.min("up_n").alias("up_n")
        ),
        "spans",
    )
    below = spans.where("up_n is not null").groupBy(F.col("up_low").alias("low"), F.col("up_n").alias("n")).agg(F.count(F.lit(1)).alias("n_below"))
    saved = (F.col("n") - 1) * F.col("bytes")
    chains = nodes.groupBy("low", "n").agg(F.count(F.lit(1)).alias("size"), F.max("depth").alias("bottom"), F.sum(saved).alias("saved"))
    chains = chains.join(spans, ["low", "n"]).join(below, ["low", "n"], "left").withColumn("leaf", F.col("n_below").isNull().cast("long"))

    # Preorder, the sums before each chain, and those before the end of its interval.
    ordered = staged(running(chains, [F.col("first"), F.col("top")], nodes_before=F.col("size"), leaves_before=F.col("leaf"), saved_before=F.col("saved")), "preorder")
    to_end = ordered.groupBy(F.col("first").alias("last")).agg(
        F.max(F.col("nodes_before") + F.col("size")).alias("nodes_end"), F.max(F.col("leaves_before") + F.col("leaf")).alias("leaves_end"),
        F.max(F.col("saved_before") + F.col("saved")).alias("saved_end"),
    )
    done = ordered.join(to_end, "last").join(_digests(ended.select("low", "n", "conv_id")), ["low", "n"], "left").select(
        "low", "n", "top", "bottom", "up_low", "nodes_before", (F.col("nodes_end") - 1).alias("subtree_end"), F.coalesce("n_below", zero).alias("n_below"),
        (F.col("leaves_end") - F.col("leaves_before")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_before")).alias("subtree"), "ends",
    )
    at_top, at_bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    return within(nodes, ["low", "n"], ["depth"], sums={"above": saved}, extra=staged(done, "chains")).select(
        F.col("low").alias("conv_id"), "depth", F.when(at_top, F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_bottom, F.col("n_below")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", (F.col("subtree") - F.col("above")).alias("saved_tokens"),
        F.coalesce(F.when(at_bottom, F.col("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        (F.col("nodes_before") + F.col("depth") - F.col("top")).alias("position"), "subtree_end",
    )
