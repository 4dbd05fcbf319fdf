"""Best-fit packing of documents into sequences, by hierarchical residual packing.

1. Each partition tokenizes its documents, cuts those longer than a sequence, and
   packs its pieces by best fit, longest first. Nearly full bins are final.
2. Underfull bins become items of their own (number, fill). They are dealt to groups
   of bounded size, packed by best fit again, and so on up a tree until one group
   has seen all that can still be combined.

Any merge needs a bin that is filled to half or less, and best fit leaves at most one
of these in a group. If s of them are left, further rounds can use at most s bins of
each fill, so a group passes on no more than that and closes the others: no possible
merge is lost, and the last group is bounded by the tree, not by the data.

Pieces and bins are written to the shared folder after each round.

Defined results. A null or empty text is a document with just the end id. Very long texts
are cut; their ids are held one text at a time. Repeated
rows are packed once each. A null doc_id keeps its row. Ties are broken by order of
arrival, so sequence numbers may differ between layouts of the input; the packing
stays valid. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged
from .tokens import default_path, encoder

#: Characters encoded together: fewer than elsewhere, since packing shares its executor with what a pipeline has left in memory.
AT_ONCE = 6_000_000
LENGTH = 1024
#: Pieces that a task packs at once, and bins in a group: bounds on memory.
GROUP = 100_000
FAN_IN = 8

ITEMS = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("fill", pa.int32())]
)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: each item's bin and place in it, and the fill of each bin.

    The free spaces that some bin has are the bits of one integer, so the tightest
    bin is found by a shift.
    """
    which, place, fill = [0] * len(sizes), [0] * len(sizes), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        above = some >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        which[i], place[i] = b, capacity - room
        fill[b] += size
        room -= size
        if not free[room]:
            some |= 1 << room
        free[room].append(b)
    return which, place, fill


def cut(n_ids: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = n_ids if n_ids <= length else n_ids % length
    return [(0, first)] * (first > 0) + [(s, length) for s in range(first, n_ids, length)]


def _tokenize_and_pack(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, base = encoder(path).documents, [], TaskContext.get().partitionId() << 36

        def pack() -> pa.RecordBatch:
            nonlocal rows, base
            which, place, fill = best_fit([r[3] for r in rows], length)
            cols = [*zip(*rows, strict=True), [base + b for b in which], place, [fill[b] for b in which]]
            base, rows = base + len(fill), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ITEMS, strict=True)], schema=ITEMS)

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, AT_ONCE), strict=True):
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n])))
            if len(rows) >= GROUP:
                yield pack()
        if rows:
            yield pack()

    return run


def _merge(length: int, keep: int, final: bool):
    """Packs whole bins of one task as items; each task holds one group of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("bin", pa.int64()), ("fill", pa.int32())]))
        bins, sizes = table["bin"].to_pylist(), table["fill"].to_pylist()
        order = sorted(range(len(bins)), key=lambda i: (-sizes[i], bins[i]))
        bins, sizes = [bins[i] for i in order], [sizes[i] for i in order]
        which, place, fill = best_fit(sizes, length)
        names = [0] * len(fill)  # a merged bin takes the number of its first part
        for i in reversed(range(len(bins))):
            names[which[i]] = bins[i]
        passed, going = [0] * (length + 1), [False] * len(fill)
        if not final:
            for b, f in enumerate(fill):
                going[b] = f < length and passed[f] < keep
                passed[f] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(bins, pa.int64()), pa.array([names[b] for b in which], pa.int64()), pa.array(place, pa.int64()),
             pa.array([fill[b] for b in which], pa.int32()), pa.array([going[b] for b in which], pa.bool_())],
            ["bin", "into", "shift", "fill", "going"],
        )

    return run


def _moves(items: DataFrame, length: int) -> DataFrame | None:
    """(bin, into, shift) for the bins that end up inside another; None if none do."""
    total, open_ = None, items.where((F.col("at") == 0) & (F.col("fill") < length)).select("bin", "fill")
    groups = None
    while True:
        # Only a bin that the emptiest one could join or be joined by can still change.
        count, small, least = open_.agg(
            F.count(F.lit(1)), F.count(F.when(2 * F.col("fill") <= length, 1)), F.min("fill")
        ).first()
        if count < 2 or not small:
            break
        open_ = open_.where(F.col("fill") <= length - least)
        groups = -(-count // GROUP) if groups is None else -(-groups // FAN_IN)
        final = groups == 1
        dealt = open_.repartition(1) if final else open_.repartition(groups, F.xxhash64("bin"))
        done = staged(
            mapped(dealt, _merge(length, small, final), "bin long, into long, shift long, fill int, going boolean"),
            "bins",
        )
        step = done.where("bin <> into").select("bin", "into", "shift")
        if total is None:
            total = step
        else:  # what sat in a bin that has moved moves along
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("by"))
            total = total.join(later, "into", "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
            ).union(step)
            total = staged(total, "moves")
        if final:
            break
        open_ = done.where("going and bin = into").select("bin", "fill")
    return total


def pack_documents(
    docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = staged(
        mapped(
            docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)),
            _tokenize_and_pack(tokenizer or default_path(), length),
            "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill int",
        ),
        "pieces",
    )
    moves = _moves(items, length)
    if moves is None:
        return items.select("doc_id", "piece", "start", "length", "ids_crc32",
                            F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return items.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
