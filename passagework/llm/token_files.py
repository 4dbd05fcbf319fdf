"""Token ids in Arrow files of fixed-size-list batches.

Documents are ordered by id over all shards. A shard is an Arrow IPC file (the stream
format with a footer) whose batches hold equal numbers of equally long sequences: a
fixed-size list of ids and one of mask bytes. A batch's place follows from a token's
number by division, so a memory map gives any sequence and its mask without copying or
decoding. Beside it lies a small Arrow file with each document's first token and length.

Writing: a bounded sample of the ids gives the shards' borders. One pass tokenizes the
texts where they lie and names each document's shard; only compressed ids are shuffled. A
shard's rows are then written in order under a name of its own; the rows that the
successful tasks return are the manifest, so a lost or repeated task leaves at most a
file that nobody reads.

Defined results. Null or empty text: just the end id. Null ids come first. Repeated rows
and ties: each row is a document; equal ids are ordered by a hash of the text, so borders can
fall between them, and equal rows are dealt to shards by their place. Very long texts:
held one at a time. Empty table: an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, new_folder, staged
from .tokens import default_path, encoder

SEQUENCE = 2048
#: Sequences in a batch.
ROWS = 128
#: Bytes of text that a shard is meant to hold, and rows sampled for the shards' borders: for each, and at most.
SHARD_BYTES, SAMPLED, SAMPLED_MOST = 64 << 20, 100, 1_000_000
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Hadoop's names of the S3 scheme are Arrow's s3."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def sequence_schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length))])


class ShardWriter:
    """Collects ids and writes whole batches; the last one is padded and masked."""

    def __init__(self, sink, kind: np.dtype, length: int = SEQUENCE, rows: int = ROWS) -> None:
        self.kind, self.length, self.block = kind, length, length * rows
        self.schema = sequence_schema(pa.from_numpy_dtype(kind), length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.buffer, self.held, self.n_tokens = np.zeros(self.block, kind), 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        while len(ids):
            n = min(len(ids), self.block - self.held)
            self.buffer[self.held : self.held + n] = ids[:n]
            self.held, ids = self.held + n, ids[n:]
            if self.held == self.block:
                self._flush()

    def _flush(self) -> None:
        n = -(-self.held // self.length) * self.length
        self.buffer[self.held : n] = 0
        lists = [pa.array(self.buffer[:n]), pa.array((np.arange(n) < self.held).view(np.uint8))]
        self.file.write_batch(
            pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in lists], schema=self.schema)
        )
        self.held = 0

    def close(self) -> None:
        if self.held:
            self._flush()
        self.file.close()


class ShardReader:
    """Random access by sequence or by token."""

    def __init__(self, source, length: int = SEQUENCE, rows: int = ROWS) -> None:
        self.file, self.length, self.rows, self.last = pa.ipc.open_file(source), length, rows, (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = k, self.file.get_batch(k)
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``k`` and its mask (1: a token, 0: padding); both are views of the file."""
        b, r = self.batch(k // self.rows), k % self.rows
        at = slice(r * self.length, (r + 1) * self.length)
        return b.column(0).values.to_numpy()[at], b.column(1).values.to_numpy()[at]

    def ids(self, start: int, n: int) -> np.ndarray:
        block, parts = self.rows * self.length, []
        while n:
            values = self.batch(start // block).column(0).values.to_numpy()
            part = values[start % block : start % block + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint16)


Key = tuple[bool, int, int, int]


def _key(doc: int | None, tie: int, salt: int) -> Key:
    """The order of documents: null ids first, then by id, text and, for equal rows, place."""
    return doc is not None, doc or 0, tie, salt


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.col(text).alias("text"),
    )


def borders(keyed: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[Key]:
    """The first keys of all shards but the first, from a sample of at most ``SAMPLED_MOST`` rows or so."""
    total, cores = keyed.count(), keyed.sparkSession.sparkContext.defaultParallelism
    narrow = keyed.select("doc_id", "tie", "salt", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))

    def some(n: int) -> list:
        return narrow.sample(min(1.0, n / total), 42).collect() if total else []

    rows = some(SAMPLED * 4 * cores)
    size = sum(r["size"] for r in rows) * total // max(1, len(rows))
    shards = max(-(-size // shard_bytes), min(3 * cores, -(-size // (1 << 20))))
    if shards * SAMPLED > 2 * len(rows) and len(rows) < total:
        rows = some(min(shards * SAMPLED, SAMPLED_MOST))
    keys = sorted(_key(r["doc_id"], r["tie"], r["salt"]) for r in rows)
    return sorted({keys[len(keys) * k // shards] for k in range(1, shards)}) if keys else []


def _tokenize(path: str, first: list[Key]):
    """(shard, doc_id, tie, ids): the ids as compressed little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u2") if enc.size <= 1 << 16 else np.dtype("<u4")
        codec = pa.Codec("zstd", 5)
        for b in batches:
            docs, ties, salts = (b.column(i).to_pylist() for i in range(3))
            shards = [bisect_right(first, _key(*key)) for key in zip(docs, ties, salts, strict=True)]
            counts, packed = [], []
            for ids in enc.documents(t.as_py() for t in b.column(3)):
                counts.append(len(ids))
                packed.append(codec.compress(ids.astype(kind), asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                ["shard", "doc_id", "tie", "n_tokens", "ids"],
            )

    return run


def _write(folder: str, wide: bool, length: int, rows: int):
    """Rows arrive sorted by shard; each shard's rows make a file of their own."""
    kind = np.dtype("<u4") if wide else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, open_, here, name = pa.Codec("zstd"), (), None, ""

        def done() -> pa.RecordBatch:
            for x in open_:
                x.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), pa.array([name]), pa.array([open_[0].n_tokens], pa.int64())], ["shard", "name", "n_tokens"]
            )

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != here:
                    if open_:
                        yield done()
                    here, name = int(shards[a]), f"{folder}/shard-{shards[a]:06d}-{uuid.uuid4().hex}"
                    fs, at = _open(f"{name}.arrow")
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    sink, docs = fs.open_output_stream(at), fs.open_output_stream(at.removesuffix(".arrow") + ".docs.arrow")
                    open_ = ShardWriter(sink, kind, length, rows), sink, pa.ipc.new_file(docs, INDEX), docs
                starts = []
                for n, ids in zip(batch.column(3)[a:b].to_pylist(), batch.column(4)[a:b], strict=True):
                    starts.append(open_[0].n_tokens)
                    open_[0].add(np.frombuffer(codec.decompress(ids.as_buffer(), n * kind.itemsize), kind))
                open_[2].write_batch(
                    pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(starts, pa.int64()), batch.column(3)[a:b]], schema=INDEX)
                )
        if open_:
            yield done()

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = SEQUENCE, rows: int = ROWS,
    doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Writes the shards; returns the manifest (shard, name, n_tokens, base), base being the tokens before it."""
    path, keyed = tokenizer or default_path(), _keyed(docs, doc_id, text)
    first = borders(keyed, shard_bytes)
    made = mapped(keyed, _tokenize(path, first), "shard int, doc_id long, tie long, n_tokens long, ids binary")
    ordered = made.repartitionById(len(first) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie")
    wide = encoder(path).size > 1 << 16
    done = staged(mapped(ordered, _write(folder, wide, length, rows), "shard int, name string, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(length: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(f"{name}.arrow")
                local = isinstance(fs, pyarrow.fs.LocalFileSystem)
                reader = ShardReader(pa.memory_map(at) if local else fs.open_input_file(at), length, rows)
                index = pa.ipc.open_file(fs.open_input_file(at.removesuffix(".arrow") + ".docs.arrow"))
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    starts, counts = b.column(1).to_pylist(), b.column(2).to_pylist()
                    sums = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array([base + s for s in starts], pa.int64()), b.column(2), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_documents(manifest: DataFrame, length: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """From the files: doc_id, start over all shards, n_tokens, ids_crc32."""
    files = staged(manifest.select("name", "base", "shard"), "files")
    n = max(1, files.count())
    return mapped(
        files.repartition(n, "shard").select("name", "base"), _read(length, rows), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to a new shared folder and reads them back."""
    return read_documents(write_token_files(docs, new_folder(spark, "tokens"), tokenizer))
