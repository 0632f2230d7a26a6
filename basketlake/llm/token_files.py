"""Token ids of a corpus in files, coded by frequency rank.

Ids get ranks by their counts over the whole corpus (ties: the lower id first), so most ranks fit one byte. A block of
some documents is two byte strings: data, each rank little-endian in 1 to 4 bytes, and control, two bits for each rank
with its number of bytes less one. Readers look a control byte's four lengths up in a table and gather all values of a
block at once with numpy. Blocks are rows of Parquet files in the order of doc_id; their rank table is stored beside.

Steps: tokenise once and store (2 bytes an id, compressed); count ids; deal the stored rows out by doc_id ranges; code
each task's documents in blocks. That range shuffle is the only shuffle of ids.

Null texts count as empty; an empty text is its end id alone. Repeated rows and doc_ids are each written; a null doc_id
comes first. An empty table gives files without rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.llm import shared, tokens

#: Ids of a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
BLOCKS = "part int, block int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, control binary, data binary"
#: For each control byte: the byte lengths of its four values.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of some ranks. The last control byte is filled up with zeros."""
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    held = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = held[np.arange(4) <= extra[:, None]]
    crumbs = np.concatenate([extra, np.zeros(-len(extra) % 4, np.uint8)]).reshape(-1, 4)
    control = crumbs[:, 0] | crumbs[:, 1] << 2 | crumbs[:, 2] << 4 | crumbs[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    held = np.append(np.frombuffer(data, dtype=np.uint8), np.zeros(4, np.uint8))
    if n and int(lengths.max()) <= 2:
        start = np.cumsum(lengths, dtype=np.int64) - lengths
        return held[start] | np.where(lengths == 2, held[start + 1], 0).astype(np.uint32) << np.uint32(8)
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    out = np.zeros(n, dtype=np.uint32)
    for i in range(4):
        longer = np.flatnonzero(lengths > i)
        out[longer] |= held[start[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, n (ids with the end id), ids (2 or 4 bytes each), tie (tells equal rows apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        kind = width(len(coder.bytes_of))
        for batch in batches:
            for rows, data, offsets in shared.slices(batch, most=tokens.BATCH_BYTES):
                ids, counts = coder.encode(data, offsets)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(kind)
                bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * ids.itemsize
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts + 1), blob.cast(pa.binary()), rows.column(2)], names=["doc_id", "n", "ids", "tie"])

    return shared.mapped(shared.narrow_documents(docs).withColumn("tie", F.monotonically_increasing_id()), run, "doc_id long, n long, ids binary, tie long", keeps=tokens.KEEPS)


def counted(stored: DataFrame, size: int) -> DataFrame:
    """id, count: over all ids; each task sends a row for each id that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, data, _ in shared.slices(batch, text="ids"):
                seen += np.bincount(data.view(width(size)), minlength=size)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["id", "count"])

    return shared.mapped(stored.select("ids"), run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Writes `<path>/blocks` and `<path>/ranks`."""
    spark = docs.sparkSession
    size = len(tokens.encoder(vocabulary).bytes_of)
    scratch = shared.Scratch(spark, "tokens")
    stored = scratch.save(tokenised(docs, vocabulary, end_id), "ids", compression="zstd")
    counts = counted(stored, size).orderBy(F.desc("count"), "id").collect()  # a row for each id of the vocabulary at most
    spark.createDataFrame([(rank, row["id"], row["count"]) for rank, row in enumerate(counts)], "rank long, id long, count long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(size, dtype=np.uint32)
    rank[[row["id"] for row in counts]] = np.arange(len(counts), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows, data, offsets in shared.slices(batch, text="ids", most=BLOCK_IDS * np.dtype(width(size)).itemsize):
                control, held = coded(ranks.value[data.view(width(size))])
                n = int(offsets[-1]) // np.dtype(width(size)).itemsize
                row = [part, block, first, n, rows.column(0).to_pylist(), rows.column(1).to_pylist(), control, held]
                block, first = block + 1, first + n
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    dealt = stored.repartitionByRange(shared.shuffle_width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shared.mapped(dealt, join, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop("ids")
    ranks.destroy()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files in order: doc_id, start (ids of all documents before), ids array<long>."""
    return _documents(spark, path, "ids array<long>", lambda ids, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64())))


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_files, with n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers instead."""

    def crcs(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        ids = ids.astype("<u4")
        return pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.int64())

    return _documents(spark, path, "ids_crc32 long", crcs)


def _documents(spark: SparkSession, path: str, column: str, made) -> DataFrame:
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # a row for each id of the vocabulary at most
    ids_of = spark.sparkContext.broadcast(np.array([row["id"] for row in table], dtype=np.uint32))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["doc_lengths"], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                ids = ids_of.value[decoded(row["control"], row["data"], row["n_ids"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + row["first_id"] + row["ids_before"]), pa.array(lengths), made(ids, bounds)], names=["doc_id", "start", "n_tokens", name]
                )

    placed = blocks.join(F.broadcast(shared.before_parts(totals, "part", "ids")), "part").select("first_id", "ids_before", "n_ids", "doc_ids", "doc_lengths", "control", "data")
    return shared.mapped(placed, run, f"doc_id long, start long, n_tokens long, {column}")
