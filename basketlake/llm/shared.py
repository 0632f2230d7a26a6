"""Helpers that the operators of this subpackage share.

* scratch tables: intermediate results written as Parquet to the cluster's shared checkpoint folder, so that a lost
  executor never costs more than the tasks it was running and lineage stays short;
* Arrow batches as numpy byte arrays, and 64-bit hashes of words and word n-grams over them.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the word hash and of its finaliser, and the multiplier that chains words to n-grams.
BYTE_STEP = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
CHAIN = 0xD6E8FEB86659FD93

#: Text bytes that the numpy kernels handle at a time; their temporary arrays are a few times eight as large.
CHUNK_BYTES = 1 << 19
#: Bytes and rows of an Arrow batch at most (a longer row is a batch of its own). Spark's own 64 MB would be held several
#: times over by the JVM and each Python worker.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


#: Rows of numbers that one task writes at least.
FILE_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; a local session that has none
    gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run in the shared folder. `save` writes and rereads, `drop` deletes what is used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
        """`rows`: about how many there are at most; a table of few rows is written by few tasks, whatever the width of
        the shuffle before."""
        path = f"{self.root}/{name}"
        (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        """Saves a result and deletes all else of this run."""
        kept = self.save(df, "result")
        self.only("result")
        return kept

    def only(self, *names: str) -> None:
        """Deletes the other tables of this run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if status.getPath().getName() not in names:
                self._delete(status.getPath().toString())

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a worker process keeps from task to task, by name: a tokenizer with the parts that it has met.
held: dict[str, object] = {}


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow with batches of bounded size. Spark looks the bounds up when the plan runs, so the session keeps them.
    Workers let go what they held for tasks of other kinds than `keeps`."""
    for name, most in BATCHES.items():
        df.sparkSession.conf.set(name, str(most))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in held if not n.startswith(keeps or " ")]:
            del held[name]
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns what the task's arrays have freed to the system; a worker lives on after its task, often idle."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever further columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Name of the column that tells rows of one doc_id apart while they are looked up.
TEXT_HASH = "__text_hash"


def hashed_documents(docs: DataFrame) -> DataFrame:
    """narrow_documents with the hash of the text, which with doc_id tells which rows a finding is about."""
    return narrow_documents(docs).withColumn(TEXT_HASH, F.xxhash64("text"))


def without(docs: DataFrame, found: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of a table whose doc_id (nulls too) and text are not among those found, a stored table of doc_id and
    TEXT_HASH; with `left_semi`, the others."""
    keyed = docs.withColumn(TEXT_HASH, F.xxhash64(F.col("text").cast("string")))
    found = bounded(found.select(F.col("doc_id").alias("__doc_id"), F.col(TEXT_HASH).alias("__hash")).distinct(), found)
    return keyed.join(found, keyed["doc_id"].cast("long").eqNullSafe(found["__doc_id"]) & (keyed[TEXT_HASH] == found["__hash"]), how).drop(TEXT_HASH)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes of a text column (null: empty) and its row offsets, some `most` bytes each.

    A part always has whole rows, so one longer text makes one longer part.
    """
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_STEP to the powers 0..n-1 modulo 2**64, and their inverses."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES)
        inverse = pow(BYTE_STEP, -1, 1 << 64)
        for name, base in (("up", BYTE_STEP), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte i times BYTE_STEP**i; `span_hash` takes the hash of any stretch of bytes from them."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\t to \\r, and the first word of each row (n + 1)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    before[rows] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a part, A-Z lower-cased, and the first word of each row (n + 1)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, first = word_spans(data, offsets)
    return span_hash(byte_sums(lowered(data)), starts, ends), first


LETTERS = np.zeros(256, dtype=bool)
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):  # digits, letters, bytes of other characters
    LETTERS[_first : _last + 1] = True


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of the runs of letters, digits and non-ASCII bytes; first run of each row."""
    data = lowered(data)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    return data, *word_spans(np.where(LETTERS[data], data, np.uint8(32)), offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions of a row run over its end."""
    count = max(0, len(hashes) - n + 1)
    chained = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        chained = (chained ^ hashes[i : i + count]) * np.uint64(CHAIN)
        chained ^= chained >> np.uint64(29)
    return mixed(chained)


def before_parts(totals: DataFrame, part: str, *values: str) -> DataFrame:
    """Per part, the sums of the values over all lower parts, as `<value>_before`.

    `totals` has one row for each task of an earlier stage, some tens of bytes each, so one task can sort them and the
    result can be broadcast: a million tasks make some 30 MB.
    """
    from pyspark.sql import Window

    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).cast("long").alias(f"{v}_before") for v in values))


#: Bytes of a table that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
WIDTHS = {"bigint": 8, "double": 8, "int": 4, "float": 4, "boolean": 1}


def bounded(table: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A table of numbers, marked for broadcast where the bytes of its counted rows allow that. It is read from storage,
    or made of a stored table that has as many rows at least."""
    width = sum(WIDTHS[kind] for _, kind in table.dtypes)
    return F.broadcast(table) if (stored or table).count() * width <= BROADCAST_BYTES else table


def components(edges: DataFrame, scratch: Scratch, name: str, most: int | None = None) -> DataFrame:
    """Connected components: `node`, `root` (the smallest node of its component), for all nodes of edges (u, v).

    Alternates the large-star and small-star steps of Kiveris et al. (2014): neighbours move to the smallest node near
    them until only stars are left. Each round is two aggregations and joins and is stored, in files by the number of
    edges; `most` is how many there are at first at most. Only that number and whether a node is in the way reach the
    driver. Hubs are aggregated before they are joined, no list of neighbours is ever built, and edges
    are dealt out by a node only where the least neighbours are too many to broadcast (AQE then splits a hub's edges).
    """

    def is_stars(e: DataFrame) -> bool:
        """Whether each u has one v and no v is itself a u."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
        return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out + root > 1").isEmpty()

    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, at = scratch.save(edges.distinct(), f"{name}-0", most), 0
    while not is_stars(now):
        at += 1
        n = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large-{at}", n)
        large = both.where("v > u").join(bounded(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large, f"{name}-edges-{at}", n)
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-{at}", n)
        small = large.join(bounded(least), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = scratch.save(small.where("u <> v").distinct(), f"{name}-{at}", n)
        scratch.drop(f"{name}-{at - 1}", f"{name}-large-{at}", f"{name}-edges-{at}", f"{name}-small-{at}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
