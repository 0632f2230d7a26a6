"""What the two text classifiers share: held-out rows, the bounded training sample, and scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared

#: Text bytes of the two labels' samples together at most.
SAMPLE_BYTES = 32 << 20


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learnt from; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most `per_class` rows and `most_bytes` / 2 bytes of either label, the first by a hash of
    doc_id that fit, and the share of label 1 among all labels that may be learnt from. A doc_id that repeats counts once,
    with its least text. Only these rows' texts come to the driver."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    picked = [usable.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    texts = shared.narrow_documents(docs).join(ids, "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = shared.Scratch(docs.sparkSession, f"sample-{label}").save(texts.withColumn("bytes", F.octet_length("text")), "texts")
    # a row for each picked id: which of them fit
    room, wanted = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for row in texts.select("doc_id", "label", "bytes").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["bytes"] <= room[row["label"]]:
            room[row["label"]] -= row["bytes"]
            wanted.append((row["doc_id"],))
    fitting = docs.sparkSession.createDataFrame(wanted, "doc_id long")
    rows = texts.join(F.broadcast(fitting), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.float64), counts.get(1, 0) / max(1, sum(counts.values()))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted, hash of the text, in one pass over the texts; `score` gets text bytes and row offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in shared.slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(score(data, offsets), pa.float64())], names=["doc_id", shared.TEXT_HASH, "score"])

    found = shared.mapped(shared.hashed_documents(docs), run, f"doc_id long, {shared.TEXT_HASH} long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), shared.TEXT_HASH)


def as_part(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts, as `shared.slices` gives them."""
    encoded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(encoded), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of some texts at a time."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= shared.CHUNK_BYTES:
            yield as_part(held)
            held, size = [], 0
    if held:
        yield as_part(held)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; row i has those from first[i] to first[i + 1]. Each is added up by itself, so equal
    rows get equal sums wherever they stand."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(np.asarray(values[: first[-1]], dtype=np.float64), first[some])
    return out
