"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task keeps, for each fill level, the number of its partly filled windows at that level. A document's full windows
are cut off first; what remains goes to the level for which the sum of the squared counts becomes least, a new window
being level 0. When too many windows are open, and at a task's end, the emptiest open windows are cut up to fill the
others; the last one is cut into windows whose sizes are powers of two, which need no padding. So no row is shuffled,
and a task holds at most OPEN_WINDOWS windows of ids whatever the sizes are.

Null texts count as empty; an empty text is its end id alone. Equal and repeated rows are packed each on its own, and a
null doc_id stays null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared, tokens

#: Partly filled windows that a task holds at most.
OPEN_WINDOWS = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, in_part long, offset long"


class Windows:
    """The open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int):
        self.size, self.count, self.sequences = size, np.zeros(size + 1, dtype=np.int64), 0
        self.open: list[list[list]] = [[] for _ in range(size)]  # by level: windows, each a list of pieces
        self.held, self.rows = 0, []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), doc_tokens, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1

    def level_for(self, n: int) -> int:
        """The level at which n more ids change the sum of squared counts least (a full window counts nothing)."""
        count, upto = self.count, self.size - n
        change = 2 * (count[n : self.size + 1] - count[: upto + 1]) + 2
        change[upto] = 1 - 2 * count[upto]
        change[0] = 2 * count[n] + 1
        change[1:][count[1 : upto + 1] == 0] = np.iinfo(np.int64).max
        return int(change.argmin())

    def place(self, piece: tuple) -> None:
        n = len(piece[2])
        level = self.level_for(n)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.held -= 1
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            self.emit(window)
            return
        self.open[level + n].append(window)
        self.count[level + n] += 1
        self.held += 1
        if self.held > OPEN_WINDOWS:
            self.level_out()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, full = len(ids), len(ids) // self.size * self.size
        for start in range(0, full, self.size):
            self.emit([(doc_id, start, ids[start : start + self.size], n)])
        if full < n:
            self.place((doc_id, full, ids[full:].copy(), n))

    def level_out(self) -> None:
        """Cuts up the emptiest open windows to fill the fullest; one partly filled window stays at most."""
        windows = [(level, w) for level in range(1, self.size) for w in self.open[level]]
        self.open, self.held = [[] for _ in range(self.size)], 0
        self.count[:] = 0
        low, high = 0, len(windows) - 1
        if high < 0:
            return
        spare = list(windows[0][1])
        while high > low:
            level, target = windows[high]
            while level < self.size and (spare or low + 1 < high):
                if not spare:
                    low += 1
                    spare = list(windows[low][1])
                doc_id, start, ids, total = spare.pop()
                taken = min(len(ids), self.size - level)
                target.append((doc_id, start, ids[:taken], total))
                level += taken
                if taken < len(ids):
                    spare.append((doc_id, start + taken, ids[taken:], total))
            if level < self.size:
                spare = target
                break
            self.emit(target)
            high -= 1
            if not spare and low < high:
                low += 1
                spare = list(windows[low][1])
        if spare:
            level = sum(len(p[2]) for p in spare)
            self.open[level], self.held = [spare], 1
            self.count[level] = 1

    def finish(self) -> None:
        """Closes all; the last, partly filled window becomes windows of sizes that are powers of two."""
        self.level_out()
        rest = next((w[0] for w in self.open if w), [])
        left = sum(len(p[2]) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, need = [], size
            while need:
                doc_id, start, ids, total = rest.pop()
                window.append((doc_id, start, ids[:need], total))
                if need < len(ids):
                    rest.append((doc_id, start + need, ids[need:], total))
                need -= min(need, len(ids))
            self.emit(window)
            left -= size

    def drained(self, part: int) -> pa.RecordBatch:
        doc_id, start, length, crc, total, sequence, offset = zip(*self.rows, strict=True) if self.rows else [()] * 7
        self.rows = []
        columns = [doc_id, start, length, crc, total, np.full(len(start), part), sequence, offset]
        kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A piece is a stretch of one document's ids (its text's ids and the end id) within one sequence. Sequence ids run
    without gaps from 0.
    """
    spark = docs.sparkSession

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, windows, coder = TaskContext.get().partitionId(), Windows(window), tokens.encoder(vocabulary)
        for batch in batches:
            for rows, data, offsets in shared.slices(batch, most=tokens.BATCH_BYTES):
                ids, counts = coder.encode(data, offsets)
                doc_ids, ends = rows.column(0).to_pylist(), np.cumsum(counts)
                for doc_id, a, b in zip(doc_ids, (ends - counts).tolist(), ends.tolist(), strict=True):
                    windows.add(doc_id, np.append(ids[a:b], np.uint32(end_id)).astype("<u4"))
                yield windows.drained(part)
        windows.finish()
        yield windows.drained(part)

    scratch = shared.Scratch(spark, "packing")
    pieces = scratch.save(shared.mapped(shared.narrow_documents(docs), packed, PIECES, keeps=tokens.KEEPS), "pieces")
    totals = pieces.groupBy("part").agg((F.max("in_part") + 1).alias("sequences"))
    return pieces.join(F.broadcast(shared.before_parts(totals, "part", "sequences")), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("in_part") + F.col("sequences_before")).alias("sequence_id"), "offset"
    )
