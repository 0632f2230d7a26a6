"""Fill-in-the-middle texts, cut by a learned index of ranks.

A text is cut at two code points that a hash of its doc_id gives, and its parts are written in the order prefix, suffix,
middle (`psm`) or suffix, prefix, middle (`spm`), each behind a marker. Some texts stay `plain`.

Texts are UTF-8, so the byte at which code point k begins has to be found. For each part of a batch an index is fitted
to the offsets of all its code points: straight segments, none of which is off by more than ERROR bytes anywhere, and the
residual of each code point as one byte. A cut is predicted from its segment and corrected by its residual, which gives
the exact offset. Segments are found by halving: a stretch goes on in two halves while the line through its ends misses a
code point by more than ERROR, so plain ASCII is one segment, whatever its length. Nothing leaves its row: there is no
shuffle and a lost task costs its own rows.

A null text is empty. An empty text, one with a marker in it, and a share of all texts are plain; their prefix_chars and
middle_chars are null. A null doc_id is hashed as no digits. Repeated rows have equal results. An empty table gives no
rows. Further columns are ignored. `restored` gives the exact text back from output and form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared

#: The markers, and the salt of the hash.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
#: Bytes by which a segment may miss an offset.
ERROR = 127


class RankIndex:
    """Byte offsets of code points by rank: error-bounded straight segments and a residual for each rank."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        """offsets: ascending, of the code points and of the end."""
        segments, open_ = [], [(0, len(offsets))]
        while open_:
            a, b = open_.pop()
            slope = (int(offsets[b - 1]) - int(offsets[a])) / max(1, b - 1 - a)
            line = int(offsets[a]) + np.floor(slope * np.arange(b - a)).astype(np.int64)
            if np.abs(offsets[a:b] - line).max() <= error:
                segments.append((a, int(offsets[a]), slope))
            else:
                middle = (a + b) // 2
                open_ += [(middle, b), (a, middle)]
        self.starts = np.array([s[0] for s in segments], dtype=np.int64)
        self.bases = np.array([s[1] for s in segments], dtype=np.int64)
        self.slopes = np.array([s[2] for s in segments])
        self.residuals = np.concatenate([offsets[a:b] - self.predicted(np.arange(a, b)) for a, b in zip(self.starts, [*self.starts[1:], len(offsets)], strict=True)]).astype(np.int8)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[at] + np.floor(self.slopes[at] * (ranks - self.starts[at])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return self.predicted(ranks) + self.residuals[ranks]


def cut_bytes(data: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each row, and the bytes at which its two cuts are: `low` and `high` are remainders to be, modulo the
    row's code points and one, in either order."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(begins, bounds)
    n = np.diff(first)
    one, two = low % (n + 1), high % (n + 1)
    index = RankIndex(np.append(begins, len(data)))
    cut = lambda k: index.offsets(first[:-1] + k)
    return n, cut(np.minimum(one, two)), cut(np.maximum(one, two))


def fill_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    digest = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = shared.narrow_documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (group(2) % 100 >= 90)
    form = F.when(plain, "plain").when(group(3) % 100 < 20, "spm").otherwise("psm").alias("form")

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for part, data, bounds in shared.slices(batch):
                ids, _, h1, h2, forms = part.columns
                n, low, high = cut_bytes(data, bounds, h1.to_numpy(), h2.to_numpy())
                whole, out, chars = data.tobytes(), [], []
                for form, a, i, j, b, k in zip(forms.to_pylist(), bounds.tolist(), low.tolist(), high.tolist(), bounds[1:].tolist(), range(len(n)), strict=False):
                    if form == "plain":
                        out.append(whole[a:b])
                        chars.append((None, None))
                        continue
                    prefix, middle, suffix = whole[a:i], whole[i:j], whole[j:b]
                    out.append(b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
                    one, two = sorted((int(h1[k].as_py()) % (int(n[k]) + 1), int(h2[k].as_py()) % (int(n[k]) + 1)))
                    chars.append((one, two - one))
                columns = [ids, pa.array(n, pa.int64()), forms, *(pa.array([c[x] for c in chars], pa.int64()) for x in (0, 1)), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    hashed = rows.select("doc_id", "text", group(0), group(1), form)
    return shared.mapped(hashed, arranged, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was cut: parts of texts have no markers in them, so the markers are where the output was put together."""
    upto = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    prefix = F.when(form == "psm", upto(after(output, PREFIX), SUFFIX)).otherwise(upto(after(output, PREFIX), MIDDLE))
    suffix = F.when(form == "psm", upto(after(output, SUFFIX), MIDDLE)).otherwise(upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(output, MIDDLE), suffix))
