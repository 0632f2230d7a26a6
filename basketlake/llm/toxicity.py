"""Toxicity by bags of subwords: embeddings of words and their character n-grams, averaged, under a linear softmax.

Vectors and softmax are trained together in numpy. An unseen misspelling shares character n-grams, and so vectors, with
words that were learnt. Averages are over the bags of all subwords of windows of WINDOW words, one at every STRIDE words
of the whole text, so each two words that stand near each other are in one bag and an insult is not diluted by a long
text around it; a text's score is that of its windows together (a smooth maximum in training, the maximum in scoring).
With two classes the softmax depends on each vector only through its product with the difference of the two output
vectors, so scoring needs one number for each n-gram; a part's distinct words are summed once each. Training reads a
sample bounded by PER_CLASS rows and labelled.SAMPLE_BYTES; scoring is one pass over whole texts, no shuffle.

A null or empty text has no words and gets the bias's score. Equal texts get equal scores: all sums are taken within a
word, a stretch of STRIDE words, and a window. An empty table gives no rows. With labels of one kind only, the score is
that of their share. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from basketlake.llm import labelled, shared

#: Labelled rows of either label that are learnt from at most.
PER_CLASS = 1200
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 4, 2
EPOCHS = 80
RATE = 0.5


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the byte n-grams of the word between two marks, word by word, and counts by word."""
    length = ends - starts + 2
    base = np.cumsum(length) - length
    held = np.full(int(length.sum()), 1, dtype=np.uint8)
    take = np.repeat(starts - base - 1, length) + np.arange(len(held))
    inner = np.ones(len(held), dtype=bool)
    inner[base], inner[base + length - 1] = False, False
    held[inner] = data[take[inner]]
    sums = shared.byte_sums(held)
    word, bucket = [np.arange(len(starts))], [hashes]
    for n in GRAMS:
        count = np.maximum(0, length - n + 1)
        owner = np.repeat(np.arange(len(starts)), count)
        at = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(len(owner))
        word.append(owner)
        bucket.append(shared.span_hash(sums, at, at + n))
    owner = np.concatenate(word)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(bucket)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=len(starts))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the distinct words, and which of them each word is."""
    hashes = shared.span_hash(shared.byte_sums(data), starts, ends)
    found, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    return starts[at], ends[at], found, which


def stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the stretches of STRIDE words that each row is cut into, and the first stretch of each row."""
    count = -(-np.diff(first) // STRIDE)
    upto = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(first[:-1], count) + (np.arange(upto[-1]) - np.repeat(upto[:-1], count)) * STRIDE, upto


def windows(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last stretch (one past it) of each row's windows, row by row, and the first window of each row. A row of
    less than WINDOW words is one window."""
    n, wide = np.diff(upto), WINDOW // STRIDE
    count = np.where(n > 0, np.maximum(1, n - wide + 1), 0)
    rows = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(upto[:-1], count) + np.arange(rows[-1]) - np.repeat(rows[:-1], count)
    return a, np.minimum(a + wide, np.repeat(upto[1:], count)), rows


def bag_sums(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over windows of the words' values, by stretches."""
    per = np.append(np.add.reduceat(values, starts), 0.0)
    out = per[a]
    for i in range(1, WINDOW // STRIDE):
        out = out + np.where(a + i < b, per[np.minimum(a + i, len(per) - 1)], 0.0)
    return out


class Model:
    """For each bucket the product of its vector with the output difference, and the bias."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, starts, ends, first = shared.letter_words(data, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        if len(starts):
            s, e, hashes, which = distinct(data, starts, ends)
            buckets, count = grams(data, s, e, hashes)
            value = labelled.row_sums(self.values[buckets], np.concatenate([[0], np.cumsum(count)]))
            starts, upto = stretches(first)
            a, b, rows = windows(upto)
            mean = bag_sums(value[which], starts, a, b) / bag_sums(count[which].astype(np.float64), starts, a, b)
            some = np.flatnonzero(np.diff(rows) > 0)
            out[some] += np.maximum.reduceat(mean, rows[:-1][some])
        return labelled.sigmoid(out)


def vocabulary_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sample's texts: which distinct word each word is, the first word of each text, and the distinct words' grams
    with counts. Texts are taken some at a time; only distinct words' grams are kept."""
    known: dict[int, int] = {}
    which, per_text, buckets, counts = [], [], [], []
    for data, offsets in labelled.parts(texts):
        data, starts, ends, first = shared.letter_words(data, offsets)
        s, e, hashes, local = distinct(data, starts, ends)
        fresh = np.array([i for i, h in enumerate(hashes.tolist()) if h not in known], dtype=np.int64)
        if len(fresh):
            found, count = grams(data, s[fresh], e[fresh], hashes[fresh])
            buckets.append(found)
            counts.append(count.astype(np.int32))
            known.update(zip(hashes[fresh].tolist(), range(len(known), len(known) + len(fresh)), strict=True))
        which.append(np.array([known[h] for h in hashes.tolist()], dtype=np.int32)[local])
        per_text.append(np.diff(first))
    return np.concatenate(which), np.concatenate([[0], np.cumsum(np.concatenate(per_text))]), np.concatenate(buckets), np.concatenate(counts)


def train(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Full passes over the sample with per-coordinate steps; rows weigh as much as their label does among all labels."""
    ones = int(labels.sum())
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS), prior)
    which, first, buckets, count = vocabulary_of(texts)
    ends = np.concatenate([[0], np.cumsum(count)])
    starts, upto = stretches(first)
    a, b, rows = windows(upto)
    size = bag_sums(count[which].astype(np.float64), starts, a, b)
    per_stretch = np.diff(np.append(starts, len(which)))
    some = np.flatnonzero(np.diff(rows) > 0)
    row_first, label = rows[:-1][some], labels[some]
    per_row = np.diff(rows)[some]
    weight = np.where(label == 1, share / ones, (1 - share) / (len(labels) - ones)) * len(labels)
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    output = rng.normal(0, 1, DIM).astype(np.float32)
    used = np.unique(buckets)
    local = np.searchsorted(used, buckets).astype(np.int32)
    vectors = vectors[used]
    bias, seen_v, seen_o, seen_b = prior, np.full((len(used), 1), 1e-8, np.float32), np.full(DIM, 1e-8), 1e-8
    for _ in range(EPOCHS):
        value = labelled.row_sums((vectors @ output)[local], ends)
        mean = bag_sums(value[which], starts, a, b) / size
        top = np.maximum.reduceat(mean, row_first)
        rise = np.exp(np.minimum(0, mean - np.repeat(top, per_row)))
        part = rise / np.repeat(np.add.reduceat(rise, row_first), per_row)  # each window's part in its row's score
        gap = (labelled.sigmoid(np.add.reduceat(part * mean, row_first) + bias) - label) * weight / len(labels)
        on_window = np.repeat(gap, per_row) * part / size
        edge = np.bincount(a, on_window, len(starts) + 1) - np.bincount(b, on_window, len(starts) + 1)
        on_word = np.bincount(which, np.repeat(np.cumsum(edge)[:-1], per_stretch), len(count))
        on_bucket = np.bincount(local, np.repeat(on_word.astype(np.float32), count), len(used)).astype(np.float32)
        on_output = on_bucket @ vectors
        seen_v += on_bucket[:, None] ** 2 * np.float32(output @ output)
        vectors -= RATE * on_bucket[:, None] * output / np.sqrt(seen_v)
        seen_o += on_output**2
        output -= (RATE * on_output / np.sqrt(seen_o)).astype(np.float32)
        seen_b += gap.sum() ** 2
        bias -= RATE * gap.sum() / np.sqrt(seen_b)
    values = np.zeros(BUCKETS)
    values[used] = vectors @ output
    return Model(values, bias)


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, per_class: int) -> DataFrame:
    model = train(*labelled.sample(docs, labels, "toxic", per_class))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    return labelled.scored(docs, lambda data, offsets: held.value.score(data, offsets), threshold)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of the documents."""
    return _scored(docs, labels, threshold, per_class).drop(shared.TEXT_HASH)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows whose text has a lower score. Rows that repeat a doc_id, or have none, are each judged by their own text."""
    rejected = _scored(docs, labels, threshold, per_class).where("predicted = 1").select("doc_id", shared.TEXT_HASH)
    return shared.without(docs, shared.Scratch(docs.sparkSession, "toxic").save(rejected, "rejected"))
