"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other visible characters. Features are single tokens
and pairs, plus n-grams written with references back in place of tokens: a token that repeats the one 1, 2 or 3 before
it, an upper-case token, a token that starts a line. Each feature counts by its share of the text's features; the score
is the sparse dot product with the weights. Training reads a sample bounded by PER_CLASS rows for each label; scoring is
one pass over the whole texts without a shuffle.

A null or empty text has no features and gets the bias's score. Repeated rows get equal scores. An empty table gives no
rows. With labels of one kind only, the score is that of their share. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from basketlake.llm import labelled, shared

#: Labelled rows of either label that are learnt from at most.
PER_CLASS = 3000
BUCKETS = 1 << 18
EPOCHS = 4
#: Rates and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.0005, 0.0001
#: A feature's value is its share of a text's features times this.
SCALE = 20.0

_kind = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 word, 2 mark
_kind[:33] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _kind[_a:_b] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a part's rows, row by row, and the first of each row (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _kind[data]
    change = np.empty(len(data), dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][np.diff(offsets) > 0]] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(data))
    real = kind[runs] > 0
    starts, ends = runs[real], ends[real]
    sums = shared.byte_sums(shared.lowered(data))
    token = shared.span_hash(sums, starts, ends)
    first = np.searchsorted(starts, offsets)
    begins = np.zeros(len(token), dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    pair = np.zeros_like(token)
    pair[1:] = shared.mixed(token[:-1] * np.uint64(3) + token[1:])
    pair[begins] = 0
    step = np.zeros(len(token), dtype=np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for back in (3, 2, 1):
        if len(token) > back:
            step[back:] = np.where((token[back:] == token[:-back]) & (row[back:] == row[:-back]), np.uint64(back), step[back:])
    upper = (data[starts] >= 65) & (data[starts] <= 90) & (data[ends - 1] >= 65) & (data[ends - 1] <= 90) & (ends - starts > 1)
    opens = (data[np.maximum(starts - 1, 0)] == 10) | begins
    shape = step + np.uint64(4) * upper + np.uint64(8) * opens + np.uint64(16) * (kind[starts] == 2)
    all_ = np.stack([token, pair, shared.mixed(shape + np.uint64(1))], axis=1).reshape(-1)
    return (all_ % np.uint64(BUCKETS)).astype(np.int64), first * 3


class Model:
    """Weights by bucket, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, first = features(data, offsets)
        share = SCALE / np.maximum(1, np.diff(first))
        return labelled.sigmoid(labelled.row_sums(self.weights[buckets], first) * share + self.bias)


def train(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Updates row by row in a fixed shuffled order; the bias is then moved from the sample's share of ones to `share`."""
    ones = int(labels.sum())
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not 0 < ones < len(labels):
        return Model(np.zeros(BUCKETS), prior)
    rows = []
    for data, offsets in labelled.parts(texts):
        buckets, first = features(data, offsets)
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            found, counts = np.unique(buckets[a:b], return_counts=True)
            rows.append((found.astype(np.int32), (counts * SCALE / max(1, b - a)).astype(np.float32)))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, bias_n = 0.0, 0.0
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            gap = float(labelled.sigmoid(np.array(w @ x + bias))) - labels[i]
            g = gap * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bias_n += gap * gap
            bias -= 0.1 * gap / (1 + np.sqrt(bias_n))
    weights = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(weights, bias + prior - float(np.log(ones / (len(labels) - ones))))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of the documents."""
    model = train(*labelled.sample(docs, labels, "quality", per_class))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    return labelled.scored(docs, lambda data, offsets: held.value.score(data, offsets), threshold).drop(shared.TEXT_HASH)
