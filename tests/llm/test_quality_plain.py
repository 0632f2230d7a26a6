"""Features and updates of the quality classifier against plain Python: dictionaries, one number at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, words

from basketlake.llm import labelled, quality, shared

MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 30)) * shared.MIX_A & MASK
    h = (h ^ (h >> 27)) * shared.MIX_B & MASK
    return h ^ (h >> 31)


def token_hash(token):
    return mixed((sum((b + 1) * pow(shared.BYTE_STEP, i, 1 << 64) for i, b in enumerate(token)) + len(token)) & MASK)


def tokens_of(data):
    """(bytes, kind, byte before) of the runs of word bytes and of other visible ones."""
    kind = lambda b: 0 if b < 33 else 1 if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 2
    out, at = [], 0
    while at < len(data):
        end = at
        while end < len(data) and kind(data[end]) == kind(data[at]):
            end += 1
        if kind(data[at]):
            out.append((data[at:end], kind(data[at]), data[at - 1] if at else None))
        at = end
    return out


def plain_features(text):
    """Bucket: how often."""
    found, out = tokens_of(text.encode()), Counter()
    hashes = [token_hash(bytes(b | 32 if 65 <= b <= 90 else b for b in t)) for t, _, _ in found]
    for i, (t, kind, before) in enumerate(found):
        step = next((back for back in (1, 2, 3) if i >= back and hashes[i - back] == hashes[i]), 0)
        upper = len(t) > 1 and 65 <= t[0] <= 90 and 65 <= t[-1] <= 90
        shape = step + 4 * upper + 8 * (i == 0 or before == 10) + 16 * (kind == 2)
        pair = mixed((hashes[i - 1] * 3 + hashes[i]) & MASK) if i else 0
        for h in (hashes[i], pair, mixed(shape + 1)):
            out[h % quality.BUCKETS] += 1
    return out


def plain_model(texts, labels, share):
    """Weights and bias after all epochs."""
    rows = [{k: c * quality.SCALE / sum(f.values()) for k, c in f.items()} for f in map(plain_features, texts)]
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= quality.L1 else -(zk - math.copysign(quality.L1, zk)) / ((quality.BETA + math.sqrt(nk)) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(rows)):
            w = {k: weight(k) for k in rows[i]}
            gap = 1 / (1 + math.exp(-(sum(w[k] * x for k, x in rows[i].items()) + bias))) - labels[i]
            for k, x in rows[i].items():
                g = gap * x
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
            bias_n += gap * gap
            bias -= 0.1 * gap / (1 + math.sqrt(bias_n))
    ones = sum(labels)
    return {k: weight(k) for k in z}, bias + math.log(share / (1 - share)) - math.log(ones / (len(labels) - ones))


def plain_score(model, text):
    weights, bias = model
    f = plain_features(text)
    return 1 / (1 + math.exp(-(sum(weights.get(k, 0.0) * c for k, c in f.items()) * quality.SCALE / max(1, sum(f.values())) + bias)))


def sample_texts():
    rng = random.Random(2)
    odd = ["", " \n\t", "One", "a a a b b", "- - -\nLOUD Words Here!!", "naïve ÉCOLE x\ny", "x" * 300, "1 2 3, 4; 5"]
    return odd + [(words(rng.randrange(5, 60), i, 50) if i % 2 else f"BUY {words(5, i, 9)} !!! " * 4) for i in range(60)]


def test_features_of_each_row():
    texts = sample_texts()
    buckets, first = quality.features(*labelled.as_part(texts))
    for i, t in enumerate(texts):
        assert Counter(buckets[first[i] : first[i + 1]].tolist()) == plain_features(t)


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_updates_and_scores(share):
    texts = [t for t in sample_texts() if t.strip()]
    labels = np.array([float(i % 2) for i in range(len(texts))])
    model, want = quality.train(texts, labels, share), plain_model(texts, labels, share)
    assert model.bias == pytest.approx(want[1], abs=1e-5)
    assert {int(k) for k in np.flatnonzero(np.abs(model.weights) > 1e-4)} == {k for k, w in want[0].items() if abs(w) > 1e-4}
    assert all(model.weights[k] == pytest.approx(w, abs=1e-4) for k, w in want[0].items())
    got = model.score(*labelled.as_part(texts + sample_texts()))
    assert got == pytest.approx([plain_score(want, t) for t in texts + sample_texts()], abs=1e-4)


def test_whole_operator(spark):
    """score_quality over a table, with labels of all rows, against the plain model of the rows that may be learnt from."""
    texts = sample_texts()
    labels = [(i, i % 2, 0) for i in range(len(texts))]
    rows = quality.score_quality(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = {r["doc_id"]: r["held_out"] for r in rows}
    learnt = [i for i in range(len(texts)) if not held[i]]
    want = plain_model([texts[i] for i in learnt], [float(i % 2) for i in learnt], sum(i % 2 for i in learnt) / len(learnt))
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx({i: plain_score(want, t) for i, t in enumerate(texts)}, abs=1e-4)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
