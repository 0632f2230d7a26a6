"""Cuts, forms and parts against plain Python; the rank index against all offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from basketlake.llm import fill_middle


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    return (doc_id, n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


def mixed_texts():
    r = random.Random(1)
    kinds = ["abc def", "éàü", "語言模型", "😀🤦🏼‍♂️", "́e", "<P", "S>", "\r\n\t"]
    texts = ["".join(r.choice(kinds) for _ in range(r.randrange(0, 200))) for _ in range(300)]
    return [*texts, "has <P> inside", "<S>", "x<M>", "a" * 50_000 + "語" * 50_000 + "b" * 10, "é" * 3]


def test_all_rows(spark):
    texts = mixed_texts()
    rows = fill_middle.fill_middle(documents(spark, texts)).collect()
    assert Counter(map(tuple, rows)) == Counter(brute(i, t) for i, t in enumerate(texts))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_text_comes_back(spark):
    texts = mixed_texts()
    out = fill_middle.fill_middle(documents(spark, texts))
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back)) == list(enumerate(texts))


def test_odd_rows(spark):
    rows = fill_middle.fill_middle(odd_documents(spark)).collect()
    assert Counter(map(tuple, rows)) == Counter(brute(*r[:2]) for r in odd_rows())
    assert fill_middle.fill_middle(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("error", [0, 1, 5, 127])
def test_index_is_exact_and_bounded(error):
    r = np.random.default_rng(error)
    for widths in (np.ones(5000, int), r.integers(1, 5, 5000), np.repeat(r.integers(1, 5, 50), 100), np.array([], int)):
        offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        index = fill_middle.RankIndex(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all() and np.abs(offsets - index.predicted(ranks)).max() <= error


def test_few_segments():
    offsets = np.concatenate([np.arange(10_000), 10_000 + 3 * np.arange(10_000)])
    assert len(fill_middle.RankIndex(np.arange(10**6)).starts) == 1 and len(fill_middle.RankIndex(offsets).starts) <= 16
