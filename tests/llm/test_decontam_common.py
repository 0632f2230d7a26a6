"""Items whose own terms are common, since they leak widely or the table is tiny."""

from __future__ import annotations

import random

import numpy as np
from cases import documents, words
from test_decontam import items

from basketlake.llm import decontam


def leaks(spark, docs, bench):
    return {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents(spark, docs), items(spark, bench)).collect()}


def test_an_item_in_half_of_all_documents(spark):
    bench = [words(40, 900 + i) for i in range(5)]
    changed = " ".join("other" if j % 6 == 5 else w for j, w in enumerate(bench[2].split()))
    docs = [f"{words(30 + i % 40, i)} {bench[2] if i % 4 else changed} {words(50, 5000 + i)}" if i % 2 else words(100, i) for i in range(200)]
    docs[0] += " " + bench[3]
    assert leaks(spark, docs, bench) == {(i, 2) for i in range(1, 200, 2)} | {(0, 3)}


def test_two_documents_of_a_tiny_table(spark):
    bench = [words(30, 900), words(30, 901)]
    docs = [f"{words(20, 1)} {bench[0]} {words(20, 2)}", f"{words(9, 3)} {bench[0]}", words(60, 4)]
    assert leaks(spark, docs, bench) == {(0, 0), (1, 0)}
    assert leaks(spark, [bench[0]], bench) == {(0, 0)}


def test_one_paraphrase_that_is_copied_often(spark):
    """The words that the paraphrase leaves out are the rarest of all; they must not be the only ones asked for."""
    bench = [words(30 + i, 900 + i, pool=3000) for i in range(12)]
    changed = " ".join("other" if j % 6 == 5 else w for j, w in enumerate(bench[3].split()))
    for n in (2, 40, 200):
        docs = [words(40 + i % 50, i, pool=3000) + (f" {changed} {words(30, 9000 + i, pool=3000)}" if i < n else "") for i in range(200)]
        assert leaks(spark, docs, bench) == {(i, 3) for i in range(n)}


def test_recall_against_all_windows_and_items(spark):
    """Whole items and paraphrases of three strengths against a search that holds every window against every item."""
    rng = random.Random(7)
    bench = [words(rng.randrange(16, 50), 900 + i, pool=2000) for i in range(25)]
    docs = []
    for i in range(160):
        leak = bench[i % 25].split()
        for j in range(len(leak)):
            if rng.random() < (0, 0.1, 0.2, 0.3)[i % 4]:
                leak[j] = f"new{rng.randrange(50)}"
        docs.append(f"{words(rng.randrange(60), i, pool=2000)} {' '.join(leak) if i % 5 else ''} {words(rng.randrange(60), 5000 + i, pool=2000)}")
    got = leaks(spark, docs, bench)

    code = {w: k for k, w in enumerate(sorted({w for t in bench for w in t.split()}))}
    coded = lambda t: np.array([code.get(w, len(code)) for w in t.split()], dtype=np.int64)
    seen = np.zeros(len(code) + 1)
    texts, items_ = [coded(t) for t in docs], [coded(t) for t in bench]
    for t in texts:
        for a in range(0, len(t), decontam.STRIDE):
            seen[np.unique(t[a : a + decontam.STRIDE])] += 1
    total = sum(-(-len(t) // decontam.STRIDE) for t in texts)
    idf = np.log((total + 1) / (seen + 1))
    want, nearly = set(), set()  # terms of equal weight may be taken in another order, so some pairs are nearly leaks
    for k, item in enumerate(items_):
        terms = decontam.answer_terms(item, idf)
        reach = max(2, len(item) // decontam.STRIDE + 1)
        for d, t in enumerate(texts):
            for a in range(0, len(t), decontam.STRIDE):
                near = t[max(0, a - decontam.STRIDE) : a + (reach + 1) * decontam.STRIDE]
                share = len(terms & set(near.tolist())) / len(terms)
                if share < decontam.ANSWERS_SOME - 0.2 or (d, k) in want:
                    continue
                lcs = decontam.common_subsequence(item, near) / len(item)
                if lcs >= decontam.LCS_LEAST:
                    nearly.add((d, k))
                if share >= decontam.ANSWERS_SOME and lcs >= decontam.LCS_SURE or lcs >= decontam.LCS_LEAST and share >= decontam.ANSWERS_MOST:
                    want.add((d, k))
    assert len(want) > 90 and not got - nearly
    assert len(got & want) >= 0.9 * len(want)
