"""Recall of paraphrases against what was planted, by share of words replaced."""

from __future__ import annotations

import random

import pytest
from cases import documents, words

from basketlake.llm import decontam


@pytest.mark.parametrize(("replaced", "least"), [(0.0, 1.0), (0.2, 0.95), (0.3, 0.9)])
def test_planted_paraphrases(spark, replaced, least):
    rng = random.Random(int(100 * replaced))
    bench = [words(rng.randrange(20, 50), 700_000 + i, pool=4000) for i in range(80)]
    docs = []
    for i in range(600):
        text = words(rng.randrange(40, 300), i, pool=4000)
        if i < 80:
            leak = bench[i].split()
            for j in rng.sample(range(len(leak)), round(replaced * len(leak))):
                leak[j] = f"w{rng.randrange(4000)}"
            text = f"{text} {' '.join(leak)} {words(rng.randrange(100), 9000 + i, pool=4000)}"
        docs.append(text)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents(spark, docs), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).collect()}
    planted = {(i, i) for i in range(80)}
    assert len(found & planted) >= least * 80 and not found - planted
