"""Pictures that share a part and differ in another: classes give the links that all pairs give."""

from __future__ import annotations

import numpy as np
import pytest
from basketlake.llm import media
from test_media_copies import rows_of


def blocks(seed, rows=16, columns=16, side=6):
    return np.kron(np.random.default_rng(seed).normal(0, 60, (rows, columns)), np.ones((side, side)))


def joined(left, right, share):
    """The left part of one picture beside the right part of another."""
    cut = int(left.shape[1] * share) // 6 * 6
    return np.concatenate([left[:, :cut], right[:, cut:]], axis=1)


def links(spark, images, queries):
    images, queries = rows_of(spark, images, "class"), rows_of(spark, queries, "query")
    classes, found = media.copy_classes(images, queries)
    pairs = classes.join(found, "asked_class").select("query", "class")
    return {tuple(r) for r in pairs.collect()}, {(r["query"], r["class"]) for r in media.copy_groups(images, queries).collect()}, {r["query"]: r["asked_class"] for r in classes.collect()}


def test_two_pictures_with_an_equal_half(spark):
    a = blocks(1)
    b = joined(a, blocks(2), 0.5)
    half = a.shape[1] // 2
    images = [(1, a), (2, b), (3, a[:, half:]), (4, b[:, half:])]
    got, every, classes = links(spark, images, [(100, a), (200, b)])
    assert got == every == {(100, 1), (100, 2), (100, 3), (200, 1), (200, 2), (200, 4)}
    assert classes == {100: 100, 200: 200}


@pytest.mark.parametrize("share", [0.3, 0.4, 0.5, 0.6, 0.7])
def test_shared_areas_against_all_pairs(spark, share):
    images, queries = [], []
    for k in range(6):
        a = blocks(10 + k)
        b = joined(a, blocks(50 + k), share)
        cut = int(a.shape[1] * share) // 6 * 6
        images += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, a[:, cut:]), (10 * k + 3, b[:, cut:]), (10 * k + 4, a[:, :cut])]
        queries += [(1000 + 10 * k, a), (1000 + 10 * k + 1, b)]
    got, every, _ = links(spark, images, queries)
    assert got == every
    assert {(1000 + 10 * k + 1, 10 * k + 3) for k in range(6)} <= got and not {(1000 + 10 * k + 1, 10 * k + 2) for k in range(6)} & got
