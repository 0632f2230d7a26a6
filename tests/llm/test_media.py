from __future__ import annotations

import numpy as np

from basketlake.llm import media

IMAGES = "class long, pixels array<float>, height int"
QUERIES = IMAGES.replace("class", "query")


def picture(seed, side=48):
    return np.kron(np.random.default_rng(seed).normal(0, 60, (8, 8)), np.ones((side // 8, side // 8)))


def rows(spark, pictures, kind):
    return spark.createDataFrame([(i, None if p is None else [float(x) for x in p.ravel()], None if p is None else len(p)) for i, p in pictures], kind)


def found(spark, images, queries):
    return {(r["query"], r["class"]): r["matches"] for r in media.copy_groups(rows(spark, images, IMAGES), rows(spark, queries, QUERIES)).collect()}


def test_cropped_edited_and_turned_copies(spark):
    images = [(i, picture(i)) for i in range(40)]
    queries = [(100, picture(3)[4:44, 3:45] * 0.7 + 9), (101, np.rot90(picture(4))), (102, media.resized(picture(5), 1.4)), (103, picture(999)), (104, picture(6))]
    got = found(spark, images, queries)
    assert set(got) == {(100, 3), (101, 4), (102, 5), (104, 6)}


def test_search_equals_all_pairs(spark):
    images = [(i, picture(i)) for i in range(60)]
    queries = [(i, picture(i)[5:45, 3:45] * 0.8 - 12) for i in range(0, 60, 5)]
    assert set(found(spark, images, queries)) == {(i, i) for i in range(0, 60, 5)}


def test_odd_images(spark):
    flat, tiny, broken = np.full((48, 48), 7.0), np.zeros((1, 1)), np.full((48, 48), np.nan)
    images = [(0, None), (1, flat), (2, tiny), (3, broken), (4, picture(4)), (5, np.zeros((0, 0)))]
    assert set(found(spark, images, images)) == {(4, 4)}
    uneven = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 2)], IMAGES)
    assert media.copy_groups(uneven, uneven.withColumnRenamed("class", "query")).count() == 0
    empty = spark.createDataFrame([], IMAGES)
    assert media.copy_groups(empty, empty.withColumnRenamed("class", "query")).count() == 0
