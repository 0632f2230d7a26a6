"""The registered image query lists every copy, not the best one alone."""

from __future__ import annotations

import numpy as np
import pytest
from basketlake.llm import media, queries


def test_all_copies_are_listed(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.125, (12, 64)).astype(np.float32)
    near = lambda v, i: v + np.random.default_rng(i).normal(0, 0.001, 64).astype(np.float32)
    # 100 is a query; 7 and 8 are its exact copies, 31 and 32 its noisy ones; 33 equals 32
    table = [(100, vectors[0]), (7, vectors[0]), (8, vectors[0]), (31, near(vectors[0], 1)), (32, near(vectors[0], 2)), (33, near(vectors[0], 2))]
    table += [(200 + i, v) for i, v in enumerate(vectors[1:], 1)]
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op2_media(spark, str(tmp_path)).collect()
    asked = {r["vec_id"]: r["asked_class"] for r in rows if r["asked_class"] is not None}
    assert set(asked) == {100, 200} or set(asked) == {100}
    found = {(r["vec_id"], r["image_class"]) for r in rows if r["copy_of"] == asked[100]}
    assert found == {(100, 7), (7, 7), (8, 7), (31, 31), (32, 32), (33, 32)}
    assert all(r["matches"] >= 5 and r["links"] == 1 for r in rows if r["copy_of"] is not None)
    assert sorted(r["vec_id"] for r in rows) == sorted(i for i, _ in table)


def drawn(v, top=0, left=0, height=48, width=48, gain=1.0, lift=0.0):
    """The mosaic of `queries.mosaic`, in numpy."""
    whole = np.kron(v.reshape(8, 8).astype(float) * 400, np.ones((6, 6)))
    return whole[top : top + height, left : left + width] * gain + lift


def rows_of(spark, pictures, name):
    return spark.createDataFrame([(i, [float(x) for x in p.ravel()], len(p)) for i, p in pictures], f"{name} long, pixels array<float>, height int")


@pytest.mark.parametrize(("edit", "noise"), [((5, 3, 40, 42, 0.8, -12.0), 0.12), ((0, 0, 48, 48, 0.5, 30.0), 0.15), ((10, 12, 36, 34, 0.9, 5.0), 0.1)])
def test_links_over_classes_against_all_pairs(spark, edit, noise):
    """Groups of noisy copies, some of them queries, at three edits: brute force holds each query's vector against all."""
    rng = np.random.default_rng(5)
    bases = rng.normal(0, 0.125, (60, 64))
    sizes = [25, 12, 4, 2] + [1] * 56
    vectors = [b + (rng.normal(0, 0.125 * noise, 64) if k else 0) for b, n in zip(bases, sizes, strict=True) for k in range(n)]
    asked = list(range(0, 40, 4)) + list(range(45, len(vectors), 7))
    classes, found = media.copy_classes(
        rows_of(spark, [(i, drawn(v)) for i, v in enumerate(vectors)], "class"), rows_of(spark, [(i, drawn(vectors[i], *edit)) for i in asked], "query")
    )
    in_class = {}
    for r in found.collect():
        in_class.setdefault(r["asked_class"], set()).add(r["class"])
    own = {r["query"]: r["asked_class"] for r in classes.collect()}
    got = {(q, i) for q in asked for i in in_class.get(own.get(q), ())}
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    want = {(q, i) for q in asked for i in range(len(vectors)) if unit[q] @ unit[i] > 0.9}
    assert not got - want
    assert len(got & want) >= 0.9 * len(want)
    assert len(set(own.values())) < len(own)  # queries of a group stand together
