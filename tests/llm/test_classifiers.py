from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from cases import documents, empty_documents, odd_documents, odd_rows, words

from basketlake.llm import labelled as labelled_rows
from basketlake.llm import quality, toxicity


def labelled(spark, n, make):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        texts.append(make(i, i % 3 == 0, rng))
        labels.append((i, int(i % 3 == 0), int(i % 3 == 0)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def junk(i, good, rng):
    return " ".join(w if good else w + "%%% !!" for w in words(60, i).split())


def insult(i, toxic, rng):
    w = words(60, i).split()
    if toxic:
        stem = rng.choice(["dumbhead", "blockhead"])
        w[rng.randrange(60)] = stem[:6] + rng.choice("xyz") + stem[6:] if rng.random() < 0.3 else stem
    return " ".join(w)


@pytest.mark.parametrize(("score", "make"), [(quality.score_quality, junk), (toxicity.score_toxicity, insult)])
def test_held_out_accuracy(spark, score, make):
    docs, labels = labelled(spark, 900, make)
    rows = score(docs, labels, 0.5).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize(("score", "make"), [(quality.score_quality, junk), (toxicity.score_toxicity, insult)])
def test_held_out_labels_are_not_used(spark, score, make):
    docs, labels = labelled(spark, 300, make)
    spoilt = spark.createDataFrame([(i, 1, 1) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], labels.schema)
    key = lambda df: sorted((r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(score(docs, labels)) == key(score(docs, spoilt))


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, score):
    docs, labels = labelled(spark, 60, junk)
    model_docs = docs.unionByName(odd_documents(spark).select("doc_id", "text"))
    rows = score(model_docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))).collect()
    assert len(rows) == 60 + len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    one_kind = labels.where("quality = 1")
    assert {r["predicted"] for r in score(docs, one_kind).collect()} == {1}
    assert {r["score"] for r in score(docs, labels.limit(0)).collect()} != set()
    assert score(empty_documents(spark), labels).count() == 0


def test_long_texts_are_scored_whole():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -3.0)
    data = np.frombuffer(b"calm " * 50_000 + b"dumbhead", dtype=np.uint8)
    plain = model.score(data, np.array([0, len(data)]))
    _, starts, ends, _ = toxicity.shared.letter_words(data, np.array([0, len(data)]))
    s, e, h, _ = toxicity.distinct(data, starts, ends)
    last = int(np.argmax(e - s))
    buckets, _ = toxicity.grams(data, s[[last]], e[[last]], h[[last]])
    model.values[buckets] = 50.0
    assert plain[0] < 0.1 and model.score(data, np.array([0, len(data)]))[0] > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_equal_texts_get_equal_scores_wherever_they_stand(module):
    rng = np.random.default_rng(3)
    model = module.Model(rng.normal(size=module.BUCKETS), -0.3)
    texts = [words(n, n) + "!" * (n % 3) for n in (1, 2, 3, 4, 5, 7, 30, 300, 2000)]
    alone = {t: model.score(*labelled_rows.as_part([t]))[0] for t in texts}
    for trial in range(5):
        order = [*rng.permutation(texts * 3), "", *rng.permutation(texts)]
        got = model.score(*labelled_rows.as_part(list(map(str, order))))
        assert all(s == alone[t] for t, s in zip(order, got, strict=True) if t), trial


def test_toxicity_scores_equal_plain_python():
    """Windows of all subwords of WINDOW words, one at every STRIDE words; the bag's mean; the maximum over windows."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.2)

    def bag(word):
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        _, s, e, _ = toxicity.shared.letter_words(data, np.array([0, len(data)]))
        s, e, h, _ = toxicity.distinct(data, s, e)
        return model.values[toxicity.grams(data, s, e, h)[0]].tolist()

    for n in (0, 1, 2, 3, 4, 5, 6, 9, 40):
        text = words(n, n, pool=30).split()
        bags = [bag(w) for w in text]
        starts = range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        means = [np.mean(sum(bags[a : a + toxicity.WINDOW], [])) for a in starts if bags[a : a + toxicity.WINDOW]]
        want = 1 / (1 + np.exp(-(max(means, default=0.0) + 0.2)))
        assert model.score(*labelled_rows.as_part([" ".join(text)]))[0] == pytest.approx(want)


def test_two_words_that_are_toxic_together_alone(spark):
    """Each of two words is harmless; side by side they are not. One word at a time could not tell."""

    def make(i, toxic, rng):
        w = words(40, i).split()
        at = rng.randrange(2, 30)
        w[at : at + 2] = ["rotten", "goblin"] if toxic else [["rotten", "apple"], ["nice", "goblin"]][i % 2]
        return " ".join(w)

    docs, labels = labelled(spark, 900, make)
    held = [r for r in toxicity.score_toxicity(docs, labels, 0.5).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.9


def test_held_out_figures_on_the_tables(spark):
    """Recall and precision on the held-out labels of sf0.1."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    for score, label in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        rows = score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
        hits = sum(r["predicted"] == 1 and r[label] == 1 for r in rows)
        assert hits >= 0.85 * sum(r[label] for r in rows) and hits >= 0.8 * sum(r["predicted"] for r in rows)


def test_a_repeated_id_counts_once_and_bytes_are_bounded(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, words(100, i)) for i in range(2, 60)] + [(60, words(5000, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 61)], "doc_id long, quality int, toxic int")
    texts, ones, _ = labelled_rows.sample(docs, labels, "toxic", 100, 20_000)
    assert len(texts) == len(ones) and len({t for t in texts if t.startswith("text")}) <= 1
    assert sum(len(t) for t in texts) <= 20_000 and max(map(len, texts)) < 10_000 and 0 < ones.mean() < 1
