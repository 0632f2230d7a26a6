"""Repeated windows against a table of all windows; levels name alike what windows hold alike."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty_documents, odd_documents, odd_rows, words

from basketlake.llm import recompression, shared


def order_of(text: str | None) -> int:
    """Place of a text among those of one doc_id: the fixtures have none where it matters."""
    return 0


def brute(rows: list[tuple], window: int) -> Counter:
    """(doc_id, n_words, n_removed, text) by a set of the windows met so far."""
    met, out = set(), Counter()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, order_of(r[1]))):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in met:
                gone |= set(range(p, p + window))
            met.add(key)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id, len(w), len(gone), " ".join(kept)] += 1
    return out


def got(df, window=20):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in recompression.remove_repeats(df, window).collect())


def passages(seed: int) -> list[str]:
    """Texts made of shared passages, own words, runs and periodic stretches, of few and of many different words."""
    r = random.Random(seed)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    few = lambda n, k: [f"w{r.randrange(k)}" for _ in range(n)]
    shared_ = [fresh(r.randrange(19, 400)) for _ in range(6)] + [few(60, 3) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            kind = r.randrange(6)
            p = r.choice(shared_)
            a = r.randrange(len(p))
            parts += [p, p[a : a + r.randrange(5, 80)], fresh(r.randrange(40)), few(r.randrange(80), 2), few(1, 5) * r.randrange(70), few(r.randrange(1, 9), 9) * r.randrange(12)][kind]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_all_windows(spark, seed):
    texts = passages(seed)
    texts += texts[:7] + [texts[3] + " end", "start " + texts[3]]
    assert got(documents(spark, texts)) == brute(list(enumerate(texts)), 20)


@pytest.mark.parametrize("window", [2, 5, 40])
def test_other_windows(spark, window):
    texts = passages(window)[:30]
    assert got(documents(spark, texts), window) == brute(list(enumerate(texts)), window)


def test_one_pair_of_words_everywhere(spark):
    texts = ["yes no " * n for n in range(40)] + ["a " * n for n in range(40)]
    assert got(documents(spark, texts)) == brute(list(enumerate(texts)), 20)


def test_odd_rows(spark):
    assert got(odd_documents(spark)) == brute([r[:2] for r in odd_rows()], 20)
    assert not got(empty_documents(spark))


def test_repeated_rows(spark):
    long, short = words(50, 3), words(10, 4)
    rows = [(7, long)] * 40 + [(7, short)] * 5 + [(None, long)] * 3 + [(8, long + " tail of its own")] * 2 + [(None, None)] * 2
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows, 20)


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    texts = passages(9)
    assert got(documents(spark, texts)) == brute(list(enumerate(texts)), 20)


def parsed(text: str, levels: int):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    texts = recompression.Texts(data, np.array([0, len(data)]), 20)
    level = recompression.Level(texts.words.copy(), texts.first)
    for _ in range(levels):
        level.up()
    return texts, level


@pytest.mark.parametrize("levels", [1, 2, 4, 8])
def test_names_depend_on_the_words_that_they_say(levels):
    """A symbol whose words [low, high) stand in another text is there, too, with its name and span."""
    r = random.Random(levels)
    middle = " ".join(f"w{r.randrange(4)}" for _ in range(150))
    one, two = f"x y z {middle} x", f"{words(40, 2, 3)} {middle} {words(30, 5, 3)}"
    (_, a), (_, b) = parsed(one, levels), parsed(two, levels)
    there = {(n, s, e, low, high) for n, s, e, low, high in zip(b.names, b.start - 40, b.end - 40, b.low - 40, b.high - 40, strict=True)}
    inner = [x for x in zip(a.names, a.start - 3, a.end - 3, a.low - 3, a.high - 3, strict=True) if x[3] >= 0 and x[4] <= 150]
    assert inner and all(x in there for x in inner)


def test_symbols_tile_the_words_and_stand_for_them():
    texts, level = parsed(" ".join(passages(4)), 6)
    assert level.start[0] == 0 and level.end[-1] == len(texts.words) and (level.end[:-1] == level.start[1:]).all()
    meaning = {}
    for n, s, e in zip(level.names, level.start, level.end, strict=True):
        assert meaning.setdefault(int(n), tuple(texts.words[s:e])) == tuple(texts.words[s:e])


def test_long_copies_are_proven_by_symbols_not_windows(spark):
    """Of near copies of one long text, few windows are left to compare."""
    base = words(4000, 7, 10**6)
    texts = [f"{base} {words(30, 100 + i, 10**6)}" for i in range(20)]
    rounds = recompression._Rounds(documents(spark, texts), 20)
    looked = rounds.run()
    assert sum(len(r["starts"] or ()) for r in looked.collect()) < 0.1 * 20 * 4000


