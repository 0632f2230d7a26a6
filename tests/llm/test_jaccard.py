from __future__ import annotations

import random
import re

import numpy as np
import pytest
from cases import documents, empty_documents, odd_documents, odd_rows, words

from basketlake.llm import jaccard


def sets_of(texts, n):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, n, percent):
    sets, root = sets_of(texts, n), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((str(ids[i]), len(sets[i]), str(least[find(i)] if sets[i] else ids[i])) for i in range(len(ids))))


def edited(text, k, rng):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(spark, n, percent):
    rng, texts = random.Random(n), []
    common = words(80, 99)
    for i in range(12):
        base = words(rng.choice([5, 9, 30, 120, 300]), i)
        texts += [base] + [edited(base, rng.randrange(6), rng) for _ in range(6)] + [common + " " + base, base + " " + words(20, 1000 + i)]
    chain = words(100, 500)
    for _ in range(15):  # each links with the one before, the ends do not
        texts.append(chain)
        chain = " ".join(chain.split()[2:]) + " " + words(2, rng.randrange(10**6))
    got = jaccard.jaccard_components(documents(spark, texts), n, percent).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(list(range(len(texts))), texts, n, percent)


@pytest.mark.parametrize("unit", [1500, 6000])
def test_large_families_in_blocks(spark, monkeypatch, unit):
    """Copies that all link, chains whose ends don't, and texts that share most words without linking, all in one family."""
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "SET", 200)
    rng, base = random.Random(1), words(200, 7)
    texts = [edited(base, rng.randrange(12), rng) for _ in range(40)]
    texts += [" ".join(base.split()[:120]) + " " + words(60, 300 + i) for i in range(10)]
    chain = base
    for _ in range(20):
        texts.append(chain)
        chain = " ".join(chain.split()[3:]) + " " + words(3, rng.randrange(10**6))
    got = jaccard.jaccard_components(documents(spark, texts), 4, 85).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(list(range(len(texts))), texts, 4, 85)


def test_known_components_are_not_walked_again():
    sets = [np.arange(i, i + 20, dtype=np.uint32) for i in (0, 1, 50, 51)]
    assert jaccard.linked(sets, 85, np.array([9, 9, 8, 7])).tolist() == [0, 0, 2, 2]
    assert jaccard.linked([sets[0], sets[2]], 85, np.array([5, 5])).tolist() == [0, 0]


def test_odd_rows(spark):
    got = jaccard.jaccard_components(odd_documents(spark), 4, 85).collect()
    ids, texts = zip(*((d[0], d[1]) for d in odd_rows()), strict=True)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(ids, texts, 4, 85)
    assert jaccard.jaccard_components(empty_documents(spark), 4, 85).count() == 0


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(0)
    for trial in range(60):
        base = rng.choice(60, 25, replace=False)
        sets = []
        for _ in range(rng.integers(1, 14)):
            keep = base[rng.random(25) > 0.12]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 80, rng.integers(0, 4))])).astype(np.uint32))
        percent = int(rng.choice([50, 80, 85, 100]))
        got = jaccard.linked(sets, percent)
        root = list(range(len(sets)))
        for _ in sets:
            for a in range(len(sets)):
                for b in range(len(sets)):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[a] = root[b] = min(root[a], root[b])
        assert got.tolist() == root, trial


@pytest.mark.parametrize("cells", [1, 700, 1 << 20])
def test_one_block_walks_through_both(monkeypatch, cells):
    """Links between a block that walks and one that does not, in batches of any size, equal those of all such pairs."""
    monkeypatch.setattr(jaccard, "CELLS", cells)
    rng, percent = np.random.default_rng(1), 80
    for trial in range(20):
        base, sets = rng.choice(60, 25, replace=False), []
        for _ in range(30):
            keep = base[rng.random(25) > 0.12]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 80, rng.integers(0, 4))])).astype(np.uint32))
        walks = rng.random(30) < 0.5
        got, root = jaccard.linked(sets, percent, walks=walks), list(range(30))
        for _ in sets:
            for a in range(30):
                for b in range(30):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (walks[a] or walks[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[a] = root[b] = min(root[a], root[b])
        assert got.tolist() == root, trial


def test_dropping_keeps_one_of_each_group(spark):
    base = words(50, 3)
    texts = [base, base + " x", words(50, 4), None, "", base]
    kept = jaccard.drop_near_copies(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3, 4]


def test_dropping_looks_at_texts_not_ids_alone(spark):
    base, other = words(50, 3), words(50, 5)
    rows = [(1, base, "a"), (1, base, "b"), (1, other, "c"), (2, base + " x", "d"), (None, base, "e"), (None, words(40, 9), "f"), (None, words(40, 9), "g"), (7, "", "h"), (7, "", "h")]
    kept = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", base), ("1", other), ("None", words(40, 9)), ("7", ""), ("7", "")])
