"""The audit against running each order of filters row by row."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from cases import empty_documents, odd_documents, odd_rows, words

from basketlake.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    """Mask letters of each row (doc_id, text, source)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        yield doc_id, source or "", f + "E" * (doc_id is not None and least[t] < doc_id)


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for doc_id, part, f in failed(rows):
        parts[part].append((doc_id, f))
    out = {}
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, name in enumerate(order, 1):
                gone, left = [m for m in left if name in m[1]], [m for m in left if name not in m[1]]
                fails = sum(name in f for _, f in members)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(f == name for _, f in members), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for name in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == name)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == name:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def got(docs, labels):
    rows = filter_audit.audit_filters(docs, labels).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}


def test_all_orders(spark):
    r = random.Random(3)
    texts = [words(r.choice([5, 49, 50, 80]), r.randrange(40), r.choice([20, 5000])) + r.choice(["", " $", " ABCDEFGHIJKLMNOPQ", " | LOUD WORDS HERE"]) for _ in range(300)]
    rows = [(i, t, r.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), spark.createDataFrame(labels, LABELS)) == brute(rows, labels)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 1)], LABELS)
    assert got(odd_documents(spark), labels) == brute([(d[0], d[1], d[3]) for d in odd_rows()], [(3, 1, None)])
    assert not got(empty_documents(spark), labels)
    assert got(odd_documents(spark), spark.createDataFrame([], LABELS)) == brute([(d[0], d[1], d[3]) for d in odd_rows()], [])


def test_fields_do_not_run_over(spark):
    """Counts that fill a field to its last bit."""
    rows = [(i, "same text", "p") for i in range(255)] + [(1000 + i, "", "q") for i in range(256)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)) == brute(rows, [])


def test_packing():
    for bits in (1, 7, 40):
        most = (1 << bits) - 1
        for mask, number in enumerate(filter_audit.packed(bits)):
            one = filter_audit.unpacked(number, bits)
            assert filter_audit.unpacked(number * most, bits) == [most * x for x in one]
            per_order = Counter(filter_audit.STEPS[i // 3][0] for i, x in enumerate(one) if x and i % 3 == 0)
            assert len(per_order) == (120 if mask else 0) and set(per_order.values()) <= {1}
