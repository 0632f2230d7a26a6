"""Near copies of one text are shipped to few pairs of blocks, in families of many blocks, and no link is lost."""

from __future__ import annotations

import random

from cases import documents, words
from test_jaccard import brute, edited

from basketlake.llm import jaccard, shared


def test_near_copies_are_shipped_to_few_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", 8000)
    monkeypatch.setattr(jaccard, "SET", 50)
    counts, save = {}, shared.Scratch.save

    def counted(self, df, name, *args, **options):
        out = save(self, df, name, *args, **options)
        if name in ("pairs-units", "placed"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(shared.Scratch, "save", counted)
    rng, base, size = random.Random(3), words(150, 7), 400
    texts = [edited(base, rng.choice([1, 2, 3, 4, 5, 6]), rng) for _ in range(size)]
    got = jaccard.jaccard_components(documents(spark, texts), 5, 80).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(list(range(size)), texts, 5, 80)
    assert counts.get("placed", 0) <= 2 * size  # lists of candidates, not a row for each
    assert counts.get("pairs-units", 0) <= 3 * size
