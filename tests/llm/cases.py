"""Documents with every odd case: nulls in any column, empty and very long texts, repeated rows and ids, extra columns
whose names the operators use themselves."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, n string, size string, score string, rid string, label string, ids string, k1 string, tie string"


def words(n: int, seed: int, pool: int = 5000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = words(30_000, 1)
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d", "a b c d", "naïve café – ÉCOLE  x", long_text, long_text + " more", words(300, 2), words(300, 2), "\x01 \x02 a@b.co \x01", "x" * 20_000, "é" * 500, "- " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "no id here at all"), (None, None), (-5, "negative id")]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "src", None if t is None else len(t), *["clash"] * 9) for k, (i, t) in enumerate(rows)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3, "n_chars")


def empty_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
