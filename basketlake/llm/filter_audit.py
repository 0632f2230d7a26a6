"""Audit of filters that interact: what each of five filters removes, in each of the 120 orders in which they can stand.

A row fails some of the five filters, so it has one of 32 masks. What happens to it in all 600 steps (120 orders of five
filters) follows from its mask alone, and is written as one big integer: three fields for each step (removed here,
redundant here, kept after it), each wide enough for the count of all rows of the part, so that sums never run into
the next field. A part's answer is one sum of such integers, read back field by field.

Rows are counted by part, mask and label first (one aggregation, combined before the shuffle; at most 128 rows a part), so
a part with most rows of the table is no larger than others where its integers are summed, and rows add their integer
by multiplication with their count. Good and toxic rows are summed in integers of their own. Copies are found on keys
(two hashes and the length of the text), of which only those that occur twice are joined back.

A null text is empty. A null source is the empty part. A null doc_id has no smaller doc_id and is none. Rows of one doc_id
are each counted; equal texts of one doc_id are no copies of each other. Several labels of a doc_id: it is good, or toxic,
if one of them says so; without a label it is neither. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import functools
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
FIELDS = ("removed", "redundant", "kept")
#: White space between words, and the characters of filter D.
BLANKS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: Names of the key columns by which equal texts are known.
KEY = ["__k1", "__k2", "__length"]


@functools.cache
def packed(bits: int) -> list[int]:
    """For each mask the integer with all its outcomes: field FIELDS[f] of step s begins at bit (3 * s + f) * bits."""
    out = []
    for mask in range(1 << len(FILTERS)):
        number = 0
        for s, (order, step) in enumerate(STEPS):
            fails = [mask >> FILTERS.index(name) & 1 for name in order[:step]]
            earlier = any(fails[:-1])
            for f, holds in enumerate((fails[-1] and not earlier, fails[-1] and earlier, not any(fails))):
                number |= int(bool(holds)) << ((3 * s + f) * bits)
        out.append(number)
    return out


def unpacked(number: int, bits: int) -> list[int]:
    """All fields of a sum."""
    width = len(STEPS) * len(FIELDS) * bits
    ones = bin(number)[2:].zfill(width)
    return [int(ones[width - (i + 1) * bits : width - i * bits], 2) for i in range(len(STEPS) * len(FIELDS))]


def _steps_of_part(table: pa.Table) -> pa.Table:
    """600 rows from a part's counts of masks."""
    part = table.column("part")[0].as_py()
    masks, counts = table.column("mask").to_pylist(), table.column("rows").to_pylist()
    bits = sum(counts).bit_length()
    outcomes = packed(bits)

    def summed(flag: str | None) -> list[int]:
        chosen = table.column(flag).to_pylist() if flag else [True] * len(masks)
        return unpacked(sum(outcomes[m] * n for m, n, c in zip(masks, counts, chosen, strict=True) if c), bits)

    every, good, toxic = summed(None), summed("good")[::3], summed("toxic")[::3]
    unique = {name: sum(n for m, n in zip(masks, counts, strict=True) if m == 1 << i) for i, name in enumerate(FILTERS)}
    removed, redundant, kept = every[::3], every[1::3], every[2::3]
    letters = [order[step - 1] for order, step in STEPS]
    shapley = dict.fromkeys(FILTERS, 0)
    for name, n in zip(letters, removed, strict=True):
        shapley[name] += n
    columns = {"part": [part] * len(STEPS), "filter_order": [o for o, _ in STEPS], "step": pa.array([s for _, s in STEPS], pa.int32())}
    columns |= {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": [unique[x] for x in letters]}
    return pa.table(columns | {"good_lost": good, "toxic_lost": toxic, "shapley": [shapley[x] for x in letters]})


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails FILTERS[i]), good, toxic of every row."""
    scratch = shared.Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    rows = rows.withColumn("words", words)
    size, signs = F.size("words"), F.regexp_like("text", F.lit(SIGNS))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [size < 50, 100 * F.size(F.array_distinct("words")) < 65 * size, 100 * capitals > 5 * F.length("text"), signs]
    own = functools.reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)))
    keys = [F.xxhash64("text").alias(KEY[0]), F.hash("text").alias(KEY[1]), F.octet_length("text").alias(KEY[2])]
    rows = scratch.save(rows.select("doc_id", "part", own.cast("int").alias("own"), *keys), "rows")
    first = rows.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = scratch.save(first.select(*KEY, "first"), "first")
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = scratch.save(known.where("good or toxic"), "labels")
    joined = rows.join(shared.bounded(first), KEY, "left").join(shared.bounded(known), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("part", (F.col("own") + copy).cast("int").alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    counts = masked(docs, labels).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("rows"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInArrow(_steps_of_part, schema)
