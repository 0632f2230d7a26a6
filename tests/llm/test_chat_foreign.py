"""Quotations of other conversations, where the own one has the passage as well, but later."""

from __future__ import annotations

from basketlake.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    out = chat.unquoted_conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    return {(r["conv_id"], r["turn"]): (r["n_linked"], r["source_conv_id"], r["source_turn"]) for r in out}


def test_a_passage_that_the_own_conversation_has_later(spark):
    passage = "a passage of some words that two conversations have"
    rows = [(5, 0, "user", f"> {passage}\n\nsee above"), (5, 3, "user", passage), (9, 2, "user", passage)]
    assert linked(spark, rows)[5, 0] == (1, 9, 2)
    assert linked(spark, rows[:1] + rows[2:])[5, 0] == (1, 9, 2)
    assert linked(spark, rows[:2])[5, 0] == (0, None, None)


def test_the_least_other_conversation_counts(spark):
    passage = "words that many conversations quote from each other"
    rows = [(c, 1, "user", passage) for c in range(2, 60)] + [(2, 0, "user", f"> {passage}"), (30, 0, "user", f"> {passage}"), (70, 5, "user", f"> {passage}\n\nyes")]
    got = linked(spark, rows)
    assert got[2, 0] == (1, 3, 1) and got[30, 0] == (1, 2, 1) and got[70, 5] == (1, 2, 1)
