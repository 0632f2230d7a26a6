from __future__ import annotations

from basketlake.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, key string, at long, level string"


def run(spark, messages):
    df = spark.createDataFrame([(*m, "clash", 1, "clash") for m in messages], COLUMNS)
    return chat.unquoted_conversations(df).collect()


def by_turn(rows):
    return {(r["conv_id"], r["turn"]): r for r in rows}


def test_nested_quotes_link_to_their_messages(spark):
    rows = by_turn(run(spark, [
        (1, 0, "user", "First question\nwith two lines"), (1, 1, "assistant", "An answer."), (1, 2, "user", "> First   QUESTION\n> with two lines\n\nBack to this one"),
        (1, 3, "assistant", ">> An answer.\n> back to this one\nOn Monday someone wrote:\nSure\n\nbye"), (2, 0, "user", "> An answer.\nI saw this elsewhere"), (2, 1, "user", "> never said\nwhat?"), (2, 2, "user", "no quote"),
    ]))
    assert rows[1, 2]["text"] == "Back to this one" and rows[1, 2]["reply_to_turn"] == 0
    assert rows[1, 3]["text"] == "Sure\n\nbye" and rows[1, 3]["reply_to_turn"] == 2 and (rows[1, 3]["n_passages"], rows[1, 3]["n_linked"]) == (2, 2)
    assert rows[1, 3]["formatted"] == "<|assistant|>\nSure\n\nbye\n"
    assert (rows[2, 0]["source_conv_id"], rows[2, 0]["source_turn"], rows[2, 0]["reply_to_turn"]) == (1, 1, None)
    assert (rows[2, 1]["n_passages"], rows[2, 1]["n_linked"], rows[2, 1]["text"], rows[2, 1]["reply_to_turn"]) == (1, 0, "what?", 0)
    assert rows[2, 2]["reply_to_turn"] == 1 and rows[1, 0]["reply_to_turn"] is None


def test_replies_come_later_than_what_they_quote(spark):
    rows = run(spark, [(1, t, "user", "> same words\nsame words") for t in range(5)])
    assert all(r["reply_to_turn"] is None or r["reply_to_turn"] < r["turn"] for r in rows)


def test_odd_rows(spark):
    rows = run(spark, [(None, 0, "user", "> a\nb"), (1, None, None, "x"), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "user", "> "), (3, 0, "user", ">" * 2000 + " deep\n" * 500), (3, 1, "user", "word " * 30000)])
    assert len(rows) == 8
    assert sorted(r["formatted"] for r in rows if r["turn"] is None or r["role"] is None) == ["<|unknown|>\n\n", "<|unknown|>\nx\n"]
    assert chat.unquoted_conversations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_assembled_conversations_are_in_reply_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 4)
    messages = [(1, t, "user", f"> say {t - 1}\nsay {t}" if t else "say 0") for t in range(10)] + [(2, 0, "a", "z"), (2, 0, "a", "b"), (None, 1, "a", "c"), (None, 1, "a", "d"), (3, None, "a", "e")]
    df = spark.createDataFrame([(*m, "clash", 1, "clash") for m in messages], COLUMNS)
    rows = chat.assembled(chat.unquoted_conversations(df)).collect()
    one = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["piece"])
    assert [r["turns"] for r in one] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert sum((r["replies"] for r in one), []) == [None, *range(9)]
    assert "".join(r["text"] for r in one) == "".join(f"<|user|>\nsay {t}\n" for t in range(10))
    assert [r["text"] for r in rows if r["conv_id"] == 2] == ["<|a|>\nb\n<|a|>\nz\n"]
    assert sorted(r["text"] for r in rows if r["conv_id"] is None or r["conv_id"] == 3) == ["<|a|>\nc\n", "<|a|>\nd\n", "<|a|>\ne\n"]
    assert chat.assembled(chat.unquoted_conversations(df.limit(0))).count() == 0
