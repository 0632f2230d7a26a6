"""Token files and packing against whole-text encoding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty_documents, odd_documents, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlake.llm import packing, shared, token_files, tokens
from basketlake.llm.queries import vocabulary


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    out = []
    for _, data, offsets in shared.slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        ids, counts = tokens.encoder(vocabulary()).encode(data, offsets)
        ends = np.cumsum(counts)
        out += [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    return out


PLAIN = st.text(alphabet=st.one_of(st.sampled_from("ab's  \n\t1.,  　é<|>"), st.characters(exclude_categories=["Cs"])), max_size=40)
ADDED = st.lists(st.one_of(PLAIN, st.just("<|endoftext|>"), st.just("<|endoftext")), max_size=5).map("".join)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(PLAIN, ADDED), max_size=6))
def test_parts_give_the_ids_of_the_whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    assert encoded(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_are_one_id(plain):
    texts = ["a <|endoftext|> b", "", "plain <text> only", "x<|endoftext|>", "<|endoftext|><|endoftext|> " * 3, "<|endof", "text|>"]
    got = encoded(texts)
    assert got == [plain(t) for t in texts] and got[0] == [64, 220, 50256, 275]


def test_forgetting_keeps_ids_right(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(shared, "held", {})
    for seed in range(5):
        texts = [words(60, seed), words(60, 0)]
        assert encoded(texts) == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 300), max_size=50))
def test_coding_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    assert token_files.decoded(*token_files.coded(ranks), len(ranks)).tolist() == values


def held_by(files):
    return sorted(((r["doc_id"], r["start"], list(r["ids"])) for r in files.collect()), key=lambda r: r[1])


def test_files_round_trip(spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    token_files.write_token_files(odd_documents(spark), str(tmp_path / "odd"), vocabulary())
    rows = held_by(token_files.read_token_files(spark, str(tmp_path / "odd")))
    ids = [r[0] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert sorted((str(i), x) for i, _, x in rows) == sorted((str(d[0]), [*plain(d[1]), 0]) for d in odd_rows())
    start = 0
    for _, s, x in rows:
        assert s == start
        start += len(x)
    digests = {(r["doc_id"], r["start"]): r for r in token_files.token_file_digests(spark, str(tmp_path / "odd")).collect()}
    for i, s, x in rows:
        assert digests[i, s]["n_tokens"] == len(x) and digests[i, s]["ids_crc32"] == zlib.crc32(np.array(x, dtype="<u4"))
    counts = spark.read.parquet(str(tmp_path / "odd" / "ranks")).orderBy("rank").collect()
    assert [r["count"] for r in counts] == sorted((r["count"] for r in counts), reverse=True)


def test_empty_files(spark, tmp_path):
    token_files.write_token_files(empty_documents(spark), str(tmp_path / "none"), vocabulary())
    assert token_files.token_file_digests(spark, str(tmp_path / "none")).count() == 0


def checked_pieces(rows, texts, plain):
    """Every id in one piece, sequences without gaps, padding only where it must be."""
    want = sorted((str(i), [*plain(t), 0]) for i, t in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for (doc_id, total), pieces in by_doc.items():
        copies = [x for i, x in want if i == str(doc_id) and len(x) == total]
        assert sorted(p["start"] for p in pieces) and sum(p["length"] for p in pieces) == total * len(copies)
        for p in pieces:
            assert any(zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], dtype="<u4")) == p["ids_crc32"] for x in copies)
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in want)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_packing(spark, plain):
    checked_pieces(packing.pack_documents(odd_documents(spark), vocabulary()).collect(), [d[:2] for d in odd_rows()], plain)
    texts = [words(i % 400, i) for i in range(300)]
    checked_pieces(packing.pack_documents(documents(spark, texts), vocabulary()).collect(), list(enumerate(texts)), plain)
    assert packing.pack_documents(empty_documents(spark), vocabulary()).count() == 0


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 8)
    w = packing.Windows(1024)
    for i in range(200):
        w.add(i, np.full(600, i, dtype="<u4"))
        assert w.held <= 8
    w.finish()
    assert sum(r[2] for r in w.rows) == 200 * 600 and w.held <= 1


def test_levels_follow_the_sum_of_squares():
    w = packing.Windows(16)
    sizes = np.random.default_rng(0).integers(1, 16, 300)
    for i, n in enumerate(sizes.tolist()):
        count = w.count.copy()

        def after(level, n=n, count=count):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + n < 16:
                c[level + n] += 1
            return int((c[1:16] ** 2).sum())

        options = [0, *(h for h in range(1, 17 - n) if count[h])]
        assert after(w.level_for(n)) == min(map(after, options))
        w.add(i, np.zeros(n, dtype="<u4"))
