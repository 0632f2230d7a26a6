"""Token ids of text columns with the tokenizers library, for the operators that write or pack ids.

A byte-level BPE vocabulary splits text before each space that a visible character follows, and never merges over that
place. So the ids of a text are those of its parts between such places, in order, and equal parts are encoded once per
batch and remembered over batches. A text with one of the vocabulary's added tokens is encoded whole, by the library.
tests/llm compare this with whole-text encoding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from basketlake.llm import shared

#: Distinct parts that a worker remembers; beyond, it keeps those met in two batches or more since the last time.
REMEMBERED = 300_000
#: Text bytes handled at a time.
BATCH_BYTES = 1 << 20
#: Bytes of new parts that are encoded as one string.
JOINED_BYTES = 1 << 12
#: First bytes of the UTF-8 forms of the non-ASCII white space characters.
SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)

#: Name under which workers keep encoders.
KEEPS = "tokens:"


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if KEEPS + path not in shared.held:
        shared.held[KEEPS + path] = Encoder(path)
    return shared.held[KEEPS + path]


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of `flat` with these starts and lengths, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


class Encoder:
    """Ids of text parts. What it remembers is held in flat arrays: hashes in order, bytes, ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        visible = np.arange(256) > 32
        visible[list(SPACE_LEADS)] = False
        self.visible = visible
        nothing = np.zeros(0, np.int64)
        self.hashes, self.slots = nothing.astype(np.uint64), nothing.astype(np.int32)
        self.words, self.word_start, self.word_length = nothing.astype(np.uint8), nothing, nothing
        self.ids, self.id_start, self.id_length, self.met = nothing.astype(np.uint32), nothing, nothing, nothing

    def known(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Slots of distinct parts, -1 for new ones. Equal hashes count only with equal bytes."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slot = np.where(self.hashes[at] == hashes, self.slots[at], -1)
        slot[self.word_length[slot] != lengths] = -1
        hit = np.flatnonzero(slot >= 0)
        same = gathered(data, starts[hit], lengths[hit]) == gathered(self.words, self.word_start[slot[hit]], lengths[hit])
        if not same.all():
            owner = np.repeat(hit, lengths[hit])
            slot[owner[~same]] = -1
        return slot

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Encodes new parts and gives their slots. Those that begin at a place where the vocabulary splits go as longer
        strings, whose ids are cut at the parts' ends."""
        second = data[np.minimum(starts + 1, len(data) - 1)]
        split = (lengths > 1) & (data[starts] == 32) & self.visible[second]
        joined, alone = np.flatnonzero(split), np.flatnonzero(~split)
        order = np.concatenate([joined, alone])
        found, counts = [], []
        if len(joined):
            ends = np.cumsum(lengths[joined])
            held = gathered(data, starts[joined], lengths[joined]).tobytes()
            breaks = np.append(ends[np.unique(np.searchsorted(ends, np.arange(JOINED_BYTES, int(ends[-1]), JOINED_BYTES)))], ends[-1])
            breaks = np.unique(np.concatenate([[0], breaks])).tolist()
            strings = [held[a:b].decode() for a, b in zip(breaks, breaks[1:], strict=False)]
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)])
            reached = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(reached, ends) + 1
            if len(ids) != cut[-1] or not np.array_equal(reached[cut - 1], ends):
                raise ValueError("the vocabulary merges over a space; it is not a byte-level BPE vocabulary")
            found.append(ids)
            counts.append(np.diff(cut, prepend=0))
        if len(alone):
            texts = [data[a : a + n].tobytes().decode() for a, n in zip(starts[alone].tolist(), lengths[alone].tolist(), strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            found.append(np.fromiter((i for x in lists for i in x), np.uint32, int(counts[-1].sum())))
        slots = np.empty(len(starts), dtype=np.int64)
        slots[order] = self.keep(gathered(data, starts[order], lengths[order]), lengths[order], hashes[order], np.concatenate(found), np.concatenate(counts))
        return slots

    def keep(self, words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Remembers parts, given one after another with their ids; returns their slots."""
        slots = np.arange(len(lengths)) + len(self.met)
        self.word_start = np.concatenate([self.word_start, len(self.words) + np.cumsum(lengths) - lengths])
        self.word_length = np.concatenate([self.word_length, lengths])
        self.words = np.concatenate([self.words, words])
        self.id_start = np.concatenate([self.id_start, len(self.ids) + np.cumsum(counts) - counts])
        self.id_length = np.concatenate([self.id_length, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(lengths), np.int64)])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slots = np.insert(self.hashes, at, hashes[order]), np.insert(self.slots, at, slots[order])
        return slots

    def forget_rare(self) -> None:
        """Keeps the parts met in two batches or more; the most often met ones if those are too many."""
        kept = np.flatnonzero(self.met >= 2)
        if len(kept) > REMEMBERED // 2:
            kept = kept[np.argsort(-self.met[kept], kind="stable")[: REMEMBERED // 2]]
        old = {name: getattr(self, name) for name in ("words", "word_start", "word_length", "ids", "id_start", "id_length", "hashes", "slots")}
        hash_of = np.empty(len(self.met), np.uint64)
        hash_of[old["slots"]] = old["hashes"]
        for name in (*old, "met"):
            setattr(self, name, getattr(self, name)[:0])
        lengths, counts = old["word_length"][kept], old["id_length"][kept]
        self.keep(gathered(old["words"], old["word_start"][kept], lengths), lengths, hash_of[kept], gathered(old["ids"], old["id_start"][kept], counts), counts)

    def with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with one of the vocabulary's added tokens, which the library cuts out of a text before anything else."""
        held, found = data.tobytes(), set()
        for token in self.added:
            at = held.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.add(row)
                at = held.find(token, at + 1)
        return np.array(sorted(found), dtype=np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a part, one after another, and the number of each row's ids."""
        whole = self.with_added(data, offsets)
        if not len(whole):
            return self.encode_parts(data, offsets)
        lengths = np.diff(offsets)
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in whole.tolist()]
        lists = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths[whole] = 0  # the others without these rows
        ids, counts = self.encode_parts(gathered(data, offsets[:-1], lengths), np.concatenate([[0], np.cumsum(lengths)]))
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for row, found in zip(whole.tolist(), lists, strict=True):
            pieces[row], counts[row] = found, len(found)
        return np.concatenate(pieces), counts

    def encode_parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, of rows without added tokens."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        cut = np.zeros(len(data), dtype=bool)
        cut[:-1] = (data[:-1] == 32) & self.visible[data[1:]]
        inner = offsets[1:-1]
        cut[inner[(inner > 0) & (inner < len(data))] - 1] = False  # a space that ends a row
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(cut)
        bounds = np.append(begins, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1]
        held = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)[: ends[-1]]
        starts, lengths = ends[:-1], np.diff(ends)
        if len(self.met) > REMEMBERED:
            self.forget_rare()
        hashes = shared.span_hash(shared.byte_sums(held), starts, ends[1:])
        slot = self.known(held, starts, lengths, hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self.learn(held, starts[new], lengths[new], hashes[new])
        self.met[slot] += 1
        slot = slot[coded.indices.to_numpy()]
        counts = self.id_length[slot]
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, offsets)]
        return gathered(self.ids, self.id_start[slot], counts), np.diff(upto)
