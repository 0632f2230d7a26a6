"""Benchmark passages in documents, paraphrases included: latent semantic retrieval, then subsequence and answer checks.

1. Codes. Each text's words (runs of letters and digits, lower-cased) become codes of the benchmark's vocabulary, others
   one code for "unknown". All later steps read these stored codes, a few bytes a word, and no text again.
2. TF-IDF. Document frequencies count passages (STRIDE words) of the whole corpus. Terms in more than COMMON of all
   passages and unknown words have no weight.
3. Randomised SVD. With A the passages by terms and a random matrix R, each task adds up its part of A'(AR); the sum, one
   row a term, gives the leading singular vectors of A by the Nystroem formula. No row of A is ever stored. Coordinates are
   divided by the singular values, else the few directions that tell languages apart outweigh all others.
4. Search. At every passage of every text, windows somewhat longer than each item are projected and held against the
   items of that length by cosine. Windows around which too few of the items' answer terms (step 5) occur at all are
   left out first; no item could pass its check there. An item of whose answer terms less than WEIGHTED have a weight (one
   that leaks so widely that its own terms are common, one of a tiny table, one of common words only) isn't searched by
   cosine: each window that has enough of its answer terms is a candidate, which leaves out none that could pass.
5. Checks. For a candidate, the longest common subsequence of the item and the words around the window, as a share of the
   item; and the rarer half of the item's terms (ANSWERS at least), as a share found there. A leak has LCS_SURE of the
   item in order and ANSWERS_SOME of those terms, or LCS_LEAST and ANSWERS_MOST.

The benchmark is handled in blocks of ITEMS items or ITEM_BYTES, which bounds what is broadcast and what the driver holds;
the corpus is coded once for CODED blocks.

Null and empty texts have no leaks, nor do items without a word. An item that occurs twice in a text gives its
better place. Repeated rows are each searched; a null doc_id stays null. Empty tables give no rows. Further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import labelled, shared

#: Items that are searched for at a time, about, and their bytes; blocks of items for which the corpus is coded at once.
ITEMS, ITEM_BYTES, CODED = 5000, 4 << 20, 8
STRIDE = 16
#: Bytes of codes that a task works on at a time; a few vectors of RANK numbers are held for each word.
CODE_BYTES = 1 << 17
RANK, EXTRA = 64, 8
#: Terms in more than this share of all passages have no weight.
COMMON = 0.01
COSINE = 0.3
ANSWERS, WEIGHTED = 5, 0.8
LCS_SURE, ANSWERS_SOME = 0.75, 0.4
LCS_LEAST, ANSWERS_MOST = 0.5, 0.5
#: Bytes of codes that a counting task adds up before it sends a row a term, about; no fewer tasks than COUNTING a core.
COUNTED_BYTES, COUNTING = 512 << 20, 4
HITS = f"doc_id long, {shared.TEXT_HASH} long, item_id long, start_word int, cosine double, lcs_share double, answer_share double"


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = shared.letter_words(data, offsets)
    return (shared.span_hash(shared.byte_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


class Vocabulary:
    """Codes 0.. of the items' words by an open table of their hashes; unknown words get the code `size`."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.size = len(self.hashes)
        bits = max(16, int(self.size).bit_length() + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.full(1 << bits, self.size, dtype=np.int32)
        at = (self.hashes & self.mask).astype(np.int64)
        self.table[at[::-1]] = np.arange(self.size, dtype=np.int32)[::-1]
        self.rest = np.flatnonzero(self.table[at] != np.arange(self.size))  # those whose place another one has
        self.known = np.append(self.hashes, np.uint64(0))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table[(hashes & self.mask).astype(np.int64)]
        missed = np.flatnonzero((self.known[found] != hashes) & (found < self.size))
        if len(missed):
            at = np.searchsorted(self.hashes, hashes[missed])
            at[at == self.size] = 0
            found[missed] = np.where(self.hashes[at] == hashes[missed], at, self.size)
        return found

    @property
    def kind(self) -> str:
        return "<u2" if self.size < 1 << 16 else "<u4"


@dataclass
class Index:
    """What the search broadcasts: a few numbers for each term and item of a block of items."""

    weight: np.ndarray  # idf by code, 0 for common and unknown words
    basis: np.ndarray  # weight times right singular vector, by code
    vectors: np.ndarray  # items' unit vectors in the latent space
    ids: list[int]
    codes: list[np.ndarray]
    answers: list[set[int]]
    usual: np.ndarray  # items that are searched by cosine; the vectors of others are 0
    idf: np.ndarray  # by code, of common words too
    first: np.ndarray  # by code, where in `asking` the other items begin that have it among their answer terms (n + 1)
    asking: np.ndarray


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the passages of each row, and the first passage of each row (n + 1)."""
    count = -(-np.diff(first) // STRIDE)
    upto = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(first[:-1], count) + (np.arange(upto[-1]) - np.repeat(upto[:-1], count)) * STRIDE, upto


def sums_by_passage(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows of values, which belong to words `at` (ascending), over the passages that start at `starts`."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype=values.dtype)
    if len(at):
        edge = np.searchsorted(at, starts)
        some = np.flatnonzero(np.diff(np.append(edge, len(at))) > 0)
        out[some] = np.add.reduceat(values, edge[some], axis=0)
    return out


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit (Hyyroe 2004)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = (1 << len(item)) - 1
    v = whole
    for c in words.tolist():
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return len(item) - v.bit_count()


def plain_cosine(item: np.ndarray, words: np.ndarray, idf: np.ndarray) -> float:
    """Of the TF-IDF vectors of the item and some words; unknown words have no weight."""
    a, b = (np.bincount(c, minlength=len(idf))[:-1] * idf[:-1] for c in (item, words))
    return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-30))


def answer_terms(item: np.ndarray, idf: np.ndarray) -> set[int]:
    """The rarer half of the item's terms, ANSWERS at least. Not fewer: where one paraphrase of an item is copied often,
    the words that it leaves out are the rarest of all."""
    terms = sorted(set(item.tolist()), key=lambda c: (-idf[c], c))
    return set(terms[: max(ANSWERS, -(-len(terms) // 2))])


def answers_needed(terms: set[int]) -> int:
    return max(1, math.ceil(ANSWERS_SOME * len(terms)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, cosine, lcs_share, answer_share of each item in each document that has it."""
    return _found(docs, benchmark).drop(shared.TEXT_HASH)


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "decontam")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null and item_id is not null")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = max(1, -(-size["n"] // ITEMS), -(-(size["bytes"] or 0) // ITEM_BYTES))
    items = scratch.save(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(wanted))), "items")
    blocks = sorted(r["block"] for r in items.select("block").distinct().collect())
    found = []
    for i in range(0, len(blocks), CODED):  # the corpus is read and hashed once for so many blocks
        held = items.where(F.col("block").isin(blocks[i : i + CODED])).collect()
        words, _ = hashes_of(*labelled.as_part([r["text"] for r in held]))
        vocabulary = Vocabulary(words)
        coded = _coded(docs, vocabulary, scratch, f"codes-{i}")
        for b in blocks[i : i + CODED]:
            found.append(_leaks_of_block(coded, vocabulary, [r for r in held if r["block"] == b], scratch, f"leaks-{b}"))
        scratch.drop(f"codes-{i}")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], HITS)


def _coded(docs: DataFrame, vocabulary: Vocabulary, scratch: shared.Scratch, name: str) -> DataFrame:
    """doc_id, hash of the text, codes of all words."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)  # 12 bytes or so a word of the items
    kind = vocabulary.kind

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in shared.slices(batch):
                found, upto = hashes_of(data, offsets)
                codes = given.value.codes(found).astype(kind)
                bounds = (upto * codes.itemsize).astype(np.int64)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), blob.cast(pa.binary())], names=["doc_id", shared.TEXT_HASH, "codes"])

    lowered = shared.hashed_documents(docs).withColumn("text", F.lower("text"))
    return scratch.save(shared.mapped(lowered, code, f"doc_id long, {shared.TEXT_HASH} long, codes binary"), name, compression="zstd")


def _leaks_of_block(coded: DataFrame, vocabulary: Vocabulary, items: list, scratch: shared.Scratch, name: str) -> DataFrame:
    spark = coded.sparkSession
    kind = vocabulary.kind
    words, first = hashes_of(*labelled.as_part([r["text"] for r in items]))
    words = vocabulary.codes(words)
    mine = np.unique(words)
    unknown = len(mine)
    local = np.full(vocabulary.size + 1, unknown, dtype=np.int32)  # the block's own codes of the vocabulary's words
    local[mine] = np.arange(unknown)
    own_code = spark.sparkContext.broadcast(local)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows, codes, first word of each row, first words of the passages, first passage of each row."""
        for batch in batches:
            for rows, data, offsets in shared.slices(batch, text="codes", most=CODE_BYTES):
                upto = offsets // np.dtype(kind).itemsize
                yield rows, own_code.value[data.view(kind)].astype(np.int64), upto, *passages(upto)

    # each task adds up before it sends a row a term, so few tasks with much input send least
    held = coded.agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0
    gathered = coded.select("codes").coalesce(max(COUNTING * spark.sparkContext.defaultParallelism, held // COUNTED_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(unknown + 1, dtype=np.int64), 0
        for _, codes, _, starts, _ in parts(batches):
            place = starts[:, None] + np.arange(STRIDE)
            inside = place < np.append(starts[1:], len(codes))[:, None]
            words = np.sort(np.where(inside, codes[np.minimum(place, len(codes) - 1)], unknown).astype(np.int32), axis=1)
            words[:, 1:][words[:, 1:] == words[:, :-1]] = unknown  # a term counts once a passage
            seen += np.bincount(words.ravel(), minlength=unknown + 1)
            total += len(starts)
        seen[unknown] = total  # passages, in the place of the unknown words
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], names=["code", "n"])

    counts = np.zeros(unknown + 1)
    for r in shared.mapped(gathered, count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # a row a term
        counts[r["code"]] = r["n"]
    total = max(1.0, counts[unknown])
    idf = np.log((total + 1) / (counts + 1))
    weight = np.where(counts > max(1.0, COMMON * total), 0.0, idf).astype(np.float32)
    weight[unknown] = 0

    # A'(AR) over all passages of the corpus
    wide = max(1, min(RANK + EXTRA, unknown))
    random = np.random.default_rng(11).normal(size=(unknown + 1, wide)).astype(np.float32)
    given = spark.sparkContext.broadcast((weight, random * weight[:, None]))
    columns = [f"z{i}" for i in range(wide)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, random = given.value
        out = np.zeros((unknown + 1, wide), dtype=np.float64)
        for _, codes, _, starts, _ in parts(batches):
            at = np.flatnonzero(weight[codes] > 0)
            c = codes[at]
            norm = np.maximum(sums_by_passage(weight[c] ** 2, at, starts), 1e-6)
            rows = sums_by_passage(random[c], at, starts) / norm[:, None]
            passage = np.searchsorted(starts, at, side="right") - 1
            order = np.argsort(c, kind="stable")
            edge = np.flatnonzero(np.diff(c[order], prepend=-1))
            if len(edge):
                out[c[order][edge]] += np.add.reduceat(rows[passage[order]], edge, axis=0)
        out *= weight[:, None]
        met = np.flatnonzero(np.abs(out).sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(out[met, i]) for i in range(wide))], names=["code", *columns])

    product = np.zeros((unknown + 1, wide))
    summed = shared.mapped(gathered, sketch, ", ".join(["code long", *(f"{c} double" for c in columns)])).groupBy("code").agg(*(F.sum(c).alias(c) for c in columns))
    for r in summed.collect():  # a row a term
        product[r["code"]] = r[1:]
    basis = singular_vectors(product, random.astype(np.float64))[:, :RANK].astype(np.float32) * weight[:, None]

    codes = [local[words[a:b]].astype(np.int64) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
    vectors = np.array([basis[c].sum(axis=0) for c in codes]).reshape(len(codes), -1)
    kept = [i for i, c in enumerate(codes) if len(c)]
    rarest = [answer_terms(codes[i], idf) for i in kept]
    vectors = vectors[kept]
    norms = np.linalg.norm(vectors, axis=1)
    usual = np.array([(weight[list(terms)] > 0).mean() >= WEIGHTED for terms in rarest], dtype=bool) & (norms > 0)
    vectors = np.where(usual, 1 / np.maximum(norms, 1e-30), 0)[:, None] * vectors
    asking = sorted((c, j) for j, terms in enumerate(rarest) if not usual[j] for c in terms)
    upto = np.searchsorted(np.array([c for c, _ in asking], dtype=np.int64), np.arange(unknown + 2))
    index = spark.sparkContext.broadcast(Index(weight, basis, vectors, [items[i]["item_id"] for i in kept], [codes[i] for i in kept], rarest, usual, idf, upto, np.array([j for _, j in asking], dtype=np.int64)))

    def asked_for(x: Index, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items that aren't searched by cosine, and the places of their answer terms, ascending."""
        n = x.first[codes + 1] - x.first[codes]
        at = np.flatnonzero(n)
        n = n[at]
        if not len(at):
            return
        item = x.asking[np.repeat(x.first[codes[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        item, at = item[order], np.repeat(at, n)[order]
        edge = np.flatnonzero(np.diff(item, prepend=-1))
        yield from zip(item[edge].tolist(), np.split(at, edge[1:]), strict=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        reach = np.array([max(2, len(c) // STRIDE + 1) for c in x.codes])  # passages of an item's windows
        asked, least = {}, {}  # by reach: the answer terms of its items, and how many an item needs at least
        for terms, usual, k in zip(x.answers, x.usual.tolist(), reach.tolist(), strict=True):
            if usual:
                asked.setdefault(k, np.zeros(unknown + 1, dtype=np.int64))[list(terms)] = 1
                least[k] = min(least.get(k, len(terms)), answers_needed(terms))
        for rows, codes, upto, starts, row_first in parts(batches):
            count = len(starts)
            row = np.repeat(np.arange(len(rows)), np.diff(row_first))
            begin, stop = row_first[row], row_first[row + 1]
            place = np.arange(count)
            kept: dict[int, np.ndarray] = {}
            need = np.zeros(count + 1, dtype=np.int64)
            for k in sorted(asked):
                met = np.concatenate([[0], np.cumsum(asked[k][codes])])[np.append(starts, len(codes))]
                around = met[np.minimum(place + k + 1, stop)] - met[np.maximum(place - 1, begin)]
                kept[k] = np.flatnonzero(around >= least[k])
                np.add.at(need, kept[k], 1)
                np.add.at(need, np.minimum(kept[k] + k, stop[kept[k]]), -1)
            wanted = np.repeat(np.cumsum(need)[:count] > 0, np.diff(np.append(starts, len(codes))))
            at = np.flatnonzero(wanted & (x.weight[codes] > 0))
            best: dict[tuple[int, int], tuple] = {}
            doc_ids, text_hashes = rows.column(0).to_pylist(), rows.column(1).to_pylist()

            def check(w: int, item: int, cosine: float | None) -> None:
                r, k = int(row[w]), int(reach[item])
                a, b = max(int(upto[r]), int(starts[w]) - STRIDE), min(int(upto[r + 1]), int(starts[w]) + (k + 1) * STRIDE)
                near = codes[a:b]
                terms = x.answers[item]
                answers = len(terms.intersection(near.tolist()))
                if answers < answers_needed(terms):
                    return
                lcs = common_subsequence(x.codes[item], near) / len(x.codes[item])
                if lcs >= LCS_SURE or lcs >= LCS_LEAST and answers >= ANSWERS_MOST * len(terms):
                    if cosine is None:
                        cosine = plain_cosine(x.codes[item], codes[starts[w] : min(int(upto[r + 1]), int(starts[w]) + k * STRIDE)], x.idf)
                    now = (lcs, answers / len(terms), cosine, int(starts[w]) - int(upto[r]))
                    best[r, item] = max(best.get((r, item), now), now)

            if len(at):
                latent = np.concatenate([np.zeros((1, x.basis.shape[1])), np.cumsum(sums_by_passage(x.basis[codes[at]], at, starts), axis=0, dtype=np.float64)])
            for k, all_ in kept.items() if len(at) else ():
                items = np.flatnonzero((reach == k) & x.usual)
                vectors = x.vectors[items].T
                for windows in np.array_split(all_, max(1, len(all_) // 20_000)):
                    summed = (latent[np.minimum(windows + k, stop[windows])] - latent[windows]).astype(np.float32)
                    cosine = (summed / np.maximum(np.linalg.norm(summed, axis=1, keepdims=True), 1e-9)) @ vectors
                    for i, j in np.argwhere(cosine >= COSINE).tolist():
                        check(int(windows[i]), int(items[j]), float(cosine[i, j]))
            for item, places in asked_for(x, codes):
                k = int(reach[item])
                windows = np.unique((np.searchsorted(starts, places, side="right") - 1)[:, None] + np.arange(-k - 1, 2))
                windows = windows[(windows >= 0) & (windows < count)]
                a, b = np.maximum(upto[row[windows]], starts[windows] - STRIDE), np.minimum(upto[row[windows] + 1], starts[windows] + (k + 1) * STRIDE)
                enough = np.searchsorted(places, b) - np.searchsorted(places, a) >= answers_needed(x.answers[item])
                for w in windows[enough].tolist():
                    check(w, item, None)
            if best:
                out = [(doc_ids[r], text_hashes[r], x.ids[item], start, cosine, lcs, answers) for (r, item), (lcs, answers, cosine, start) in best.items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[h.split()[0] for h in HITS.split(", ")])

    return scratch.save(shared.mapped(coded, search, HITS), name) if kept else spark.createDataFrame([], HITS)


def singular_vectors(product: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Right singular vectors of A over their singular values, leading first, from A'(A random) (Halko, Martinsson and Tropp 2011, section 5.5)."""
    shift = 1e-9 * max(float(np.linalg.norm(product)), 1e-12)
    product = product + shift * random
    core = random.T @ product
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    half = product @ (turn[:, good] / np.sqrt(values[good]))
    vectors, sigma, _ = np.linalg.svd(half, full_matrices=False)
    return vectors / np.maximum(sigma, 1e-12)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text has no item; rows that repeat a doc_id, or have none, are each judged by their own text."""
    scratch = shared.Scratch(docs.sparkSession, "leaks")
    return shared.without(docs, scratch.save(_found(docs, benchmark).select("doc_id", shared.TEXT_HASH), "found"))
