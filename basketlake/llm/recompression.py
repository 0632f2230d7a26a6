"""Repeated passages by recompression: equal stretches of words get equal names, so a shared name shows and proves a repeat.

A text is a sequence of word names. A level of recompression gives each run of equal names a name of its own (of the
name and its length), then splits the names in two kinds by a hash and joins each name of the first kind with one of the
second kind that follows it to a pair, which gets a name of its own. A name is a hash of what it stands for, so all
tasks name equal content alike without a dictionary passed around, and each level is three quarters as long as the last.
What a window of words holds is named alike wherever it stands, but for symbols near its ends, whose names depend on
words outside. Levels keep for each symbol the words on which its name depends, so the symbols that lie wholly within a
window (its interior) are known exactly.

The rounds on Spark, each over what the last one found shared:

1. Low levels. Each window of `window` words is known by an anchor: the least of its interior symbols of level LOW, with the
   words that these depend on (a window without one, made of long runs, by all its words). Anchors are counted by
   documents over the corpus. Windows whose anchor no other document has are in no other document.
2. High levels. On the rest, symbols of all higher levels that cover a window or more. A symbol that an earlier document
   has, too, is a proven repeat: its words go, and the windows inside need no further look, however long it is.
3. Windows that do not lie in one such symbol, by all their words: those that an earlier document has go, too.

Within a document windows are compared directly. Words that a window with an earlier equal one covers are removed.

Rows of equal text are one class: its first document is looked at, in the others all windows are repeats. What rounds
send is numbers by name: counts and least documents are combined before the shuffle, and joined back by name, where Spark
splits the rows of a hot one; what comes back to a document is in proportion to its own length. Texts are shuffled to meet
what the rounds have found about them, thrice: of rounds 2 and 3 only those that may share something, then all. 64-bit
names are backed by a second hash of the words below them where something is removed for them.

Words are runs of other characters than space and \\t to \\r, unchanged. A null or empty text has no words and an empty
result. Fewer words than a window: none is removed. Documents count in order of doc_id (null: last), then of the text's
hash; of equal rows one is first. Repeated rows give as many results. An empty table gives none. Further columns are
ignored. Memory of a task: some 60 bytes for each word of CHUNK_BYTES of text, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared

#: Levels whose symbols anchor windows: deeper ones depend on more words than a window of twenty has to spare.
LOW = 2
#: Levels without a new symbol after which no more are tried.
QUIET = 4
#: Fixed value: spreads the seeds by which levels split names.
SEED = 0xA0761D6478BD642F


class Level:
    """Symbols of one level over a part of texts: names, words [start, end), words [low, high) that names depend on."""

    def __init__(self, names: np.ndarray, first: np.ndarray):
        self.at = 0
        self.names, self.row = names, np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.start = np.arange(len(names))
        self.end, self.low, self.high = self.start + 1, self.start, self.start + 1
        self.before, self.after = first[:-1] - 1, first[1:] + 1  # beyond a row's words: no window reaches them
        self.fresh = np.zeros(len(names), dtype=bool)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The least word on which the symbol before each depends, the last word of the one behind each."""
        same = self.row[1:] == self.row[:-1]
        low, high = self.before[self.row], self.after[self.row]
        low[1:] = np.where(same, self.low[:-1], low[1:])
        high[:-1] = np.where(same, self.high[1:], high[:-1])
        return low, high

    def up(self) -> None:
        """Goes one level up: runs, then pairs. `fresh` marks the symbols that are new."""
        if not len(self.names):
            return
        self.at += 1
        low, high = self._neighbours()
        begins = np.ones(len(self.names), dtype=bool)
        begins[1:] = (self.names[1:] != self.names[:-1]) | (self.row[1:] != self.row[:-1])
        a = np.flatnonzero(begins)
        b = np.append(a[1:], len(begins)) - 1
        length = b - a + 1
        runs = length > 1
        names = self.names[a]
        names[runs] = shared.mixed(names[runs] * np.uint64(shared.CHAIN) + length[runs].astype(np.uint64))
        self.names, self.row, self.start, self.end = names, self.row[a], self.start[a], self.end[b]
        self.low, self.high = np.minimum(low[a], self.low[a]), np.maximum(high[b], self.high[b])

        low, high = self._neighbours()
        first_kind = (shared.mixed(self.names ^ np.uint64(self.at * SEED % (1 << 64))) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(self.names), dtype=bool)
        pair[:-1] = first_kind[:-1] & ~first_kind[1:] & (self.row[1:] == self.row[:-1])
        second = np.zeros(len(pair), dtype=bool)
        second[1:] = pair[:-1]
        self.low = np.where(first_kind | second, self.low, np.minimum(low, self.low))
        self.high = np.where(~first_kind | pair, self.high, np.maximum(high, self.high))
        left = np.flatnonzero(pair)
        self.names[left] = shared.mixed(self.names[left] * np.uint64(shared.MIX_A) ^ shared.mixed(self.names[left + 1] + np.uint64(self.at)))
        self.end[left], self.high[left] = self.end[left + 1], np.maximum(self.high[left], self.high[left + 1])
        self.fresh = pair | runs
        keep = ~second
        self.names, self.row, self.start, self.end, self.low, self.high, self.fresh = (x[keep] for x in (self.names, self.row, self.start, self.end, self.low, self.high, self.fresh))


class Texts:
    """Words of a part of texts, and hashes of any stretch of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int):
        if len(data):
            self.begin, self.stop, self.first = shared.word_spans(data, bounds)
            self.words = shared.span_hash(shared.byte_sums(data), self.begin, self.stop)
        else:
            self.begin = self.stop = np.zeros(0, np.int64)
            self.words, self.first = np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        up, _ = shared.powers(len(self.words) + 1)
        self.sums = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.cumsum(shared.mixed(self.words) * up[: len(self.words)], out=self.sums[1:])
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        at = np.arange(max(0, len(self.words) - window + 1))
        self.windows = at[at + window <= self.first[row[at] + 1]]  # where windows begin
        self.rows = row[self.windows]
        self.hashes = shared.ngrams(self.words, window)[self.windows]
        self.window = window

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return shared.span_hash(self.sums, start, end)

    def repeats(self) -> np.ndarray:
        """Which windows have an earlier equal one in their own row."""
        mine = self.hashes ^ shared.mixed(self.rows.astype(np.uint64))
        ordered = np.sort(mine)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        again = np.zeros(len(mine), dtype=bool)
        if len(twice):
            some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine)
            second = self.stretch(self.windows[some], self.windows[some] + self.window)
            order = np.lexsort((some, second, mine[some], self.rows[some]))
            same = lambda x: x[order[1:]] == x[order[:-1]]
            again[some[order[1:]]] = same(self.rows[some]) & same(mine[some]) & same(second)
        return again

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        level = Level(self.words.copy(), self.first)
        for _ in range(LOW):
            level.up()
        inner = np.flatnonzero((level.low > level.before[level.row]) & (level.high < level.after[level.row]))
        names, low, high = level.names[inner], level.low[inner], level.high[inner]
        keys = shared.mixed(names ^ self.stretch(low, high))
        a = np.searchsorted(low, self.windows, side="left")
        n = np.searchsorted(high, self.windows + self.window, side="right") - a
        out = shared.mixed(self.hashes ^ np.uint64(SEED))
        step, least = 1, keys
        while (n >= step).any():  # least[i] is the least of the `step` keys from i on
            some = np.flatnonzero((n >= step) & (n < 2 * step))
            out[some] = np.minimum(least[a[some]], least[a[some] + n[some] - step])
            least = np.minimum(least[: len(least) - step], least[step:]) if len(least) > step else least[:0]
            step *= 2
        return out


def distinct(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of each kind of (row, keys), in order of rows."""
    order = np.lexsort((np.arange(len(rows)), *keys[::-1], rows))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (rows, *keys)], axis=0)
    return order[new]


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of n rows, of the values of ascending row numbers."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists (null: empty)."""
    lengths = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def spans(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans merged where they meet; for rows, then starts, in order."""
    order = np.lexsort((start, rows))
    rows, start, end = rows[order], start[order], end[order]
    base = rows * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(base + end) if len(rows) else base
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], start[first], reach[last] - base[last] if len(rows) else reach


def _in_shared(texts: Texts, rows: np.ndarray, keys: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Which windows may have an equal one elsewhere: their anchor is among their row's shared ones, or they are repeated in their row."""
    anchors = texts.anchors()
    known = np.unique(shared.mixed(keys.view(np.uint64) ^ shared.mixed(rows.astype(np.uint64) + np.uint64(1))))
    mine = shared.mixed(anchors ^ shared.mixed(texts.rows.astype(np.uint64) + np.uint64(1)))
    at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
    return (known[at] == mine if len(known) else np.zeros(len(mine), dtype=bool)) | again


#: What the keys of a document are called on the other side of a join.
NAMES = {"doc_id": "__doc", shared.TEXT_HASH: "__hash"}


def same(text: DataFrame, keys: DataFrame) -> Column:
    return text["doc_id"].eqNullSafe(keys["__doc"]) & (text[shared.TEXT_HASH] == keys["__hash"])


class _Rounds:
    """The rounds over one table. Documents are known by `place`, their number in the order of documents."""

    def __init__(self, docs: DataFrame, window: int):
        self.spark, self.window = docs.sparkSession, window
        self.scratch = shared.Scratch(self.spark, "recompression")
        self.text, self.several = shared.hashed_documents(docs), None

    def one_row_each(self, found: DataFrame) -> None:
        """Where rows have doc_id and text in common, one of them stands for all; `several` counts them (None: there are none)."""
        key = ["doc_id", shared.TEXT_HASH]
        several = self.scratch.save(found.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1"), "several")
        if not several.isEmpty():
            self.several = shared.bounded(several.withColumnsRenamed(NAMES))
            one = self.text.join(self.several, same(self.text, self.several), "left_semi").dropDuplicates(key)
            self.text = self.text.join(self.several, same(self.text, self.several), "left_anti").unionByName(one)

    def anchored(self) -> DataFrame:
        """A row for each document: doc_id, text hash, two more marks of the text, n_words, its anchors, whether a window occurs twice."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, bounds in shared.slices(batch):
                    texts, n = Texts(data, bounds, window), len(bounds) - 1
                    anchors = texts.anchors()
                    moves = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (texts.rows[1:] != texts.rows[:-1]))[: len(anchors)])
                    first = moves[distinct(texts.rows[moves], anchors[moves])]
                    twice = np.bincount(texts.rows[texts.repeats()], minlength=n) > 0
                    columns = [part.column(0), *part.columns[2:], pa.array(np.diff(texts.first)), pa.array(twice), lists(texts.rows[first], anchors[first], n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", shared.TEXT_HASH, "k2", "k3", "n_words", "twice", "anchors"])

        rows = self.text.withColumns({"k2": F.hash("text"), "k3": F.octet_length("text")})
        found = shared.mapped(rows, run, f"doc_id long, {shared.TEXT_HASH} long, k2 int, k3 int, n_words long, twice boolean, anchors array<long>")
        return self.scratch.save(found.withColumn("rid", F.monotonically_increasing_id()), "anchored")

    def numbered(self, owners: DataFrame) -> DataFrame:
        """`place` of the first documents of all classes, by doc_id (null: last) and text hash."""
        order = [F.asc_nulls_last("doc_id"), F.asc_nulls_last(shared.TEXT_HASH), "k2", "k3"]
        dealt = owners.repartitionByRange(shared.shuffle_width(self.spark), *order).withColumn("part", F.spark_partition_id())
        rows = self.scratch.save(dealt.sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "dealt")
        firsts = rows.groupBy("part").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
        before = shared.before_parts(firsts, "part", "rows").join(firsts.select("part", "least"), "part")
        return self.scratch.save(rows.join(F.broadcast(before), "part").withColumn("place", F.col("id") - F.col("least") + F.col("rows_before")).drop("id", "part", "least", "rows_before"), "places")

    def with_texts(self, lists_: DataFrame, name: str) -> DataFrame:
        """Texts with the lists of their documents."""
        keys = self.scratch.save(lists_, name).withColumnsRenamed(NAMES)
        return self.text.join(keys, same(self.text, keys)).drop(*NAMES.values(), shared.TEXT_HASH)

    def earlier(self, occurrences: DataFrame, *keys: str) -> DataFrame:
        """The occurrences (place and further columns) of keys that an earlier document has, too."""
        least = occurrences.groupBy(*keys).agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most")
        least = shared.bounded(self.scratch.save(least.drop("most"), f"least-{keys[0]}"))
        return occurrences.join(least, list(keys)).where("place > least")

    def run(self) -> DataFrame:
        """For the first document of each class: doc_id, text hash; own, symbols, starts: what to remove of it."""
        found = self.anchored()
        self.one_row_each(found)
        key = [shared.TEXT_HASH, "k2", "k3"]
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
        owners = found.where(F.col("n_words") >= self.window).groupBy(*key).agg(first).select(*key, "first.doc_id", "first.rid")
        owners = shared.bounded(self.numbered(owners).select("rid", "place"))
        rows = found.join(owners, "rid").select("place", "doc_id", shared.TEXT_HASH, "n_words", "twice", "anchors")
        rows = self.scratch.save(rows, "looked-at")

        anchors = rows.select("place", F.explode("anchors").alias("anchor"))
        counts = anchors.groupBy("anchor").agg(F.count("*").alias("documents")).where("documents > 1")
        counts = shared.bounded(self.scratch.save(counts.select("anchor"), "shared-anchors"))
        keys = anchors.join(counts, "anchor").groupBy("place").agg(F.collect_list("anchor").alias("keys"))
        keyed = self.scratch.save(rows.drop("anchors").join(keys, "place", "left").where("twice OR keys IS NOT NULL"), "keyed")

        high = self.high_symbols(self.with_texts(keyed.select("place", "doc_id", shared.TEXT_HASH, "keys"), "keys"))
        symbols = self.earlier(high, "s1", "s2").groupBy("place").agg(F.collect_list((F.col("start") * (1 << 31) + F.col("end"))).alias("symbols"))
        symbols = self.scratch.save(symbols, "symbols")
        with_symbols = keyed.select("place", "doc_id", shared.TEXT_HASH, "keys").join(symbols, "place", "left")
        windows = self.scratch.save(self.open_windows(self.with_texts(with_symbols, "with-symbols")), "windows")
        each = windows.select("place", F.explode(F.arrays_zip("w1", "w2", "start")).alias("w")).select("place", "w.*")
        starts = self.earlier(each, "w1", "w2").groupBy("place").agg(F.collect_list("start").alias("starts"))
        out = rows.select("place", "doc_id", shared.TEXT_HASH).join(windows.select("place", "own"), "place", "left").join(symbols, "place", "left").join(starts, "place", "left")
        return out.drop("place")

    def high_symbols(self, texts: DataFrame) -> DataFrame:
        """place, s1, s2, start, end of the symbols of a window's length or more, within stretches whose windows may be shared."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, bounds in shared.slices(batch):
                    texts = Texts(data, bounds, window)
                    place = part.column(part.schema.get_field_index("place")).to_numpy()
                    may = _in_shared(texts, *flat(part.column(part.schema.get_field_index("keys"))), texts.repeats())
                    other = np.ones(len(texts.words) + 1, dtype=np.int64)
                    other[texts.windows[may]] = 0
                    others = np.concatenate([[0], np.cumsum(other)])  # windows that are in no other document, before each word
                    level, out, quiet = Level(texts.words.copy(), texts.first), [], 0
                    while quiet < QUIET:
                        level.up()
                        new = np.flatnonzero(level.fresh & (level.end - level.start >= window))
                        new = new[others[level.end[new] - window + 1] == others[level.start[new]]]
                        out.append((level.row[new], level.names[new], level.start[new], level.end[new]))
                        quiet = 0 if level.fresh.any() else quiet + 1
                    row, names, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
                    second = texts.stretch(start, end)
                    first = distinct(row, names, second)
                    origin = texts.first[row[first]]
                    columns = [place[row[first]], names[first].view(np.int64), second[first].view(np.int64), start[first] - origin, end[first] - origin]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "s1", "s2", "start", "end"])

        return self.scratch.save(shared.mapped(texts, run, "place long, s1 long, s2 long, start long, end long"), "high")

    def open_windows(self, texts: DataFrame) -> DataFrame:
        """place, own: spans that repeat within the document; w1, w2, start: windows whose fate other documents decide."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, bounds in shared.slices(batch):
                    texts, n = Texts(data, bounds, window), len(bounds) - 1
                    column = lambda name, p=part: p.column(p.schema.get_field_index(name))
                    again = texts.repeats()
                    may = _in_shared(texts, *flat(column("keys")), again) & ~again
                    row, packed = flat(column("symbols"))
                    start, end = (packed >> 31) + texts.first[row], (packed & ((1 << 31) - 1)) + texts.first[row]
                    reach = np.zeros(len(texts.words) + 1, dtype=np.int64)
                    np.maximum.at(reach, start, end)
                    reach = np.maximum.accumulate(reach)  # the furthest end of a symbol that has begun
                    may &= reach[texts.windows] < texts.windows + window
                    rows, at = texts.rows[may], texts.windows[may]
                    own = spans(texts.rows[again], texts.windows[again], texts.windows[again] + window)
                    origin = texts.first[own[0]]
                    listed = lists(np.repeat(own[0], 2), np.stack([own[1] - origin, own[2] - origin], axis=1).ravel(), n)
                    hashes = [lists(rows, x, n) for x in (texts.hashes[may], texts.stretch(at, at + window), at - texts.first[rows])]
                    yield pa.RecordBatch.from_arrays([column("place"), listed, *hashes], names=["place", "own", "w1", "w2", "start"])

        return shared.mapped(texts, run, "place long, own array<long>, w1 array<long>, w2 array<long>, start array<long>")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words kept, joined by spaces) of every row."""
    rounds = _Rounds(docs, window)
    looked = rounds.scratch.save(rounds.run().withColumn("looked", F.lit(True)), "looked")
    rounds.scratch.only("looked", "several")
    key, text, several = ["doc_id", shared.TEXT_HASH], rounds.text, rounds.several
    lists_ = ("own", "symbols", "starts")
    keys = looked.withColumnsRenamed(NAMES)
    joined = text.join(keys, same(text, keys), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in shared.slices(batch):
                yield _without_spans(part, data, bounds, window)

    schema = f"doc_id long, {shared.TEXT_HASH} long, n_words long, n_removed long, text string"
    kept = shared.mapped(joined.select(*key, "text", *lists_, F.coalesce("looked", F.lit(False)).alias("looked")), run, schema)
    if several is None:
        return kept.select("doc_id", "n_words", "n_removed", "text")
    each = kept.join(several, same(kept, several), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("rows").cast("int"), F.lit(1)))))
    gone = (F.col("copy") > 1) & (F.col("n_words") >= window)
    return each.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, "").otherwise(F.col("text")).alias("text"))


def _without_spans(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, window: int) -> pa.RecordBatch:
    """The result rows of a part of texts with their spans."""
    n = len(bounds) - 1
    column = lambda name: part.column(part.schema.get_field_index(name))
    begin, stop, first = shared.word_spans(data, bounds) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    words = np.diff(first)
    change = np.zeros(len(begin) + 1, dtype=np.int64)

    def gone(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, first[row] + start, 1)
        np.add.at(change, first[row] + end, -1)

    row, own = flat(column("own"))
    gone(row[::2], own[::2], own[1::2])
    row, packed = flat(column("symbols"))
    gone(row, packed >> 31, packed & ((1 << 31) - 1))
    row, start = flat(column("starts"))
    gone(row, start, start + window)
    copies = np.flatnonzero((words >= window) & ~column("looked").to_numpy(zero_copy_only=False).astype(bool))
    gone(copies, np.zeros(len(copies), np.int64), words[copies])
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    owner = np.searchsorted(first, keep, side="right") - 1
    left = np.bincount(owner, minlength=n)
    length = stop[keep] - begin[keep] + 1  # with a space behind it
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(begin[keep] - (ends - length), length) + np.arange(total)
    text = np.append(data, np.uint8(32))[np.minimum(source, len(data))] if total else np.zeros(0, np.uint8)
    if total:
        text[ends - 1] = 32
    last = np.concatenate([[0], np.cumsum(left)])
    edges = np.concatenate([[0], ends])[last]
    whole = text.tobytes()
    texts = [whole[a : max(a, b - 1)] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
    columns = [column("doc_id"), column(shared.TEXT_HASH), pa.array(words, pa.int64()), pa.array(words - left, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", shared.TEXT_HASH, "n_words", "n_removed", "text"])
