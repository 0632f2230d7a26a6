"""Similarity join of documents on sets of word n-grams: prefix filter, then a prefix tree of each family.

Documents link when `percent` * union <= 100 * intersection. The join is exact, in these steps:

1. Sets. Each text's distinct n-grams as hashes. Rows with equal sets become one class before anything is paired.
2. Candidates. A linked set misses at most m = n - ceil(percent * n / 100) of a set's n-grams, so that many may be missing
   from any part of it, too. The part is the n-grams whose hash is below a cutoff that depends on the size class alone
   (linked sets are in the same or neighbouring size classes; each set takes part in both pairings). A set goes on
   only if all but m of its part occur in another set. Ordered by count over the corpus, rarest first, the first m + 1
   n-grams of two linked sets' parts have one in common: sets are tied to the smallest set with the same such n-gram.
   What many documents share comes last in this order and ties nothing unless a text is mostly made of it.
3. Families. Connected components of these ties, found by joins (`shared.components`). Whole sets of families are stored.
4. Prefix tree. A family's whole sets, ordered by count, go into a compressed tree. Sets walk it, several at once, adding
   up overlaps of shared stretches once for all sets below; each leaves out subtrees whose remaining lengths can't reach
   the threshold or whose sets are all in its own component already. One task takes sets of UNIT n-grams at most, so larger families are
   walked in turns: each block by itself; then, of the sets that have enough n-grams in common with their family as a whole
   to link with a set of the least size there, one of each component so far (that with the smallest share of n-grams
   of its own, which is next to most others), while that joins components; then, for
   the links that representatives can't show, pairs of blocks in which sets of different components still share a
   candidate n-gram. Sets of one large component are never held against each other again.
5. Components of the links, with the smallest doc_id over all rows of their classes.

Only n-grams that occur in two sets are joined back, so ordinary documents leave after one count. A family of copies that
link costs about one walk a set; distinct sets of one family that share candidates but do not link cost work that grows
with the square of their number, spread over block pairs.

A null or empty text has an empty set and links with nothing, with its own doc_id as component. A text of fewer words
than n is one n-gram, its whole sequence. Repeated rows are one class. A null doc_id takes the smallest doc_id of its
component; null if there is none. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm import shared

#: N-grams of whole sets that one task takes at most, about; a set counts SET more for what it costs besides.
UNIT, SET = 500_000, 800
#: Bytes of the table that marks which n-grams the sets have that walk a tree together; a larger set walks alone.
CELLS = 8 << 20
#: Share of a large set's n-grams that is counted, and n-grams that are counted of any set on average at least.
PART, LEAST = 0.25, 60
TOP = 1 << 63


def distinct_ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's set of n-gram hashes (63 bits), sorted."""
    hashes, first = shared.words(data, offsets)
    grams = shared.ngrams(hashes, n) >> np.uint64(1)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            found = np.sort(grams[a : b - n + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            yield shared.ngrams(hashes[a:b], b - a) >> np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def digest(found: np.ndarray) -> tuple[int, int]:
    """Two 63-bit digests of a set."""
    one, two = shared.mixed(found), shared.mixed(found ^ np.uint64(shared.CHAIN))
    return int(one.sum(dtype=np.uint64)) >> 1, int(np.bitwise_xor.reduce(two, initial=np.uint64(len(found)))) >> 1


def size_classes(percent: int) -> np.ndarray:
    """Least sizes of the classes: no set of one links with a set two classes above."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, dtype=np.int64)


def cutoffs(bounds: np.ndarray) -> np.ndarray:
    return np.array([TOP - 1 if LEAST >= b or PART >= 1 else int(TOP * max(PART, LEAST / b)) for b in bounds.tolist()], dtype=np.uint64)


class Tree:
    """Compressed prefix tree of sets of ranks. A node is a stretch of one set: all sets below it begin alike."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = sets
        self.source, self.begin, self.end = [0], [0], [0]
        self.children, self.ends_here = [[]], [[]]
        stack, last = [0], np.zeros(0, np.uint32)
        for i in order:
            now = sets[i]
            k = min(len(now), len(last))
            differ = np.flatnonzero(now[:k] != last[:k])
            common = int(differ[0]) if len(differ) else k
            while self.end[stack[-1]] > common:
                top = stack.pop()
                if self.begin[top] < common:  # split the stretch
                    upper = self.node(self.source[top], self.begin[top], common)
                    parent = self.children[stack[-1]]
                    parent[parent.index(top)] = upper
                    self.begin[top] = common
                    self.children[upper].append(top)
                    stack.append(upper)
                    break
            if len(now) > self.end[stack[-1]]:
                leaf = self.node(i, self.end[stack[-1]], len(now))
                self.children[stack[-1]].append(leaf)
                stack.append(leaf)
            self.ends_here[stack[-1]].append(i)
            last = now
        self.least, self.most = [0] * len(self.source), [0] * len(self.source)
        self.alike = [-1] * len(self.source)
        self.order = self.upwards(0)
        for v in self.order:
            sizes = [len(sets[i]) for i in self.ends_here[v]]
            self.least[v] = min(sizes + [self.least[c] for c in self.children[v]], default=0)
            self.most[v] = max(sizes + [self.most[c] for c in self.children[v]], default=0)

    def node(self, source: int, begin: int, end: int) -> int:
        self.source.append(source)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        self.ends_here.append([])
        return len(self.source) - 1

    def join(self, comp: np.ndarray) -> None:
        """Notes which nodes have sets of one component alone; they stay so."""
        for v in self.order:
            kinds = [*self.ends_here[v], *(self.alike[c] for c in self.children[v])]
            if self.alike[v] < 0 and min(kinds, default=-1) >= 0 and len({int(comp[k]) for k in kinds}) == 1:
                self.alike[v] = kinds[0]

    def upwards(self, top: int) -> list[int]:
        out, stack = [], [top]
        while stack:
            v = stack.pop()
            out.append(v)
            stack += self.children[v]
        return out[::-1]


def _walk(tree: Tree, asks: np.ndarray, comp: np.ndarray, percent: int, width: int) -> None:
    """Walks the tree with several sets at once: each node goes on with those that can still reach the threshold below it,
    and the overlaps that they have so far. Enters the links in `comp`."""
    sizes = np.array([len(tree.sets[x]) for x in asks], dtype=np.int64)
    ends, place = np.cumsum(sizes), np.repeat(np.arange(len(asks)), sizes)
    ranks = np.concatenate([tree.sets[x] for x in asks]).astype(np.int64)
    mark = np.zeros((width, len(asks)), dtype=np.uint8)
    mark[ranks, place] = 1
    keys = place * width + ranks  # ascending: what a set has beyond a rank is counted by one search
    stack = [(0, np.arange(len(asks)), np.zeros(len(asks), dtype=np.int64))]
    while stack:
        v, who, overlap = stack.pop()
        if tree.alike[v] >= 0:
            other = comp[asks[who]] != comp[tree.alike[v]]
            who, overlap = who[other], overlap[other]
        if not len(who):
            continue
        stretch = tree.sets[tree.source[v]][tree.begin[v] : tree.end[v]]
        n = left = sizes[who]
        if len(stretch):
            if 4 * len(who) > len(asks):
                overlap = overlap + np.add.reduce(mark[stretch], axis=0, dtype=np.int32)[who]
            else:
                overlap = overlap + np.add.reduce(mark[np.ix_(stretch, who)], axis=0, dtype=np.int32)
            left = ends[who] - np.searchsorted(keys, who * width + int(stretch[-1]), side="right")
        depth = tree.end[v]
        best = np.minimum(np.maximum(depth + left, tree.least[v]), tree.most[v])
        reach = (100 + percent) * (overlap + np.minimum(left, best - depth)) >= percent * (n + best)
        who, overlap, n = who[reach], overlap[reach], n[reach]
        near = asks[who[(100 + percent) * overlap >= percent * (n + depth)]]
        for y in tree.ends_here[v] if len(near) else ():
            met = np.unique(comp[np.append(near, y)])
            if len(met) > 1:
                comp[np.isin(comp, met)] = met[0]
        if len(who):
            stack += [(c, who, overlap) for c in tree.children[v]]


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, walks: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component; sets are sorted arrays of ranks without repeats. `known` numbers the
    components that are known already. Only sets that `walks` names (else all) walk; links between others may be missed."""
    tree, comp = Tree(sets), np.arange(len(sets))
    if known is not None:
        _, at, which = np.unique(known, return_index=True, return_inverse=True)
        comp = at[which]
    width = int(max((int(s[-1]) for s in sets if len(s)), default=0)) + 1
    order = np.arange(len(sets)) if walks is None else np.flatnonzero(walks)
    at, step = 0, 1
    while at < len(order):
        tree.join(comp)
        _walk(tree, order[at : at + step], comp, percent, width)
        at, step = at + step, min(4 * step, max(1, CELLS // width))
    return comp


def _links_of_unit(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links u, v within one family or pair of blocks, as stars."""
        table = table.combine_chunks()
        lists = table.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        rid = table.column("rid").to_numpy()
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), dtype=np.uint32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
        ranks = rank[code]
        root = linked([np.sort(ranks[bounds[i] : bounds[i + 1]]) for i in range(len(rid))], percent, table.column("comp").to_numpy(), table.column("walks").to_numpy())
        some = root != np.arange(len(root))
        shared.give_back()
        return pa.table({"u": pa.array(rid[some], pa.int64()), "v": pa.array(rid[root[some]], pa.int64())})

    return run


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, root (a number of the component, null for empty sets), component_id."""
    spark = docs.sparkSession
    scratch = shared.Scratch(spark, "jaccard")
    bounds = size_classes(percent)
    cuts = cutoffs(bounds)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in shared.slices(batch):
                out = []
                for found in distinct_ngrams(data, offsets, n):
                    size = max(0, int(np.searchsorted(bounds, len(found), side="right")) - 1)
                    part = found[found < cuts[max(0, size - 1)]]
                    out.append((len(found), size, *digest(found), int((found < cuts[size]).sum()), part.astype(np.int64)))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), *(pa.array(c, t) for c, t in zip(columns[:5], kinds, strict=True)), listed(columns[5])],
                    names=["doc_id", shared.TEXT_HASH, "n", "size_class", "k1", "k2", "n_low", "part"],
                )

    text = shared.hashed_documents(docs)
    found = shared.mapped(text, sets, f"doc_id long, {shared.TEXT_HASH} long, n long, size_class int, k1 long, k2 long, n_low int, part array<long>")
    found = scratch.save(found.withColumn("rid", F.monotonically_increasing_id()), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", shared.TEXT_HASH))
    classes = found.where("n > 0").groupBy("k1", "k2", "n", "size_class").agg(F.min("rid").alias("rid"), first.alias("first"))
    classes = scratch.save(classes.select("k1", "k2", "n", "size_class", "rid", F.col("first.doc_id").alias("first"), F.col(f"first.{shared.TEXT_HASH}").alias("first_hash")), "classes")
    later = scratch.save(found.where("n > 0").select("rid").join(classes.select("rid"), "rid", "left_anti"), "later")
    single = found.where("n > 0").join(shared.bounded(later), "rid", "left_anti")

    # n-grams of the parts that occur in two sets, by how many sets
    each = single.select("rid", F.explode("part").alias("gram"))
    counts = scratch.save(each.groupBy("gram").agg(F.count("*").cast("int").alias("sets")).where("sets > 1"), "counts")
    common = each.join(counts, "gram").groupBy("rid").agg(F.collect_list(F.struct("sets", "gram")).alias("common"))
    narrow = single.select("rid", "n", "size_class", "n_low", F.size("part").alias("n_high"))
    known = common.join(narrow, "rid").withColumn("missing", F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)))
    cut_of = F.array(*(F.lit(int(c)) for c in cuts[:-1]))

    def prefix(pairing, held) -> DataFrame:
        """The first grams of each set in one pairing, for sets of which enough occurs elsewhere."""
        below = F.element_at(cut_of, F.greatest(F.col("pairing"), F.lit(0)) + 1)
        mine = known.withColumn("pairing", pairing).where("pairing >= 0").withColumn("mine", F.array_sort(F.filter("common", lambda g: g["gram"] < below)))
        mine = mine.withColumn("take", F.col("missing") + 1 - (F.col(held) - F.size("mine"))).where("take > 0 and size(mine) > 0")
        firsts = F.slice("mine", F.lit(1), F.col("take").cast("int"))
        return mine.select("rid", "pairing", F.transform(firsts, lambda g: g["gram"]).alias("grams"))

    known = scratch.save(known, "known")
    firsts = scratch.save(prefix(F.col("size_class"), "n_low").unionByName(prefix(F.col("size_class") - 1, "n_high")), "firsts")
    scratch.drop("known", "counts", "later")
    each = firsts.select("rid", "pairing", F.explode("grams").alias("gram"))
    hubs = each.groupBy("pairing", "gram").agg(F.min("rid").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    most = firsts.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    ties = each.join(scratch.save(hubs, "hubs", most), ["pairing", "gram"]).select(F.col("rid").alias("u"), F.col("hub").alias("v"))
    family = scratch.save(shared.components(ties, scratch, "ties", most), "family", most).select(F.col("node").alias("rid"), F.col("root").alias("family"))
    joined = _links_in_families(text, family, classes, firsts, most, n, percent, scratch)

    # the smallest doc_id of each component, for all rows of its classes
    rooted = classes.join(joined, classes["rid"] == joined["node"], "left").select("k1", "k2", "first", F.coalesce("root", "rid").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.save(rooted.join(names, "root").select("k1", "k2", "root", "component_id"), "named")
    out = found.select("doc_id", shared.TEXT_HASH, "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return scratch.result(out.select("doc_id", shared.TEXT_HASH, F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id")))


def listed(rows: list[np.ndarray] | tuple[np.ndarray, ...]) -> pa.ListArray:
    """Arrays of integers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate(rows), pa.int64()))


def _links_in_families(text: DataFrame, family: DataFrame, classes: DataFrame, firsts: DataFrame, most: int, n: int, percent: int, scratch: shared.Scratch) -> DataFrame:
    """node, root: components of the links between the sets of families (rid, family). `firsts` has `most` n-grams in all."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in shared.slices(batch):
                rows = [(*digest(g), g.astype(np.int64)) for g in distinct_ngrams(data, offsets, n)]
                k1, k2, found = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), listed(found)], names=["k1", "k2", "grams"])

    n_members = family.count()
    members = scratch.save(family.join(classes, "rid").select("rid", "family", "k1", "k2", "size_class", (F.col("n") + SET).alias("cost"), F.col("first").alias("doc_id"), F.col("first_hash").alias(shared.TEXT_HASH)), "members", n_members)
    owners = shared.without(text, members.select("doc_id", shared.TEXT_HASH), "left_semi")
    again = shared.mapped(owners, grams, "k1 long, k2 long, grams array<long>")
    again = again.join(shared.bounded(members.select("k1", "k2", "rid")), ["k1", "k2"])
    whole = scratch.save(again.groupBy("rid").agg(F.any_value("grams").alias("grams")), "whole")  # rows with the owner's id and text, once
    members = members.select("rid", "family", "size_class", "cost")

    def walked(units: DataFrame, name: str) -> DataFrame:
        """Links within units: rid, comp (component so far), walks, and family, low, high, which name the unit. Sets of a
        unit's low block walk; the tree has both blocks."""
        units = scratch.save(units, f"{name}-units")
        links = whole.join(shared.bounded(units), "rid").groupBy("family", "low", "high").applyInArrow(_links_of_unit(percent), "u long, v long")
        return scratch.save(links, f"{name}-links")

    def with_components(sets: DataFrame, links: DataFrame, name: str) -> DataFrame:
        found = scratch.save(shared.components(links, scratch, name, links.count()), f"{name}-components", n_members)
        return sets.drop("comp").join(shared.bounded(found), sets["rid"] == found["node"], "left").withColumn("comp", F.coalesce("root", "rid")).drop("node", "root")

    def in_blocks(sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Units of one block each, and the families that have several."""
        large = scratch.save(sets.groupBy("family").agg(F.sum("cost").alias("total")).where(F.col("total") > UNIT), f"{name}-large", n_members)
        block = F.coalesce(F.pmod(F.xxhash64("rid"), F.ceil(F.col("total") / F.lit(UNIT))), F.lit(0)).cast("long")
        dealt = sets.join(shared.bounded(large), "family", "left").withColumn("low", block)
        return dealt.select("rid", "comp", "family", "low", F.col("low").alias("high"), F.lit(True).alias("walks")), large.select("family")

    units, large = in_blocks(members.withColumn("comp", F.col("rid")), "first")
    links = walked(units, "first")
    if large.isEmpty():
        return scratch.save(shared.components(links, scratch, "closing", links.count()), "components", n_members)

    # one set of each component, while that joins components
    some = scratch.save(members.join(shared.bounded(large), "family", "left_semi"), "several", n_members)
    some = scratch.save(_able(some, whole, percent), "able", n_members)
    at, before = 0, some.count()
    while True:
        at += 1
        state = scratch.save(with_components(some, links, f"turn-{at}"), f"state-{at}", n_members)
        best = state.groupBy("comp").agg(F.min(F.struct("alone", "rid")).alias("best"))  # the set most like its family
        best = scratch.save(best.select(F.col("best.rid").alias("rid")), f"best-{at}", n_members)
        heads = state.join(shared.bounded(best), "rid", "left_semi")
        left = best.count()
        if left > 0.7 * before:
            break
        units, several = in_blocks(heads, f"heads-{at}")
        more = walked(units, f"heads-{at}")
        links = scratch.save(links.unionByName(more), f"links-{at}", links.count() + more.count())
        if several.isEmpty():
            state = scratch.save(with_components(some, links, f"last-{at}"), f"last-state-{at}", n_members)
            break
        before = left

    # sets of different components that share a candidate n-gram, in pairs of blocks
    placed = scratch.save(firsts.join(shared.bounded(state.select("rid", "comp"), state), "rid"), "placed", most)  # two rows a set at most
    placed = placed.select("rid", "comp", "pairing", F.explode("grams").alias("gram"))
    mixed = placed.groupBy("pairing", "gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("pairing", "gram")
    mixed = scratch.save(mixed, "mixed", most)
    open_ = scratch.save(placed.join(mixed, ["pairing", "gram"]).select("rid").distinct(), "open", n_members)
    state = state.join(shared.bounded(open_), "rid", "left_semi")
    half = F.lit(UNIT // 2)
    major = scratch.save(state.groupBy("family", "comp").agg(F.sum("cost").alias("own")).where(F.col("own") > half), "major", n_members)
    state = state.join(shared.bounded(major), ["family", "comp"], "left").withColumn("kind", F.when(F.col("own").isNotNull(), F.col("comp")).otherwise(F.lit(-1)))
    pools = scratch.save(state.groupBy("family", "kind").agg(F.sum("cost").alias("total")), "pools", n_members)
    state = state.join(shared.bounded(pools), ["family", "kind"]).withColumn("block", F.xxhash64("kind", F.pmod(F.xxhash64("rid"), F.ceil(F.col("total") / half))))
    state = scratch.save(state.select("rid", "comp", "family", "kind", "block"), "blocks", n_members)
    blocks = state.select("family", "kind", "block").distinct()
    other = blocks.select("family", F.col("kind").alias("kind_2"), F.col("block").alias("block_2"))
    pairs = blocks.join(other, "family").where("block <= block_2 and (kind <> kind_2 or kind = -1)")  # a row for each unit
    pairs = scratch.save(pairs.select("family", F.col("block").alias("low"), F.col("block_2").alias("high")), "pairs", blocks.count() ** 2)
    sides = pairs.withColumn("block", F.col("low")).unionByName(pairs.withColumn("block", F.col("high"))).distinct()
    units = state.join(sides, ["family", "block"]).select("rid", "comp", "family", "low", "high", (F.col("block") == F.col("low")).alias("walks"))
    links = links.unionByName(walked(units, "pairs"))
    return scratch.save(shared.components(links, scratch, "closing", links.count()), "components", n_members)


def _able(sets: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The sets of families (rid, family, size_class, cost) of whose n-grams so many are in other sets of the family, too,
    that they reach the threshold with the smallest set there that their size lets them link with; the others can't link.
    `alone` is the share of n-grams that no other set of the family has.
    Only n-grams that one set alone has are counted back, by their owner, so nothing is joined."""
    each = whole.join(shared.bounded(sets.select("rid", "family"), sets), "rid").select("family", "rid", F.explode("grams").alias("gram"))
    own = each.groupBy("family", "gram").agg(F.min("rid").alias("rid"), F.count("*").alias("sets")).where("sets = 1")
    own = own.groupBy("rid").agg(F.count("*").alias("own"))
    n = F.col("cost") - SET
    classes = F.explode(F.array("size_class", F.col("size_class") + 1)).alias("size_class")  # a set's own, and the one above
    least = sets.select("family", n.alias("n"), classes).groupBy("family", "size_class").agg(F.min("n").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(n * percent / F.lit(100)))
    sets = sets.join(least, ["family", "size_class"]).join(own, "rid", "left")
    able = (n - F.coalesce("own", F.lit(0))) * (100 + percent) >= (n + partner) * percent
    return sets.where(able).select("rid", "family", "cost", (F.coalesce("own", F.lit(0)) / n).alias("alone"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _grouped(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null: last), of its texts that with the smallest hash; of
    rows equal in both the first by a hash of the other columns. Rows without words all stay."""
    scratch = shared.Scratch(docs.sparkSession, "near-copies")
    rows = _grouped(docs, n, percent).where("root is not null").withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", shared.TEXT_HASH))
    heads = rows.groupBy("root").agg(F.min("key").alias("head"), F.count("*").alias("rows")).where("rows > 1")
    heads = scratch.save(heads.select("root", F.col("head.doc_id").alias("head_id"), F.col(f"head.{shared.TEXT_HASH}").alias("head_hash")), "heads")
    grouped = rows.join(shared.bounded(heads), "root").withColumn("is_head", F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col(shared.TEXT_HASH) == F.col("head_hash")))
    key = ["doc_id", shared.TEXT_HASH]
    dropped = scratch.save(grouped.where(~F.col("is_head")).select(*key).distinct(), "dropped")
    again = scratch.save(grouped.where("is_head").groupBy(*key).count().where("count > 1").select(*key), "again")
    kept = shared.without(docs, dropped)
    if again.isEmpty():
        return kept
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    several = shared.without(kept, again, "left_semi").withColumn("__order", F.xxhash64(*others, F.lit(0))).withColumn(shared.TEXT_HASH, F.xxhash64(F.col("text").cast("string")))
    first = several.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy("__order"))).where("__place = 1").select(*docs.columns)
    return shared.without(kept, again).select(*docs.columns).unionByName(first)
