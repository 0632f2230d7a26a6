"""Copies of images, cropped or edited ones too, by local descriptors.

1. Corners. Each image is taken at several scales, the more the larger it is; the strongest corners (Harris response,
   local maxima) of each cell of CELL by CELL pixels of each scale become keypoints, with the orientation of the grey-value
   centroid around them. Their number grows with the image's area, so a part of an image has about those of the whole.
2. Descriptors. BITS comparisons of pairs of smoothed grey values around the keypoint, in a pattern turned to its
   orientation, so that brightness and rotation leave most bits as they are.
3. Hamming tables. A descriptor's bits are cut into TABLES keys. Two descriptors within TABLES - 1 bits agree in a whole
   key; others that are somewhat further apart often do. Joins on (table, key) of the queries' descriptors with all
   images' give pairs, of which those within HAMMING bits stay. Long keys keep chance pairs few in large collections.
4. Geometric consensus. Each pair of keypoints votes for a rotation, scale and shift, in coarse cells, each of which
   overlaps its neighbours by half in each of these; an image is a copy if MATCHES different keypoints agree in a cell.

Equal images are one class before anything is paired, so a group of exact copies counts as one image. The queries'
keypoints are broadcast where their counted number allows it; else both sides are dealt out by (table, key).

A null or malformed image (no pixels, not numbers) has no keypoints and no copies. Flat images have no corners and match
only their exact copies. Repeated rows are one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm import shared

#: Each scale is so much of the one before; two of any image, further ones while both sides have LEAST pixels.
SCALE, LEAST = 0.7, 32
#: Keypoints of a cell of a scale, and pixels of a cell's side.
KEYPOINTS, CELL = 8, 16
#: Keypoints that are described at a time.
RUN = 2000
#: Pixels of the images that are worked on together.
STACK = 1 << 18
#: Queries are one class if this share of the keypoints of either is the other's; pixels of a place in which they may be.
SAME, NEAR = 0.3, 8.0
#: Pixels of the areas of a picture in each of which queries of one class have a keypoint in common, if one of them has FULL
#: there: fewer don't make a link, of which some half agree.
AREA, FULL = 12.0, 2 * 5
PATCH = 18
BITS, TABLES = 128, 6
HAMMING = 14
MATCHES = 5
#: Cells of votes: a turn has so many; pixels of a shift. Those of scale are half an octave.
TURNS, STEP = 12, 10.0
_pattern = np.random.default_rng(3).normal(0, PATCH / 2.2, (BITS, 4)).clip(-PATCH + 2, PATCH - 2)
KEYS = "class long, x float, y float, scale float, angle float, low long, high long"


def blurred(images: np.ndarray) -> np.ndarray:
    """Binomial smoothing with a width of five, of one image or a stack of them."""
    for axis in (-2, -1):
        p = np.pad(images, [(2, 2) if a - images.ndim == axis else (0, 0) for a in range(images.ndim)], mode="edge")
        n = images.shape[axis]
        s = [np.take(p, range(i, i + n), axis=axis) for i in range(5)]
        images = (s[0] + 4 * s[1] + 6 * s[2] + 4 * s[3] + s[4]) / 16
    return images


def resized(images: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear, of one image or a stack of them."""
    if factor == 1:
        return images
    h, w = (max(2, round(n * factor)) for n in images.shape[-2:])
    y, x = np.linspace(0, images.shape[-2] - 1, h), np.linspace(0, images.shape[-1] - 1, w)
    return sampled(images, *np.meshgrid(y, x, indexing="ij"))


def sampled(images: np.ndarray, y: np.ndarray, x: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Grey values between pixels; outside, those of the nearest edge. `of`: which image of a stack each place is in."""
    y, x = y.clip(0, images.shape[-2] - 1.001), x.clip(0, images.shape[-1] - 1.001)
    a, b = y.astype(int), x.astype(int)
    u, v = y - a, x - b
    at = (lambda i, j: images[..., i, j]) if of is None else (lambda i, j: images[of, i, j])
    return at(a, b) * (1 - u) * (1 - v) + at(a + 1, b) * u * (1 - v) + at(a, b + 1) * (1 - u) * v + at(a + 1, b + 1) * u * v


def keypoints(image: np.ndarray) -> list[tuple]:
    """Rows of x, y, scale, angle (whole-image pixels) and the two halves of the descriptor, of one grey image."""
    found = stack_keypoints(image[None])
    return list(zip(*(c.tolist() for c in found[1:]), strict=True))


def stack_keypoints(stack: np.ndarray) -> list[np.ndarray]:
    """Of images of one size: which image, x, y, scale, angle, and the two halves of the descriptor."""
    out = []
    for factor in scales(stack.shape[1:]):
        now = blurred(resized(stack, factor))
        if min(now.shape[1:]) < PATCH:
            continue
        gy, gx = np.gradient(now, axis=(1, 2))
        xx, yy, xy = blurred(gx * gx), blurred(gy * gy), blurred(gx * gy)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        p = np.pad(response, [(0, 0), (1, 1), (1, 1)], constant_values=-np.inf)
        around = np.max([p[:, 1 + i : p.shape[1] - 1 + i, 1 + j : p.shape[2] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        least = np.maximum(1e-9, 1e-4 * response.max(axis=(1, 2), keepdims=True))
        which, y, x = np.nonzero((response >= around) & (response > least))
        wide, high = now.shape[2] // CELL + 1, now.shape[1] // CELL + 1
        cell = (which * high + y // CELL) * wide + x // CELL
        order = np.lexsort((-response[which, y, x], cell))
        edge = np.flatnonzero(np.diff(cell[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order))))
        best = order[rank < KEYPOINTS]
        for i in range(0, len(best), RUN):
            at = best[i : i + RUN]
            out.append(described(now, which[at], y[at].astype(float), x[at].astype(float), factor))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 7


def scales(shape: tuple[int, ...]) -> list[float]:
    out = [1.0, SCALE]
    while min(shape) * out[-1] * SCALE >= LEAST:
        out.append(out[-1] * SCALE)
    return out


def described(now: np.ndarray, which: np.ndarray, y: np.ndarray, x: np.ndarray, factor: float) -> list[np.ndarray]:
    """The keypoints at some places of one scale, as `stack_keypoints` gives them."""
    grid = np.arange(-PATCH // 2, PATCH // 2 + 1)
    dy, dx = (g.ravel() for g in np.meshgrid(grid, grid, indexing="ij"))
    inside = dx * dx + dy * dy <= (PATCH // 2) ** 2
    dy, dx = dy[inside], dx[inside]
    of = which[:, None]
    patch = sampled(now, y[:, None] + dy, x[:, None] + dx, of)
    patch = patch - patch.mean(axis=1, keepdims=True)
    angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    x1, y1, x2, y2 = _pattern.T
    one = sampled(now, y[:, None] + s * x1 + c * y1, x[:, None] + c * x1 - s * y1, of)
    two = sampled(now, y[:, None] + s * x2 + c * y2, x[:, None] + c * x2 - s * y2, of)
    halves = np.packbits(one < two, axis=1).view(">u8").astype(np.uint64).astype(np.int64)
    return [which, x / factor, y / factor, np.full(len(x), 1 / factor), angle, halves[:, 0], halves[:, 1]]


def dense(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 on for each different row of the integer columns."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        c = c - c.min()
        out = np.unique(out * (c.max() + 1) + c, return_inverse=True)[1].ravel()
    return out


def most_agreeing(pair: np.ndarray, votes: dict[str, np.ndarray], pairs: int) -> np.ndarray:
    """For each pair of images, the most keypoints whose votes meet in a cell. The cells of turn, scale and either shift
    are each taken as they are and moved by half their width, in all combinations, so votes within half a width of each
    other in all four are together in one of them wherever they lie."""
    best = np.zeros(pairs, dtype=np.int64)
    if not len(pair):
        return best
    ends = [dense(*(np.unique(votes[c], return_inverse=True)[1].ravel() for c in ends)) for ends in (("x", "y"), ("q_x", "q_y"))]
    for turn, grow, sx, sy in product((0, 0.5), repeat=4):
        place = lambda c, by: np.floor(votes[c] + by).astype(np.int64)
        cell = dense(pair, place("turn", turn) % TURNS, place("grow", grow), place("sx", sx), place("sy", sy))
        count = np.minimum(*(np.bincount(np.unique(cell * (e.max() + 1) + e) // (e.max() + 1)) for e in ends))
        np.maximum.at(best, pair, count[cell])
    return best


def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, class, votes to query, class, matches of the pairs with MATCHES or more."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        pair = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        votes = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "q_x q_y x y turn grow sx sy".split()}
        best = most_agreeing(pair, votes, len(batch))
        keep = pa.array(best >= MATCHES)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(best).filter(keep)], names=["query", "class", "matches"])


def described_images(images: DataFrame, name: str) -> DataFrame:
    """Keypoints of images (`name`, pixels, height): name, x, y, scale, angle, low, high."""
    kinds = [pa.int64()] + [pa.float32()] * 4 + [pa.int64()] * 2
    names = [name, *"x y scale angle low high".split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heights = batch.column(0), batch.column(2).fill_null(0).to_numpy()
            pixels = batch.column(1)
            values, ends = pixels.values.to_numpy(zero_copy_only=False), pixels.offsets.to_numpy()
            size = np.diff(ends) * ~pixels.is_null().to_numpy(zero_copy_only=False)
            width = np.where(heights > 1, size // np.maximum(heights, 1), 0)
            fits = (width > 1) & (width * heights == size)
            for h, w in sorted(set(zip(heights[fits].tolist(), width[fits].tolist(), strict=True))):
                rows = np.flatnonzero(fits & (heights == h) & (width == w))
                step = max(1, STACK // (h * w))
                for i in range(0, len(rows), step):
                    at = rows[i : i + step]
                    stack = np.stack([values[ends[r] : ends[r] + h * w] for r in at.tolist()]).astype(float)
                    good = np.isfinite(stack).all(axis=1)
                    if not good.any():
                        continue
                    which, *found = stack_keypoints(stack[good].reshape(-1, h, w))
                    owner = ids.take(pa.array(at[good][which.astype(int)], pa.int64()))
                    yield pa.RecordBatch.from_arrays([owner, *(pa.array(c, k) for c, k in zip(found, kinds[1:], strict=True))], names=names)

    return shared.mapped(images.select(F.col(name).cast("long").alias(name), F.col("pixels").cast("array<float>").alias("pixels"), F.col("height").cast("int").alias("height")), run, KEYS.replace("class", name))


def _width() -> int:
    return 64 // (TABLES // 2)  # bits of a key; a last bit of each half may stay over


def _keyed(keypoints: DataFrame) -> DataFrame:
    """A row for each keypoint and table, with the table's key."""
    part = lambda t: F.shiftrightunsigned(F.col("low" if t >= TABLES // 2 else "high"), (t % (TABLES // 2)) * _width()).bitwiseAND(F.lit((1 << _width()) - 1))
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("table"), part(t).alias("key")) for t in range(TABLES)))).alias("at")
    return keypoints.select("*", tables).select("*", "at.table", "at.key").drop("at")


def _near(one: str, two: str) -> Column:
    """Whether two descriptors are within HAMMING bits; true in the first table in which they meet alone."""
    apart = lambda c: F.col(f"{one}{c}").bitwiseXOR(F.col(f"{two}{c}"))
    near = F.bit_count(apart("low")) + F.bit_count(apart("high")) <= HAMMING
    piece = lambda t: F.shiftrightunsigned(apart("low" if t >= TABLES // 2 else "high"), (t % (TABLES // 2)) * _width()).bitwiseAND(F.lit((1 << _width()) - 1))
    first = F.lit(TABLES)
    for t in reversed(range(TABLES)):
        first = F.when(piece(t) == 0, F.lit(t)).otherwise(first)
    return near & (first == F.col("table"))


def _votes(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs of keypoints (x, y, scale, angle and q_x, ...) to a row with all votes for each pair of images. A list is
    bounded by the two images' keypoints."""
    turn = F.col("angle") - F.col("q_angle")
    grow = F.col("scale") / F.col("q_scale")
    shift_x = F.col("x") - grow * (F.cos(turn) * F.col("q_x") - F.sin(turn) * F.col("q_y"))  # a similarity maps the query's place to the image's
    shift_y = F.col("y") - grow * (F.sin(turn) * F.col("q_x") + F.cos(turn) * F.col("q_y"))
    around = F.pmod(turn, F.lit(2 * np.pi)) / (2 * np.pi / TURNS)
    vote = [F.col(c).cast("float").alias(c) for c in ("q_x", "q_y", "x", "y")]
    vote += [c.cast("float").alias(n) for n, c in {"turn": around, "grow": F.log2(grow) * 2, "sx": shift_x / STEP, "sy": shift_y / STEP}.items()]
    return pairs.groupBy(*by).agg(F.collect_list(F.struct(*vote)).alias("votes")).where(F.size("votes") >= MATCHES)


def _matched(every: DataFrame, asked: DataFrame) -> DataFrame:
    """query, class, matches, of stored keypoints of images and of queries."""
    few = asked.count() * TABLES * 48 <= shared.BROADCAST_BYTES
    asked = _keyed(asked).select("query", "table", "key", *(F.col(c).alias(f"q_{c}") for c in ("x", "y", "scale", "angle", "low", "high")))
    pairs = _keyed(every).join(F.broadcast(asked) if few else asked, ["table", "key"]).where(_near("", "q_"))
    return shared.mapped(_votes(pairs, "query", "class"), agreed, "query long, class long, matches long")


def copy_groups(images: DataFrame, queries: DataFrame) -> DataFrame:
    """Which images are copies of the queries.

    images: class long (one row for each different image), pixels array<float>, height int. queries: query long, pixels,
    height. Gives query, class, matches (keypoints that agree), a row for each such pair.
    """
    scratch = shared.Scratch(images.sparkSession, "media")
    return _matched(scratch.save(described_images(images, "class"), "keypoints"), scratch.save(described_images(queries, "query"), "asked"))


def areas(pair: np.ndarray, x: np.ndarray, y: np.ndarray, by: tuple[float, float]) -> np.ndarray:
    """A number for each area of each pair in which places lie."""
    cell = lambda c, b: np.floor(c / AREA + b).astype(np.int64) + 1
    return (pair << 32) + (cell(x, by[0]) << 16) + cell(y, by[1])


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of queries whose keypoints agree where they are, without turn, growth or shift, all over the picture: in
    enough of their keypoints, and in each area of which either has enough keypoints to be found by them alone. Queries
    that share a part of their pictures and differ in another are not alike, as each has copies that the other has not."""
    for batch in batches:
        lists, n = batch.column(2), len(batch)
        flat = lists.flatten()
        pair = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        votes = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "q_x q_y x y turn grow sx sy".split()}
        turn = np.minimum(votes["turn"], TURNS - votes["turn"])
        same = (turn < 0.25) & (np.abs(votes["grow"]) < 0.25) & (np.abs(votes["sx"]) < 0.3) & (np.abs(votes["sy"]) < 0.3)
        pair, x, y = pair[same], votes["q_x"][same], votes["q_y"][same]
        one = np.unique(dense(pair, *(np.unique(c, return_inverse=True)[1].ravel() for c in (x, y))), return_index=True)[1] if len(pair) else np.zeros(0, np.int64)
        pair, x, y = pair[one], x[one], y[one]
        most, apart = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for side in (3, 4):
            places = batch.column(side)
            of = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
            most = np.maximum(most, np.bincount(of, minlength=n))
            px, py = (places.flatten().field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            for by in product((0, 0.5), repeat=2):
                held, count = np.unique(areas(of, px, py, by), return_counts=True)
                lost = held[(count >= FULL) & ~np.isin(held, areas(pair, x, y, by))]
                apart[lost >> 32] = True
        keep = pa.array((np.bincount(pair, minlength=n) >= np.maximum(MATCHES, SAME * most)) & ~apart)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["query", "hub"])


def query_classes(asked: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """query, asked_class: the queries of stored keypoints that show one picture in one frame get one class, the number of
    the query that stands for them. Each query is held against the least one with a key in a place alone, so a group of
    G such queries costs G pairs."""
    place = [(F.floor(F.col("x") / NEAR)).alias("cx"), (F.floor(F.col("y") / NEAR)).alias("cy"), F.round(F.col("scale") * 10).cast("int").alias("size")]
    keyed = _keyed(asked).select("*", *place)
    at = ["table", "key", "cx", "cy", "size"]
    own = F.struct("query", "x", "y", "scale", "angle", "low", "high")
    hubs = scratch.save(keyed.groupBy(*at).agg(F.min(own).alias("hub"), F.max("query").alias("most")).where("hub.query < most").drop("most"), "hubs")
    fields = [F.col(f"hub.{c}").alias(f"h_{c}") for c in ("query", "x", "y", "scale", "angle", "low", "high")]
    pairs = keyed.join(hubs.select(*at, *fields), at).where((F.col("h_query") < F.col("query")) & _near("", "h_"))
    pairs = pairs.select("query", F.col("h_query").alias("hub"), *(F.col(c).alias(f"q_{c}") for c in ("x", "y", "scale", "angle")), *(F.col(f"h_{c}").alias(c) for c in ("x", "y", "scale", "angle")))
    places = scratch.save(asked.groupBy("query").agg(F.collect_list(F.struct("x", "y")).alias("own")), "places")  # a picture's keypoints
    placed = _votes(pairs, "query", "hub").join(places, "query").join(places.select(F.col("query").alias("hub"), F.col("own").alias("other")), "hub")
    found = shared.mapped(placed.select("query", "hub", "votes", "own", "other"), alike, "query long, hub long")
    found = scratch.save(found, "alike")
    free = found.join(found.select(F.col("query").alias("hub")).distinct(), "hub", "left_anti")  # hubs that stand for themselves
    attached = scratch.save(free.groupBy("query").agg(F.min("hub").alias("asked_class")), "attached")
    return asked.select("query").distinct().join(attached, "query", "left").withColumn("asked_class", F.coalesce("asked_class", "query"))


def _twins(asked: DataFrame) -> DataFrame:
    """query, twin: queries with equal keypoints get the number of the least one."""
    keypoint = ["x", "y", "scale", "angle", "low", "high"]
    digests = [F.bit_xor(F.xxhash64(*keypoint)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), *keypoint)).alias("d2")]
    digested = asked.groupBy("query").agg(F.count("*").alias("n"), *digests)
    return digested.join(digested.groupBy("n", "d1", "d2").agg(F.min("query").alias("twin")), ["n", "d1", "d2"]).select("query", "twin")


def copy_classes(images: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """copy_groups for groups of any size: (query, asked_class) of the queries with keypoints, and (asked_class, class,
    matches) of the images that are copies of a class. The links are the pairs of both over asked_class; a group with Q
    queries and I images takes Q + I rows, not Q * I. The queries of a class show one picture all over (see `alike`). Each
    query is searched for, equal ones once, and a class has what any of its queries finds, with the most keypoints: so no
    link of copy_groups is left out; an image at the edge of being found (MATCHES keypoints or hardly more) counts for all."""
    scratch = shared.Scratch(images.sparkSession, "media")
    every = scratch.save(described_images(images, "class"), "keypoints")
    asked = scratch.save(described_images(queries, "query"), "asked")
    twins = scratch.save(_twins(asked), "twins")
    searched = scratch.save(asked.join(twins.where("query = twin").select("query"), "query", "left_semi"), "searched")
    own = scratch.save(query_classes(searched, scratch), "own")
    found = _matched(every, searched).join(own, "query").groupBy("asked_class", "class").agg(F.max("matches").alias("matches"))
    classes = twins.join(own.withColumnRenamed("query", "twin"), "twin").select("query", "asked_class")
    return scratch.save(classes, "classes"), scratch.save(found, "found")
