"""Copies of images by local descriptors: multiscale corners, oriented binary tests, Hamming tables, geometric consensus.

An image is a grey raster. At each of ``SCALES`` the corners with the strongest structure (the smaller eigenvalue of the
gradient matrix, largest in its neighbourhood) are taken: one for each ``AREA`` pixels of the raster, ``FEWEST`` at least
where there are so many. Each gets an orientation from its intensity centroid and ``BITS`` comparisons of smoothed
intensities at places turned by it. The places are chosen so that comparisons tell different things (``tests``), as the
corners of unrelated images that share a key by chance are as many as the square of the images, times that chance; they
are read between the pixels, around the very top of the corner's structure, so that a copy's bits change less.

Images with equal rasters become one node first. Two images are linked by descriptors within ``NEAR`` bits of each other
and a consensus among them, that is a similarity transform (shift, turn, scale) that ``AGREE`` matches follow. Linked
images form classes named by the smallest id. ``TABLES`` parts of a descriptor of ``WIDTH`` bits each make its keys.
Descriptors that share a key meet in its bucket, and those over ``NEAR`` bits apart are left out in the join itself, on
whole descriptors, before anything is shuffled. Pairs of images of which ``MEETINGS`` corners meet are compared in full:
first, in one of eight buckets, every image with the smallest only (a star), which joins crowds of copies early, then
all pairs of images that are still in different classes, in all buckets, without a cap. In a bucket that a crowd fills,
its class meets the others' rows, never itself. A pair is missed if fewer than ``MEETINGS`` of its corners keep a key;
the README states the recall against comparing all pairs.

Defined cases: null, empty or undecodable images and images without corners have no link; repeated rows are copies; a
null id takes part under no name; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, row_count_up_to, tune
from textloom.llm.components import components

SCALES, AREA, FEWEST = (1.0, 0.84, 0.7), 576, 16
BITS, TABLES, WIDTH = 128, 5, 24
PATCH, NEAR, AGREE, MEETINGS = 12, 24, 6, 2
#: Size of a class, and rows of it in one bucket, from which on the bucket isn't joined within that class. Changes the plan, not the result.
CROWD = 8
#: Ids of 8 bytes up to which those of a set of pairs are broadcast.
BROADCAST_IDS = 500_000
#: Places of proposed moves that one step of a consensus looks at.
STEP = 1 << 18

#: Comparisons that are chosen from, what a changed bit counts against likeness, and sizes of what smooth random images show.
CHOICE, STEADY, GRAINS = 4000, 2.0, (3, 5)


@functools.cache
def tests() -> np.ndarray:
    """Pairs of places (x, y, x', y') to compare: of random ones in the disk around a corner those that are least alike.

    In a smooth random image two differences of intensities correlate as their four places are near each other. One
    after another, the pair is taken that is least alike those taken, by what their bits share, and whose bit seldom
    changes as the image is moved by a pixel, turned or scaled a little; then each is chosen once more, twice, beside all others.
    """
    rng = np.random.default_rng(7)
    a, b = (PATCH + 1) * np.sqrt(rng.uniform(0, 1, (2, CHOICE))) * np.exp(2j * np.pi * rng.uniform(0, 1, (2, CHOICE)))
    near = lambda x, y: sum(np.exp(-(np.abs(x - y) ** 2) / (2 * g * g)) for g in GRAINS) / len(GRAINS)
    size = lambda x, y: 2 - 2 * near(x, y)
    alike = lambda c, d: (near(a, c) - near(a, d) - near(b, c) + near(b, d)) / np.sqrt(size(a, b) * size(c, d) + 1e-9)
    moved = [alike(a * m, b * m) for m in (1.09, 0.91, np.exp(0.12j))] + [alike(a + m, b + m) for m in (1, 1j)]
    cost = STEADY * np.mean([np.arccos(np.clip(x / (1 + 0.04 / size(a, b)), -1, 1)) for x in moved], 0) / np.pi
    shared = lambda i: (np.arcsin(np.clip(alike(a[i], b[i]), -1, 1)) * 2 / np.pi) ** 2 + np.where(np.arange(CHOICE) == i, 1e3, 0)
    taken: list[int] = []
    for step in range(3 * BITS):
        if step >= BITS:
            cost = cost - shared(taken.pop(0))
        taken.append(int(np.argmin(cost)))
        cost = cost + shared(taken[-1])
    return np.stack([a.real, a.imag, b.real, b.imag], 1)[taken]


def pack(image: np.ndarray) -> bytes:
    """A raster as bytes: height and width as 16-bit integers, then the rows."""
    return np.array(image.shape, "<u2").tobytes() + image.astype(np.uint8).tobytes()


def unpack(raw: bytes | None) -> np.ndarray | None:
    """The raster, or None if the bytes don't hold one."""
    if raw is None or len(raw) < 4:
        return None
    h, w = np.frombuffer(raw[:4], "<u2").tolist()
    return np.frombuffer(raw[4:], np.uint8).reshape(h, w) if h and w and len(raw) == 4 + h * w else None


def _smooth(x: np.ndarray, step: int = 1) -> np.ndarray:
    """Binomial weights of five places each way, ``step`` apart."""
    x, k = np.pad(x, 2 * step, mode="edge"), step
    x = (x[: -4 * k] + 4 * x[k : -3 * k] + 6 * x[2 * k : -2 * k] + 4 * x[3 * k : -k] + x[4 * k :]) / 16
    return (x[:, : -4 * k] + 4 * x[:, k : -3 * k] + 6 * x[:, 2 * k : -2 * k] + 4 * x[:, 3 * k : -k] + x[:, 4 * k :]) / 16


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    h, w = (max(1, round(s * scale)) for s in image.shape)
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, image.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, image.shape[0] - 2)), np.minimum(x.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (image[y0][:, x0] * (1 - fy) + image[y1][:, x0] * fy) * (1 - fx) + (image[y0][:, x1] * (1 - fy) + image[y1][:, x1] * fy) * fx


def _top(x: np.ndarray, ys: np.ndarray, xs: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """How far from a peak, half a pixel at most, the parabola through it and its neighbours has its top."""
    low, high = x[ys - dy, xs - dx], x[ys + dy, xs + dx]
    return np.clip((low - high) / np.minimum(2 * (low - 2 * x[ys, xs] + high), -1e-9), -0.5, 0.5)


def _between(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values at places between the pixels, bilinear."""
    h, w = x.shape
    ys, xs, x = np.clip(ys, 0, h - 1.001), np.clip(xs, 0, w - 1.001), x.ravel()
    y, z = ys.astype(int), xs.astype(int)
    fy, fx, k = ys - y, xs - z, y * w + z
    return (x[k] * (1 - fx) + x[k + 1] * fx) * (1 - fy) + (x[k + w] * (1 - fx) + x[k + w + 1] * fx) * fy


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y, scale, angle) in the image's own pixels, and descriptors as packed bits."""
    places, bits = [], []
    for scale in SCALES:
        level = _smooth(resize(image.astype(float), scale))
        h, w = level.shape
        if min(h, w) < 2 * PATCH + 6:
            continue
        gy, gx = np.gradient(level)
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        edge = PATCH + 1
        inner = strength[edge:-edge, edge:-edge]
        peak = inner > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= strength[edge + dy : h - edge + dy, edge + dx : w - edge + dx]
        ys, xs = np.nonzero(peak)
        order = np.argsort(-inner[ys, xs], kind="stable")[: max(FEWEST, image.size // AREA)]
        ys, xs = ys[order] + edge, xs[order] + edge
        if not len(ys):
            continue
        r = np.arange(-PATCH + 1, PATCH)
        disk = (r[:, None] ** 2 + r[None] ** 2) < PATCH * PATCH
        patch = level[ys[:, None, None] + r[:, None], xs[:, None, None] + r] * disk
        angle = np.arctan2((patch * r[:, None]).sum((1, 2)), (patch * r[None]).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        soft, pairs, cy, cx = _smooth(level, 2), tests(), ys + _top(strength, ys, xs, 1, 0), xs + _top(strength, ys, xs, 0, 1)
        at = lambda px, py: _between(soft, cy[:, None] + s * px + c * py, cx[:, None] + c * px - s * py)
        bits.append(at(pairs[:, 0], pairs[:, 1]) < at(pairs[:, 2], pairs[:, 3]))
        places.append(np.stack([xs / scale, ys / scale, np.full(len(xs), 1 / scale), angle], 1))
    if not bits:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.vstack(places), np.packbits(np.vstack(bits), 1)


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Matches that follow one similarity transform from ``a`` to ``b``: ``AGREE`` or more, or how few at most."""
    if not len(a[0]) or not len(b[0]):
        return 0
    apart = np.bitwise_count(a[1][:, None] ^ b[1][None]).sum(2)
    best = apart.argmin(1)
    i = np.flatnonzero(apart[np.arange(len(best)), best] <= NEAR)
    if len(i) < AGREE:
        return 0
    p, q = a[0][i], b[0][best[i]]
    x, y = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    level, turn = q[:, 2] / p[:, 2], q[:, 3] - p[:, 3]
    span, theirs = x[None] - x[:, None], y[None] - y[:, None]
    # a match proposes the scale and turn of its corners, or the scale alone; if that isn't enough, what it spans with another
    moves = np.stack([level.astype(complex), level * np.exp(1j * turn)], 1)
    most = _most(moves, span, theirs, p, q, np.ones(moves.shape, bool))
    if most < AGREE:
        with np.errstate(divide="ignore", invalid="ignore"):
            moves = np.where(np.abs(span) >= 8, theirs / span, 0)
        most = max(most, _most(moves, span, theirs, p, q, (np.abs(moves) >= 0.4) & (np.abs(moves) <= 2.5)))
    return most


def _most(moves: np.ndarray, span: np.ndarray, theirs: np.ndarray, p: np.ndarray, q: np.ndarray, may: np.ndarray) -> int:
    """Matches that follow one of the proposed moves, counted by places apart; no further than ``AGREE`` tells."""
    most, rows = 0, max(1, STEP // moves.size)
    for k in range(0, len(moves), rows):
        part = slice(k, k + rows)
        follows = np.abs(moves[part, :, None] * span[part, None] - theirs[part, None]) < 3.0
        counts = np.where(may[part], follows.sum(2), 0)
        for at in np.argsort(-counts, axis=None).tolist():
            i, j = divmod(at, counts.shape[1])
            if counts[i, j] <= most or counts[i, j] < AGREE:
                break
            f = follows[i, j]
            most = max(most, min(len(np.unique(np.rint(p[f, :2] / 2), axis=0)), len(np.unique(np.rint(q[f, :2] / 2), axis=0))))
            if most >= AGREE:
                return most
    return most


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, places, words = [], [], []
        for raw in batch.column(1).to_pylist():
            image = unpack(raw)
            p, d = describe(image) if image is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
            digests.append(hashlib.sha256(raw).digest()[:16] if image is not None else None)
            places.append(p.astype("<f4").tobytes())
            words.append(np.ascontiguousarray(d).view(">i8").ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(places, pa.binary()), pa.array(words, pa.list_(pa.int64()))], names=["media_id", "digest", "places", "words"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        read = lambda p, w: (np.frombuffer(p, "<f4").reshape(-1, 4).astype(float), np.array(w, np.int64).reshape(-1, 2).view(np.uint64))
        hit = [k for k in range(len(rows["a"])) if max(consensus(x := read(rows["pa"][k], rows["wa"][k]), y := read(rows["pb"][k], rows["wb"][k])), consensus(y, x)) >= AGREE]
        yield pa.RecordBatch.from_arrays([pa.array([rows["a"][k] for k in hit], pa.int64()), pa.array([rows["b"][k] for k in hit], pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree. Only what is in a pair is shuffled, by ids that are broadcast while few."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = nodes.join(F.broadcast(ids) if row_count_up_to(ids, BROADCAST_IDS) <= BROADCAST_IDS else ids, "node", "left_semi")
    one = nodes.select(F.col("node").alias("b"), F.col("places").alias("pb"), F.col("words").alias("wb"))
    two = nodes.select(F.col("node").alias("a"), F.col("places").alias("pa"), F.col("words").alias("wa"))
    return cut(pairs.join(one, "b").join(two, "a").select("a", "b", "pa", "wa", "pb", "wb").mapInArrow(_compared, "a long, b long"))


def corners(nodes: DataFrame) -> DataFrame:
    """Rows (key, *columns, u, v) for each table and descriptor (two words u, v) of ``nodes`` (words, *columns)."""
    rest = [c for c in nodes.columns if c != "words"]
    pairs = "transform(sequence(0, size(words) div 2 - 1), i -> struct(words[2 * i] as u, words[2 * i + 1] as v))"
    each = nodes.where(F.size("words") > 0).select(*rest, F.explode(F.expr(pairs)).alias("d"))
    parts = [_bits_from(F.col("d.u"), F.col("d.v"), t * WIDTH) * TABLES + t for t in range(TABLES)]
    return each.select(*rest, F.col("d.u").alias("u"), F.col("d.v").alias("v"), F.explode(F.array(*parts)).alias("key"))


def _bits_from(u: F.Column, v: F.Column, at: int) -> F.Column:
    """The ``WIDTH`` bits from place ``at`` of the 128 of two words, the first one highest."""
    mask, low = F.lit((1 << WIDTH) - 1).cast("long"), 64 - at - WIDTH
    if low >= 0:
        return F.shiftrightunsigned(u, low).bitwiseAND(mask)
    if at >= 64:
        return F.shiftrightunsigned(v, 128 - at - WIDTH).bitwiseAND(mask)
    return F.shiftleft(u, -low).bitwiseOR(F.shiftrightunsigned(v, 64 + low)).bitwiseAND(mask)


def _near(x: str, y: str) -> F.Column:
    """Whether two descriptors are within ``NEAR`` bits of each other."""
    differ = lambda w: F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}")))
    return differ("u") + differ("v") <= NEAR


def _met(meetings: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``meetings`` (a, b, corner) that meet with ``MEETINGS`` (two) different corners of b."""
    return cut(meetings.groupBy("a", "b").agg(F.min("corner").alias("c1"), F.max("corner").alias("c2")).where("c1 < c2").select("a", "b"))


def _stars(nodes: DataFrame) -> DataFrame:
    """The links (a, b) of nodes with the smallest one of their bucket, in one of eight buckets by hash."""
    few = corners(nodes.select("node", "words")).where(F.pmod(F.xxhash64("key"), F.lit(8)) == 0)
    centres = few.groupBy("key").agg(F.min(F.struct("node", "u", "v")).alias("x"), F.count("*").alias("n")).where("n > 1").select("key", "x")
    met = few.select("key", F.struct("node", "u", "v").alias("y")).join(centres, "key").where((F.col("x.node") < F.col("y.node")) & _near("x", "y"))
    return _links(_met(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.xxhash64("y.u", "y.v").alias("corner"))), nodes)


def _meetings(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (a, b, corner) for all pairs of nodes in different classes that meet in their buckets.

    Each pair of rows of a bucket has one outside the bucket's crowd, if it has a crowd, as both would be in one class
    else; so the rows outside are joined with each other and with the crowd. Adaptive execution splits a bucket that is much larger than others.
    """
    large = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    large = cut(named.join(large.select("component"), "component", "left_semi").select("node", F.col("component").alias("class")))
    crowds = corners(nodes.select("node", "words").join(large, "node").select("class", "words"))
    crowds = crowds.groupBy("key", "class").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    crowds = cut(crowds.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("crowd")))
    # no node is null; said here, as the first join says so of what it reads, and a plan that differs in that isn't shared
    placed = nodes.where("node is not null").select("node", "words").join(named, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "words")
    rows = corners(placed).join(crowds, "key", "left").withColumn("inside", F.coalesce(F.col("class") == F.col("crowd"), F.lit(False)))
    side = lambda inside, n: rows.where(F.col("inside") == inside).select("key", F.struct("node", "class", "u", "v").alias(n))
    # what is outside is read three times, but shuffled once
    pairs = side(False, "x").join(side(False, "y"), "key").where(F.col("x.node") < F.col("y.node"))
    pairs = pairs.unionAll(side(False, "x").join(side(True, "y"), "key")).where((F.col("x.class") != F.col("y.class")) & _near("x", "y"))
    swap = F.col("x.node") > F.col("y.node")
    low, high = (F.when(swap, F.col(m)).otherwise(F.col(n)) for m, n in (("y", "x"), ("x", "y")))
    return pairs.select(low.getField("node").alias("a"), high.getField("node").alias("b"), F.xxhash64(high.getField("u"), high.getField("v")).alias("corner"))


def copies(media: DataFrame) -> DataFrame:
    """Rows (media_id, class_id, n_links) for every row of ``media`` (media_id, image); n_links: links found of its node."""
    tune(media.sparkSession)
    media = media.select(F.col("media_id").cast("long").alias("media_id"), F.col("image").cast("binary").alias("image"))
    found = media.mapInArrow(_described, "media_id long, digest binary, places binary, words array<long>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    firsts = cut(found.where("digest is not null and media_id is not null").groupBy("digest").agg(F.min(F.struct("media_id", "row")).alias("f")).select("digest", F.col("f.media_id").alias("node"), F.col("f.row").alias("row")))
    nodes = found.select("row", "places", "words").join(firsts.select("row", "node"), "row").select("node", "places", "words")
    stars = _stars(nodes)
    across = _links(_met(_meetings(nodes, cut(components(stars, "a", "b")))), nodes)
    links = cut(stars.union(across))
    named = cut(components(links, "a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    classes = cut(firsts.select("digest", "node").join(named, "node", "left").join(degree, "node", "left").select("digest", F.coalesce("component", "node").alias("class"), F.coalesce("count", F.lit(0)).cast("long").alias("n")))
    out = found.select("media_id", "digest").join(classes, "digest", "left")
    return out.select("media_id", F.coalesce("class", "media_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


SIDE = 96


def render(vector: np.ndarray) -> np.ndarray:
    """A raster that depends on a vector alone: a coarse random grid from the vector's digest, drawn out smoothly."""
    rng = np.random.default_rng(list(hashlib.sha256(vector.astype("<f4").tobytes()).digest()))
    return np.clip(resize(rng.uniform(0, 255, (SIDE // 4, SIDE // 4)), 4.0), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, draw: int) -> np.ndarray:
    """A cropped copy with other brightness, contrast and some noise; every third is turned by a quarter."""
    rng = np.random.default_rng(draw)
    top, left, bottom, right = rng.integers(2, 12, 4)
    out = image[top : SIDE - bottom, left : SIDE - right].astype(float) * rng.uniform(0.8, 1.1) + rng.uniform(-10, 15) + rng.normal(0, 1.5, (SIDE - top - bottom, SIDE - left - right))
    return np.clip(np.rot90(out) if draw % 3 == 0 else out, 0, 255).astype(np.uint8)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, images = [], []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            image = render(np.array([0.0 if x is None else x for x in vector or []], np.float32))
            ids.append(i)
            images.append(pack(image))
            if i is not None and i % 4 == 0:
                ids.append(-i - 1)
                images.append(pack(edited(image, i)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["media_id", "image"])


def gallery(embeddings: DataFrame) -> DataFrame:
    """Rows (media_id, image): a raster for each row of ``embeddings`` (vec_id, embedding), and for ids divisible by 4
    an edited copy under the id ``-vec_id - 1``. There is no table of images; this one stands for it."""
    tune(embeddings.sparkSession)
    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_rendered, "media_id long, image binary")
