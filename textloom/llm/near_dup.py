"""Near duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Words are longest runs of what isn't ASCII white space, after lower-casing A-Z. A text's set holds its distinct
shingles of five words; a shorter text has one shingle, a text without words (or null) has an empty set and no link.

1. One pass over the texts makes set sizes, a 128-bit digest of the whole set, and the band keys. Texts with equal sets
   become one node, so a group of exact copies, however large, takes part once.
2. In each bucket (texts that share a band key), every member meets one centre only: a star, so the number of candidates
   is at most the number of bucket rows. The centre is the member whose buckets are fullest: in a group of edited copies
   that is the text closest to the others. Candidates are weighed by their signatures (one byte a bin; a pair goes if it
   is ``SIGMAS`` standard errors below the threshold), then confirmed on the full shingle sets, for which only the texts
   of the remaining candidates move.
3. Members of buckets that still span several components go through an exact prefix filter: shingles are put in order,
   rare ones first, and texts meet only over a shingle that stands early enough in both for the rest to reach the
   threshold. All that meet across components are confirmed, without a cap, so no pair that shares a bucket is left.
   The order comes from a table of ``SLOTS`` counters; any order is right, a truer one makes fewer candidates. In a
   crowd that is close to a text but under the threshold, what tells its members apart is rare, so few of them meet.

A pair at the threshold shares no bucket with a probability of at most ``MISS``.

Defined cases: null or empty texts keep themselves; repeated rows count as copies; a null id takes part under no name,
so such a row is kept; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import blocks, cut, row_count_up_to, text_buffers, tune
from textloom.llm.components import components

SHINGLE = 5
#: Greatest probability that a pair at the threshold shares no bucket.
MISS = 1e-7
#: Standard errors that a signature may be below the threshold.
SIGMAS = 6.0
#: Counters of the shingle order in crowds: a table of fixed size, 8 bytes each.
SLOTS = 1 << 20
#: Ids of texts to confirm up to which they are broadcast, so that other texts aren't shuffled.
BROADCAST_IDS = 500_000


def shape(share: float) -> tuple[int, int]:
    """Rows per band and bands for a Jaccard similarity of ``share``."""
    rows = 5 if share >= 0.85 else 4 if share >= 0.7 else 3
    return rows, math.ceil(math.log(MISS) / math.log(1 - share**rows))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = text_buffers(texts)
    data = H.LOWER[data]
    for i, j in blocks(offsets):
        words, _, first = H.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], H.NON_SPACE)
        shingles = H.grams(words, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                yield H.grams(words[a:b], b - a)
            else:
                yield shingles[:0]


@functools.lru_cache(8)
def _edges(bins: int) -> np.ndarray:
    return np.array([min(k * 2**64 // bins, 2**64 - 1) for k in range(bins + 1)], np.uint64)


@functools.lru_cache(64)
def _drawn(bins: int, turn: int) -> np.ndarray:
    """For each bin the bins that it draws, 32 a turn."""
    x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 24) + np.arange(32 * turn + 1, 32 * turn + 33, dtype=np.uint64)
    return ((H.mix(x) >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)


def signature(sets: np.ndarray, bins: int) -> np.ndarray:
    """Smallest hash of each bin of the one permutation; an empty bin takes that of another, drawn until one is full.

    ``sets`` is sorted, and the bin is the hash's leading part, so the smallest of each bin is found by search.
    """
    first = np.searchsorted(sets, _edges(bins))
    full = first[1:] > first[:-1]
    full[-1] |= first[-1] < len(sets)
    out = sets[np.minimum(first[:-1], len(sets) - 1)]
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        hits = full[_drawn(bins, turn)[empty]]
        found = hits.any(1)
        out[empty[found]] = out[_drawn(bins, turn)[empty[found], hits[found].argmax(1)]]
        empty, turn = empty[~found], turn + 1
    return out


def _signatures(rows: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    salt = H.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                if not len(s):
                    digests.append((None, None))
                    keys.append(None)
                    sketches.append(None)
                    continue
                with np.errstate(over="ignore"):
                    digests.append((int(np.add.reduce(H.mix(s)).view(np.int64)), int(np.add.reduce(H.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))))
                    grouped = H.mix(signature(s, rows * bands)).reshape(bands, rows)
                    sketches.append((grouped >> np.uint64(56)).astype(np.uint8).tobytes())
                    keys.append(H.mix((grouped * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(3))).sum(1, dtype=np.uint64) + salt).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([x for x, _ in digests], pa.int64()), pa.array([x for _, x in digests], pa.int64()), pa.array(keys, schema.field("bands").type), pa.array(sketches, pa.binary())], schema=schema)

    return run


def _confirmer(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, its = None, None
        for batch in batches:
            a, b, linked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, other in enumerate(shingle_sets(batch.column(3))):
                if a[k] != centre:  # rows come sorted by their centre, so its set is made once
                    centre, its = a[k], next(shingle_sets(batch.column(2).slice(k, 1)))
                if 100 * min(len(its), len(other)) >= percent * max(len(its), len(other)):
                    both = len(np.intersect1d(its, other, assume_unique=True))
                    if 100 * both >= percent * (len(its) + len(other) - both):
                        linked.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in linked], pa.int64()), pa.array([b[k] for k in linked], pa.int64())], schema=schema)

    return run


def _likely(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            error = np.sqrt(share * (1 - share) / np.minimum(one.shape[1], np.minimum(na, nb)))
            keep = pa.array(((one == two).mean(1) >= share - SIGMAS * error) & (np.minimum(na, nb) >= share * np.maximum(na, nb) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = one.join(nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a")
    likely = cut(both.mapInArrow(_likely(percent / 100), "a long, b long"))
    ids = cut(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    ids = F.broadcast(ids) if row_count_up_to(ids, BROADCAST_IDS) <= BROADCAST_IDS else ids
    needed = texts.join(ids, "doc_id", "left_semi")
    one = likely.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(percent), "a long, b long"))


def _slots(sets: np.ndarray) -> np.ndarray:
    return (sets % np.uint64(SLOTS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for s in shingle_sets(batch.column(1)):
            np.add.at(counts, _slots(s), 1)
    full = np.flatnonzero(counts)
    for k in range(0, len(full), 1 << 16):
        part = full[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles over which a set can first meet one that is similar enough, and their places in the rare-first order.

    A shingle whose counter is 1 stands in no other set, so it takes a place but isn't returned.
    """
    n = counts[_slots(s)]
    order = np.lexsort((s, n))[: len(s) - -(-percent * len(s) // 100) + 1]
    place = np.flatnonzero(n[order] > 1)
    return s[order[place]], place


def _postings(counts, percent: int):
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                tokens, place = prefix(s, table, percent)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.full(len(tokens), node)), pa.array(np.full(len(tokens), len(s))), pa.array(place)], schema=schema)

    return run


def _crowd_pairs(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``crowd`` (node, component) across components that can be similar enough."""
    spark = crowd.sparkSession
    ids = F.broadcast(crowd) if row_count_up_to(crowd, BROADCAST_IDS) <= BROADCAST_IDS else crowd
    needed = cut(texts.join(ids, texts.doc_id == ids.node, "left_semi").select("doc_id", "text"))
    counted = needed.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    postings = needed.mapInArrow(_postings(spark.sparkContext.broadcast(table), percent), "token long, node long, size long, place long")
    postings = cut(postings.join(ids, "node"))
    shared = postings.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("token")
    postings = cut(postings.join(shared, "token"))
    x, y = (postings.select("token", *(F.col(c).alias(c + side) for c in ("node", "size", "place", "component"))) for side in "xy")
    reach = (100 + percent) * F.least(F.col("sizex") - F.col("placex"), F.col("sizey") - F.col("placey")) >= percent * (F.col("sizex") + F.col("sizey"))
    met = x.join(y, "token").where((F.col("nodex") < F.col("nodey")) & (F.col("componentx") != F.col("componenty")) & reach)
    return met.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts are linked where ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the
    smallest id that links reach.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, bands = shape(percent / 100)
    signed = cut(docs.mapInArrow(_signatures(rows, bands), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"))
    nodes = cut(signed.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = nodes.select("node", F.explode("bands").alias("key"))
    full = cut(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    buckets = cut(members.join(full, "key").select("key", "node", "size"))
    fullness = buckets.groupBy("node").agg(F.sum("size").alias("fullness"))
    ranked = buckets.join(fullness, "node").select("key", "node", "fullness")
    centres = cut(ranked.groupBy("key").agg(F.max_by("node", F.struct("fullness", -F.col("node"))).alias("centre")))
    stars = buckets.join(centres, "key").where("node != centre")
    tested = cut(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = _confirm(tested, nodes, docs, percent)
    named = cut(components(links, "a", "b"))

    owned = buckets.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    spread = owned.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    crowd = cut(owned.join(spread, "key", "left_semi").select("node", "component").distinct())
    if not crowd.isEmpty():
        met = cut(_crowd_pairs(crowd, docs, percent).join(tested, ["a", "b"], "left_anti"))
        more = _confirm(met, nodes, docs, percent)
        if not more.isEmpty():
            links = links.union(more)
            named = cut(components(links, "a", "b"))

    classes = cut(nodes.join(named, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component")))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
