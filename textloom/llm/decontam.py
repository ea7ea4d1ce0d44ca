"""Benchmark decontamination by winnowing.

Words are longest runs of ASCII letters and digits and of all non-ASCII characters, after lower-casing A-Z. A window is
``SPAN`` consecutive words of an item; an item with fewer words is one window. Every word of a document inside an
occurrence of a window is hit.

Both sides hash all runs of ``GRAM`` words and keep the smallest hash of each ``SPAN - GRAM + 1`` runs in a row (of
equal ones the last). The choice depends on those words alone, so any ``SPAN`` words shared by a document and an item
keep the same fingerprint on both sides. Fingerprints are joined; each hit is extended to the left and the right, word
by word, and counts where the shared run reaches ``SPAN`` words. Items with fewer words are met whole: their one hash
is joined with the document's runs of that many words.

The benchmark is the stated query set: it is dealt into blocks of at most ``BLOCK_CHARS`` characters (or one item),
however large it is, and each block is broadcast to one pass over the documents, whose texts are never shuffled. One
block is on the driver at a time. Hit ranges of several blocks are merged by document.

Defined cases: null or empty texts have no words and no hit; items without words, or with a null id, have no window;
repeated items with one id count once; repeated document rows each get their row; empty tables give empty results or
no hits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import blocks, cut, text_buffers, tune

SPAN, GRAM = 10, 5
#: Characters of benchmark text that one pass over the documents carries to each worker.
BLOCK_CHARS = 16 << 20


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints of one text: for each ``window`` runs in a row the last of the smallest."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        smaller = grams[j : j + n] <= best
        best[smaller] = grams[j : j + n][smaller]
        at[smaller] = np.flatnonzero(smaller) + j
    return np.unique(at)


class Items:
    """Fingerprints and words of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        self.words, _, self.first = H.words(H.LOWER[data], offsets, H.ALNUM)
        self.ids = ids
        found: list[tuple[int, int, int]] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            if b - a >= SPAN:
                grams = H.grams(self.words[a:b], GRAM)
                found += [(int(grams[p]), a + p, k) for p in winnow(grams, SPAN - GRAM + 1).tolist()]
            elif b > a:
                self.short.setdefault(b - a, {}).setdefault(int(H.grams(self.words[a:b], b - a)[0]), []).append(k)
        found.sort()
        self.hashes = np.array([x for x, _, _ in found], np.uint64)
        self.at = np.array([x for _, x, _ in found], np.int64)
        self.of = np.array([x for _, _, x in found], np.int64)
        self.keys = {m: np.array(sorted(x), np.uint64) for m, x in self.short.items()}

    def hits(self, words: np.ndarray, grams: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words of one document (they may overlap) and the items with an occurring window."""
        ranges, items = [], set()
        if len(words) >= SPAN and len(self.hashes):
            own = winnow(grams, SPAN - GRAM + 1)
            left = np.searchsorted(self.hashes, grams[own], "left")
            right = np.searchsorted(self.hashes, grams[own], "right")
            runs: dict[tuple[int, int], int] = {}  # of an item and a diagonal: where the last run ended
            for k in np.flatnonzero(right > left).tolist():
                p = int(own[k])
                for i in range(int(left[k]), int(right[k])):
                    q, item = int(self.at[i]), int(self.of[i])
                    if p < runs.get((item, p - q), -1):
                        continue
                    a, b = self.extended(words, p, q, int(self.first[item]), int(self.first[item + 1]))
                    runs[item, p - q] = b
                    if b - a >= SPAN:
                        ranges.append((a, b))
                        items.add(self.ids[item])
        for m, keys in self.keys.items():
            if len(words) >= m:
                own = H.grams(words, m)
                for p in np.flatnonzero(np.isin(own, keys)).tolist():
                    ranges.append((p, p + m))
                    items.update(self.ids[k] for k in self.short[m][int(own[p])])
        return ranges, items

    def extended(self, words: np.ndarray, p: int, q: int, low: int, high: int) -> tuple[int, int]:
        """The longest shared run through document word ``p`` and item word ``q``, as document words."""
        n = min(p - 0, q - low)
        back = words[p - n : p][::-1] != self.words[q - n : q][::-1]
        before = int(np.argmax(back)) if back.any() else n
        n = min(len(words) - p, high - q)
        ahead = words[p : p + n] != self.words[q : q + n]
        return p - before, p + (int(np.argmax(ahead)) if ahead.any() else n)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges that cover the same words, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "doc_id long, row long, n_words long, ranges array<struct<a:long,b:long>>, items array<long>"
_DIGESTS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scan(block: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([i for i, _ in block], [t for _, t in block])
        for batch in batches:
            sizes, ranges, found = [], [], []
            data, offsets = text_buffers(batch.column(2))
            data = H.LOWER[data]
            for i, j in blocks(offsets):
                words, _, first = H.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], H.ALNUM)
                grams = H.grams(words, GRAM)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    hit, which = items.hits(words[a:b], grams[a : max(a, b - GRAM + 1)])
                    sizes.append(b - a)
                    ranges.append([{"a": x, "b": y} for x, y in merged(hit)])
                    found.append(sorted(which))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ranges, _RANGES), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "ranges", "items"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [sum(b - a for a, b in merged([(x["a"], x["b"]) for x in r])) for r in batch.column(2).to_pylist()]
        items = [sorted({str(x) for x in r}) for r in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hit])],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _scan_and_digest(block: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest(x.select(["doc_id", "n_words", "ranges", "items"]) for x in _scan(block)(batches))

    return run


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``chars`` characters (or one item); one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row.text) > chars:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    blocks_of = item_blocks(benchmark, chars)
    first, second = next(blocks_of, []), next(blocks_of, None)
    if second is None:  # one function: each Python function of a task takes a worker, which stays with its memory
        return docs.mapInArrow(_scan_and_digest(first), _DIGESTS)
    # each pass is written before the next block is read; rows are told apart by text as well, as ids may repeat
    docs = docs.withColumn("row", F.xxhash64("text"))
    scans = [cut(docs.mapInArrow(_scan(block), _HITS)) for block in itertools.chain([first, second], blocks_of)]
    hits = scans[0]
    for scan in scans[1:]:
        hits = hits.unionAll(scan)
    grouped = hits.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"), F.count("*").alias("copies"))
    copies = F.expr(f"explode(sequence(1, cast(copies / {len(scans)} as int)))")
    hits = grouped.select("doc_id", "row", "n_words", "ranges", "items", copies.alias("copy"))
    return hits.select("doc_id", "n_words", "ranges", "items").mapInArrow(_digest, _DIGESTS)
