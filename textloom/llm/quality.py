"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

1. Each labeller looks at one trait of a text and votes good, bad or nothing. One pass over all documents makes the
   vote pattern of each; patterns are counted over all documents (there are at most 3 ** len(LABELLERS) of them).
2. Expectation-maximisation over the counted patterns estimates the share of good documents and each labeller's votes
   given the class, so labellers that agree with the others weigh more. No label of any person is used.
3. A logistic scorer over hashed features (runs of byte classes, repeated words) learns the posteriors of a bounded
   sample: the ``SAMPLE`` documents with the smallest hash of their id. All documents are then scored by it.

``score`` is the scorer's probability of good; a document is kept if it is at least ``KEEP``.

Defined cases: a text without words, or null, has score 0 and isn't kept; repeated rows each get their row and count as
often; with fewer than two patterns, or an empty table, the scorer is flat and every text with words is kept; texts
score the same in any order, as sample and counts don't depend on it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import blocks, cut, text_buffers, tune

#: Documents that the scorer learns from; hashed features of each kind of run; least score that is kept.
SAMPLE, RUN_DIMS, KEEP = 4000, 2048, 0.5
#: Share of good documents that one labeller may call bad, at most. Without it, labellers that look at the same trait
#: outvote one that alone sees another.
FALSE_ALARM = 0.002
RUNS, GAPS = (2, 4), 8
DIMS = len(RUNS) * RUN_DIMS + GAPS
GOOD, BAD, NONE = 1, 2, 0

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_MARKUP = np.zeros(256, bool)
_MARKUP[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?,;:"]] = True

#: Classes of bytes: letters by case, digits, all of non-ASCII, space, line feed; each ASCII mark is its own.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0x61, 0x41, 0x30, 0x61

LABELLERS = ("symbols", "capitals", "shouting", "stutter", "fields", "variety", "word length", "stops", "repeated lines")


def _between(x: np.ndarray, good: np.ndarray, bad: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known & bad, BAD, np.where(known & good, GOOD, NONE))


def votes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the labellers (rows by labeller), and words, for each row of a block of texts."""
    words, starts, first = H.words(data, offsets, H.NON_SPACE)
    n = np.diff(first)
    some = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per_word(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[first[1:]] - total[first[:-1]]).astype(float)

    solid, letters = np.maximum(share(H.NON_SPACE[data]), 1), np.maximum(share(_LETTER[data]), 1)
    ascii_letters = np.maximum(share(_LETTER[data] & (data < 0x80)), 1)
    marks, capitals = share(_MARKUP[data]) / solid, share(_UPPER[data]) / ascii_letters
    shout = np.zeros(len(data), bool)
    shout[1:] = (data[1:] == 0x21) & (data[:-1] == 0x21)
    shouts = share(shout) / some
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][n > 0]] = False
    stutter = per_word(same) / some
    bars = share((data == 0x7C) | (data == 0x09)) / some
    stops = share(_STOP[data]) / some
    variety, lines = np.ones(len(n)), np.zeros(len(n))
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= 50:  # distinct words of runs of 100, as the share falls with a text's length; the last run ends with it
            size = min(100, b - a)
            at = [*range(a, b - size, size), b - size]
            variety[k] = sum(len(set(words[i : i + size].tolist())) for i in at) / (size * len(at))
        rows = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
        if len(rows) >= 4:
            lines[k] = 1 - len(set(rows)) / len(rows)
    length = solid / some
    enough = n >= 8
    out = [
        _between(marks, marks < 0.02, marks > 0.08, n > 0),
        _between(capitals, capitals < 0.15, capitals > 0.5, ascii_letters >= 20),
        _between(shouts, shouts == 0, shouts > 0.15, n > 0),
        _between(stutter, stutter < 0.05, stutter > 0.3, enough),
        _between(bars, bars == 0, bars > 0.15, enough),
        _between(variety, variety > 0.45, variety < 0.25, n >= 50),
        _between(length, (length > 2.5) & (length < 11), (length > 14) | (length < 1.6), enough),
        _between(stops, (stops > 0.02) & (stops < 0.4), stops > 0.8, enough & (letters > 0)),
        _between(lines, lines < 0.2, lines > 0.5, n >= 8),
    ]
    return np.array(out), n


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed features of each row: square roots of the shares of byte-class runs and of repeats among words."""
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    classes = _CLASS[data]
    codes = []
    for size in RUNS:
        with np.errstate(over="ignore"):
            code = classes[: max(0, len(data) - size + 1)] * H._GRAM[40]
            for j in range(1, size):
                code += classes[j : j + len(code)] * H._GRAM[40 + j]
            code *= H._GRAM[50]
        codes.append((code >> np.uint64(53)).astype(np.int64))  # 2048 leading values: multiply-shift hashing
    words, _, first = H.words(data, offsets, H.NON_SPACE)
    for k in range(len(out)):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for r, (size, code) in enumerate(zip(RUNS, codes, strict=True)):
            if b - a >= size:
                out[k, r * RUN_DIMS : (r + 1) * RUN_DIMS] = np.bincount(code[a : b - size + 1], minlength=RUN_DIMS) / (b - a)
        w = words[first[k] : first[k + 1]]
        for gap in range(1, min(GAPS + 1, len(w))):
            out[k, -gap] = np.count_nonzero(w[gap:] == w[:-gap]) / (len(w) - gap)
    np.sqrt(out, out)
    size = np.diff(offsets)[:, None]
    return out / np.maximum(1e-9, np.sqrt((out * out).sum(1, keepdims=True))) * (size / (size + 16.0))  # a few bytes say little


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each vote pattern, by expectation-maximisation from the majority vote."""
    counts = counts.astype(float)
    for_good, for_bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    p = np.where(for_bad > 0, 0.05, np.where(for_good > 0, 0.95, 0.7))
    for _ in range(rounds):
        prior = ((counts * p).sum() + 1) / (counts.sum() + 2)
        log_good, log_bad = np.full(len(p), np.log(prior)), np.full(len(p), np.log(1 - prior))
        for j in range(patterns.shape[1]):
            spoke = patterns[:, j] != NONE  # no vote says nothing about the class
            at = patterns[:, j] == BAD
            false = min(FALSE_ALARM, ((counts * p)[at].sum() + 0.5) / ((counts * p)[spoke].sum() + 1))
            true = ((counts * (1 - p))[at].sum() + 0.5) / ((counts * (1 - p))[spoke].sum() + 1)
            true = min(max(true, 10 * false), 0.99)
            log_good += np.where(at, np.log(false), np.where(spoke, np.log(1 - false), 0))
            log_bad += np.where(at, np.log(true), np.where(spoke, np.log(1 - true), 0))
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        moved, p = float(np.abs(new - p).max()), new
        if moved < 1e-6:
            break
    return p


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 500, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer of soft labels; Adam."""
    if not len(y) or min(y.sum(), (1 - y).sum()) < 0.5:
        return np.append(np.zeros(DIMS), 1.0)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (p - y).astype(np.float32) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        codes = []
        for i, j in blocks(offsets):
            cast, n = votes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            codes += np.where(n > 0, base @ cast, -1).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["draw", "pattern"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        packed, codes = [], []
        base = 3 ** np.arange(len(LABELLERS))
        for i, j in blocks(offsets):
            part, its = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            packed += [row.astype(np.float16).tobytes() for row in features(part, its)]
            codes += (base @ votes(part, its)[0]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(packed, pa.binary())], names=["pattern", "packed"])


def _scorer(weights: np.ndarray):
    w = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            scores = []
            for i, j in blocks(offsets, 1 << 19):
                part, its = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                p = 1 / (1 + np.exp(-np.clip(features(part, its) @ w[:-1] + w[-1], -30, 30)))
                total = np.concatenate([[0], np.cumsum(H.NON_SPACE[part])])
                scores += np.where(total[its[1:]] > total[its[:-1]], p, 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer, learnt from ``docs`` (doc_id, text) as described above."""
    tune(docs.sparkSession)
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("draw"), F.col("text").cast("string").alias("text"))
    voted = cut(texts.mapInArrow(_vote_batches, "draw long, pattern long").where("pattern >= 0"))
    rows = voted.groupBy("pattern").count().collect()
    if len(rows) < 2:
        return np.append(np.zeros(DIMS), 1.0)
    codes = np.array([r[0] for r in rows])
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    posterior = dict(zip(codes.tolist(), fit_labellers(patterns, np.array([r[1] for r in rows])).tolist(), strict=True))
    last = voted.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    # equal ids give equal draws, so rows at the last draw are bounded once more
    taken = texts.where(F.col("draw") <= last).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).mapInArrow(_feature_batches, "pattern long, packed binary").limit(sample).collect()
    x = np.array([np.frombuffer(r.packed, np.float16) for r in taken], np.float32).reshape(-1, DIMS)
    y = np.array([posterior.get(r.pattern, 0.5) for r in taken])
    return fit_scorer(x, y)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows (doc_id, score, kept) for every row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(weights), "doc_id long, score double").withColumn("kept", F.col("score") >= KEEP)


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are."""
    weights = train(docs)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(_scorer(weights), own.select("own", F.lit(0.0).cast("double").alias("score")).schema)
    return scored.where(F.col("score") >= KEEP).select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])
