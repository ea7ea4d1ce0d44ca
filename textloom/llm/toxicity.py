"""Toxicity: a support vector machine with a gapped subsequence kernel and Nyström landmarks.

Labels say whether a text is toxic, not where, so a text is a bag of tokens and scores as its most toxic one (a
multiple-instance machine); a sentence's score is the same over its own tokens.

Kernel of two tokens: the common subsequences of three letters within ``REACH`` letters, each occurrence weighing
``DECAY`` to the power of the letters that it spans, normalised to 1 for a token with itself. So an inserted or a
missing letter leaves most of the similarity. Before that, marks inside a token are taken out (``i.d-i*o.t``), letters
spelt out with blanks between are put together, and a token of several words joined by marks also counts by its words.
Letters are lower-cased; those beyond a-z share 35 classes; marks stand for the token's start and end.

Training, on a bounded sample (of the rows that may be learnt from, the ``SAMPLE`` of each label with the smallest hash
of their id): tokens that stand in toxic texts more often than chance allows are the first positive tokens, all tokens
of clean texts are negative; positives also come with one letter put in. The machine is trained on its Nyström features
(landmarks: the positives, and negatives drawn by hash), the negatives it scores highest are added, a few times
over. As the kernel is an inner product of counted
subsequences, the machine's sum over landmarks folds into one weight per subsequence, which gives the same score.

Score: a logistic function of the text's highest token score, centred where the tokens of the sample miss and hit least.

Defined cases: null and empty texts score as a text without any toxic token; repeated rows each get their row;
documents without labels are scored alike; repeated or contradicting labels count as each says; with nothing to learn
all scores are 0.01; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import crc_mod, tune

SAMPLE = 2500
REACH, DECAY, LONGEST = 6, 0.7, 24
LANDMARKS, ROUNDS, COST = 400, 3, 3000.0
#: Weight of a positive with a letter put in, against 1 of the token itself.
VARIANT = 0.3
CACHE = 400_000
ALPHABET, FIRST, LAST = 64, 62, 63

#: Offsets of the second and third letter of a subsequence.
TRIPLES = [(a, b) for b in range(2, REACH) for a in range(1, b)]

_LETTER = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _LETTER[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % 35
_MARKS = re.compile(r"[\W\d_]+")
_SPELT = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s){2,}\w(?!\w)")


def forms(token: str) -> list[str]:
    """What a token is compared as: its letters put together, its words, long ones in overlapping parts."""
    words = _MARKS.split(token)
    if len(words) == 1:
        found = words
    else:
        found = ["".join(words), *(w for w in words if 3 <= len(w) < len(token))]
    return [w[k : k + LONGEST] for w in found for k in (range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2) if len(w) > LONGEST else (0,))]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a lower-cased text, with letters spelt out one by one put together."""
    found = set(text.split())
    for m in _SPELT.finditer(text):
        found.add("".join(m.group().split()))
    return found


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised features of the words as (word, subsequence, value); words of under two letters have none."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 2:
            by_size.setdefault(len(w), []).append(i)
    rows, codes, values = [], [], []
    for n, at in by_size.items():
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.int64)
        letters = _LETTER[np.where(letters < len(_LETTER), letters, 0x100 + letters % 35)]
        letters = np.hstack([np.full((len(at), 1), FIRST), letters, np.full((len(at), 1), LAST)])
        index = np.array(at)
        for a, b in TRIPLES:
            m = n + 2 - b
            if m > 0:
                code = (letters[:, :m] * ALPHABET + letters[:, a : a + m]) * ALPHABET + letters[:, b:]
                rows.append(np.repeat(index, m))
                codes.append(code.ravel())
                values.append(np.full(code.size, DECAY ** (b + 1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(rows) * ALPHABET**3 + np.concatenate(codes)
    order = np.argsort(key, kind="stable")
    key, value = key[order], np.concatenate(values)[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value, key = np.add.reduceat(value, first), key[first]
    row = key // ALPHABET**3
    norm = np.sqrt(np.bincount(row, value * value, len(words)))
    return row, key % ALPHABET**3, value / norm[row]


def weigh(words: list[str], weights: np.ndarray, block: int = 20_000) -> np.ndarray:
    """The machine's sum over landmarks for each word: the inner product with its folded weights."""
    out = np.zeros(len(words))
    for k in range(0, len(words), block):
        part = words[k : k + block]
        row, code, value = subsequences(part)
        out[k : k + block] = np.bincount(row, value * weights[code], len(part))
    return out


class Landmarks:
    """Landmark tokens by the subsequences that they hold; others don't touch the kernel."""

    def __init__(self, words: list[str]) -> None:
        row, code, value = subsequences(words)
        self.codes, at = np.unique(code, return_inverse=True)
        self.place = np.full(ALPHABET**3, -1)
        self.place[self.codes] = np.arange(len(self.codes))
        self.matrix = np.zeros((len(words), len(self.codes)), np.float32)
        self.matrix[row, at] = value

    def kernel(self, words: list[str], block: int = 500) -> np.ndarray:
        out = np.zeros((len(words), len(self.matrix)), np.float32)
        for k in range(0, len(words), block):
            part = words[k : k + block]
            row, code, value = subsequences(part)
            x = np.zeros((len(part), len(self.codes)), np.float32)
            known = self.place[code] >= 0
            x[row[known], self.place[code[known]]] = value[known]
            out[k : k + block] = x @ self.matrix.T
        return out

    def folded(self, beta: np.ndarray) -> np.ndarray:
        """One weight per subsequence for a sum over landmarks."""
        weights = np.zeros(ALPHABET**3)
        weights[self.codes] = self.matrix.T @ beta
        return weights


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes weighing the same; accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    s = np.where(y, 1.0, -1.0)
    c = weight * np.where(y, 0.5 / weight[y].sum(), 0.5 / weight[~y].sum()) * COST
    rate = 1 / (1 + 2 * np.linalg.norm((x * np.sqrt(c)[:, None]).T @ (x * np.sqrt(c)[:, None]), 2))
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - s * (x @ ahead))
        new = ahead - rate * (ahead - 2 * x.T @ (c * s * slack))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def variants(word: str) -> list[str]:
    """The word with one letter put in, at places and of letters that depend on the word alone."""
    rng = np.random.default_rng(list(word.encode()))
    out = [word]
    if len(word) >= 5:
        for k in rng.choice(np.arange(1, len(word)), 2, replace=False).tolist():
            out.append(word[:k] + chr(97 + int(rng.integers(26))) + word[k:])
    return out


class Model:
    """Folded weights, and the centre and slope of the score."""

    def __init__(self, weights: np.ndarray | None = None, centre: float = 0.0, slope: float = 0.0) -> None:
        self.weights, self.centre, self.slope = weights, centre, slope

    def probability(self, best: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(best), 0.01)
        return 1 / (1 + np.exp(-np.clip(self.slope * (best - self.centre), -30, 30)))


def learn(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> Model:
    """counts: by token, the toxic and the clean texts that it stands in."""
    joined: dict[str, list[int]] = {}
    for token, (a, b) in counts.items():
        for form in forms(token)[:1]:
            if len(form) >= 3:
                x = joined.setdefault(form, [0, 0])
                x[0] += a
                x[1] += b
    words = sorted(joined)
    toxic, clean = np.array([joined[w][0] for w in words], int), np.array([joined[w][1] for w in words], int)
    if not n_toxic or not n_clean or not len(words):
        return Model()
    total, q = toxic + clean, n_toxic / (n_toxic + n_clean)
    met = np.bincount(total)
    chance = np.array([met[t] for t in total]) * q ** total.astype(float)  # of that many texts, tokens in toxic ones alone
    positive = (clean == 0) & (chance < 0.05)
    positive |= (total >= 20) & (toxic / np.maximum(1, total) > max(0.9, 1 - (1 - q) / 10))
    if not positive.any():
        return Model()
    negative = np.flatnonzero(clean > 0)
    draw = np.array([hash_of(w) for w in words])
    negative = negative[np.argsort(draw[negative])]
    hard = negative[:4000]
    weights, bias, values = None, 0.0, None
    for turn in range(ROUNDS):
        chosen = [words[i] for i in np.flatnonzero(positive)]
        grown = [(v, 1.0 if v == w else VARIANT) for w in chosen for v in variants(w)]
        marks = Landmarks([*sorted(chosen, key=hash_of)[: LANDMARKS // 2], *(words[i] for i in hard[-(LANDMARKS // 2) :])])
        size, axes = np.linalg.eigh((marks.matrix @ marks.matrix.T).astype(np.float64))
        root = axes / np.sqrt(np.maximum(size, 1e-5)) * (size > 1e-5)  # the landmarks' kernel to the power -1/2
        taught = [*(v for v, _ in grown), *(words[i] for i in hard)]
        y = np.arange(len(taught)) < len(grown)
        w, bias = machine(marks.kernel(taught) @ root, y, np.array([*(x for _, x in grown), *np.ones(len(hard))]))
        weights = marks.folded(root @ w)
        values = weigh(words, weights) + bias
        if turn < ROUNDS - 1:
            worst = negative[np.argsort(-values[negative])][:2000]
            hard = np.unique(np.concatenate([negative[:4000], worst]))
            hard = hard[np.argsort(values[hard])]
    # centre: where the share of toxic texts missed and that of clean texts hit, by their tokens, is least
    order = np.argsort(-values)
    missed = 1 - np.cumsum((toxic * positive)[order]) / max(1, (toxic * positive).sum())
    false = np.cumsum(clean[order]) / n_clean
    cost = missed + 2 * false
    k = int(np.argmin(cost))
    last = int(np.flatnonzero(cost <= cost[k] + 1e-12)[-1])
    above, below = float(values[order[k]]), float(values[order[min(len(order) - 1, last + 1)]])
    centre = max(below + 0.5 * (above - below), above - 0.3)
    return Model(weights, centre - bias, 4 / max(0.05, float(np.median(values[positive])) - centre))


def hash_of(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 1000003 ^ ord(c)) & 0xFFFFFFFFFFFF
    return (h * 0x9E3779B97F4A7C15 >> 16) & 0xFFFFFFFF


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), rows of folds 1 to 4 of 5."""
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", (F.col("toxic") > 0).alias("toxic")).distinct()
    may = may.withColumn("draw", F.xxhash64("doc_id"))
    ids = None
    for kind in (True, False):
        part = may.where(F.col("toxic") == kind).orderBy("draw", "doc_id").limit(sample)
        ids = part if ids is None else ids.unionAll(part)
    rows = ids.collect()  # at most two times the sample
    n_toxic, n_clean = sum(r.toxic for r in rows), sum(not r.toxic for r in rows)
    if not n_toxic or not n_clean:
        return Model()
    spark = docs.sparkSession
    small = spark.createDataFrame([(r.doc_id, r.toxic) for r in rows], "doc_id long, toxic boolean")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(small), "doc_id")
    each = texts.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("token")).where("token != ''")
    found = each.groupBy("token").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    return learn({r.token: (r.a, r.b) for r in found.toLocalIterator()}, n_toxic, n_clean)  # bounded by the sample


class Scorer:
    """Token scores in a bounded table."""

    def __init__(self, model: Model, cache: int = CACHE) -> None:
        self.model, self.most, self.kept = model, cache, {}

    def best(self, texts: list[str]) -> np.ndarray:
        """The highest token score of each text."""
        bags = [tokens(t) for t in texts]
        fresh = list(set().union(*bags) - self.kept.keys()) if bags else []
        if fresh and len(self.kept) + len(fresh) > self.most:
            self.kept.clear()
            fresh = list(set().union(*bags))
        if fresh:
            parts = [(form, i) for i, t in enumerate(fresh) for form in forms(t)]
            of = np.array([i for _, i in parts], np.int64)
            values = weigh([form for form, _ in parts], self.model.weights)
            out = np.full(len(fresh), -9.0)
            np.maximum.at(out, of, values)
            self.kept.update(zip(fresh, out.tolist()))
        get = self.kept.__getitem__
        return np.array([max(map(get, bag), default=-9.0) for bag in bags])


def _predictor(model: Model):
    held: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Scorer(model))
        for batch in batches:
            texts, scores = batch.column(2).to_pylist(), []
            for k in range(0, len(texts), 200):
                part = [(x or "").lower() for x in texts[k : k + 200]]
                best = held[0].best(part) if model.weights is not None else np.zeros(len(part))
                scores += model.probability(best).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
