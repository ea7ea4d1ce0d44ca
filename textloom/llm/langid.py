"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary (the letter pieces of a public sentencepiece model,
lower-cased as they are; it is read, not trained). A word is a longest run of letters, lower-cased, with a word-start
mark; its probability is the sum over all ways to cut it into pieces, by a forward algorithm. A letter that is no piece
counts as one of ``UNKNOWN`` probability. Words of any length are scored whole: the forward sums are rescaled on the way
and only those that the longest piece reaches back to are kept. A text's score sums the logarithms of its words over the
whole text.

Piece probabilities are learnt by expectation-maximisation (forward-backward over the same cuts) from the words of a
bounded sample: of each language's rows that may be learnt from, the ``SAMPLE`` with the smallest hash of their id (one
text of those with the same hash); there, words longer than ``LETTERS`` are learnt in parts of that length. Distinct
words are scored once per worker while they are in a table of at most ``CACHE`` words (and 20 times as many letters), all
of a batch's new ones together.

Defined cases: a text that is null or has no letter gets ``und`` and score 0; ties go to the language first in order;
with nothing to learn from every text gets ``und``; repeated rows each get their row; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import hashing as H
from textloom.llm.common import crc_mod, tune

SAMPLE, ROUNDS = 500, 4
LETTERS = 30
UNKNOWN, SMOOTH = 1e-7, 0.05
CACHE = 300_000
START = "▁"
#: Letters whose pieces are looked up at once, and letters between two rescalings.
SPAN, RESCALE = 2048, 8


class Vocabulary:
    """The letter pieces of a sentencepiece model, findable by hash."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        body = lambda p: p[1:] if p.startswith(START) else p
        self.pieces = sorted(p for p in pieces if p == START or (body(p).isalpha() and p == p.lower()))
        self.longest = max(map(len, self.pieces))
        hashes = np.array([_piece_hash(p) for p in self.pieces], np.uint64)
        sizes = np.array([len(p) for p in self.pieces])
        self.by_size = {}
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(hashes[at])]
            self.by_size[size] = hashes[at], at

    def find(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Index of the piece of that many letters for each hash, or -1; -2 for a letter that is no piece."""
        ordered, ids = self.by_size[size]
        none = -2 if size == 1 else -1
        if not len(ordered):
            return np.full(hashes.shape, none)
        at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
        return np.where(ordered[at] == hashes, ids[at], none)


def _piece_hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


def _cuts(vocabulary: Vocabulary, codes: np.ndarray) -> dict[int, np.ndarray]:
    """For words of one length (with mark): by size, the piece (or -1) at each start; unknown letters are -2."""
    n = codes.shape[1]
    out, rolled = {}, None
    with np.errstate(over="ignore"):
        for size in range(1, min(vocabulary.longest, n) + 1):
            last = codes[:, size - 1 :]
            rolled = last.copy() if rolled is None else rolled[:, : n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + last
            out[size] = vocabulary.find(rolled, size)
    return out


def _forward(cuts: dict[int, np.ndarray], table: np.ndarray, n: int) -> np.ndarray:
    """alpha[j]: probability of the first j letters of each (short) word. table: pieces + none + unknown."""
    alpha = np.zeros((n + 1, len(cuts[1])))
    alpha[0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(len(cuts), end) + 1):
            alpha[end] += alpha[end - size] * table[cuts[size][:, end - size]]
    return alpha


def log_sums(vocabulary: Vocabulary, words: list[str], table: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all cuts of each word, by language, for words of one length, whatever that is."""
    codes, g = _codes(words), table.shape[1]
    n = codes.shape[1]
    reach = min(vocabulary.longest, n)
    logs, last = np.zeros((len(words), g)), np.zeros((reach, len(words), g))
    last[-1] = 1
    for low in range(0, n, SPAN):
        high, base = min(n, low + SPAN), max(0, low - reach + 1)
        # piece of reach - k letters that ends after letter low + e + 1, at [e, k]
        ids = np.full((high - low, reach, len(words)), -1, np.int32)
        for size, found in _cuts(vocabulary, codes[:, base:high]).items():
            skip = max(0, low + 1 - size - base)
            ids[base + skip + size - low - 1 :, reach - size] = found[:, skip:].T
        sums = np.zeros((reach + high - low, len(words), g))
        sums[:reach] = last
        for e in range(high - low):
            sums[reach + e] = (sums[e : reach + e] * table[ids[e]]).sum(0)
            if e % RESCALE == RESCALE - 1:
                near = sums[e + 1 : reach + e + 1]
                most = near.max(0)
                near /= most
                logs += np.log(most)
        last = sums[-reach:]
    return logs + np.log(last[-1])


def _padded(probabilities: np.ndarray) -> np.ndarray:
    """Rows for the indexes -2 (an unknown letter) and -1 (no piece) at the end."""
    g = probabilities.shape[1]
    return np.vstack([probabilities, np.full((1, g), UNKNOWN), np.zeros((1, g))])


def by_length(words: list[str], most: int = 100_000) -> Iterator[list[int]]:
    """Indexes of words in groups of one length, of about ``most`` letters together."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, g in groups.items():
        step = max(1, most // n)
        yield from (g[k : k + step] for k in range(0, len(g), step))


def parts_of(word: str) -> list[str]:
    """A word with its mark, in parts of at most ``LETTERS`` letters."""
    return [START + word] if len(word) <= LETTERS else [START + word[:LETTERS], *(word[k : k + LETTERS] for k in range(LETTERS, len(word), LETTERS))]


def learn(vocabulary: Vocabulary, counted: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces by language), from word counts of each language."""
    languages = sorted(counted)
    columns = []
    for language in languages:
        counts: Counter[str] = Counter()
        for word, n in counted[language].items():
            for part in parts_of(word):
                counts[part] += n
        words = list(counts)
        weight = np.array([counts[w] for w in words], float)
        groups = [(g, _cuts(vocabulary, _codes([words[i] for i in g])), len(words[g[0]])) for g in by_length(words)]
        p = np.full(len(vocabulary.pieces), 1 / len(vocabulary.pieces))
        for _ in range(ROUNDS):
            expected, table = np.zeros(len(p) + 2), _padded(p[:, None])[:, 0]
            for g, cuts, n in groups:
                alpha = _forward(cuts, table, n)
                beta = np.zeros_like(alpha)
                beta[n] = 1
                for start in range(n - 1, -1, -1):
                    for size in range(1, min(len(cuts), n - start) + 1):
                        beta[start] += table[cuts[size][:, start]] * beta[start + size]
                scale = weight[g] / alpha[n]
                for size, ids in cuts.items():
                    for start in range(n - size + 1):
                        use = alpha[start] * table[ids[:, start]] * beta[start + size] * scale
                        expected += np.bincount(ids[:, start] % len(expected), use, len(expected))
            kept = expected[:-2] + SMOOTH
            p = kept / (kept.sum() + expected[-2])
        columns.append(p)
    return languages, np.array(columns).T if columns else np.zeros((len(vocabulary.pieces), 0))


class Scorer:
    """Log-probabilities of words per language, kept in a bounded table."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray, cache: int = CACHE) -> None:
        self.vocabulary, self.table, self.most = vocabulary, _padded(table), cache
        self.rows: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((0, table.shape[1]))

    def new(self, words: list[str]) -> np.ndarray:
        marked = [START + w for w in words]
        out = np.zeros((len(words), self.table.shape[1]))
        for g in by_length(marked):
            out[g] = log_sums(self.vocabulary, [marked[i] for i in g], self.table)
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """Sums over the words (between blanks) of each text."""
        split = [t.split() for t in texts]
        fresh = list({w for words in split for w in words if w not in self.rows})
        if fresh and (len(self.rows) + len(fresh) > self.most or self.letters > 20 * self.most):
            self.rows, self.scores, self.letters = {}, self.scores[:0], 0
            fresh = list({w for words in split for w in words})
        if fresh:
            self.rows.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.letters += sum(map(len, fresh))
            self.scores = np.vstack([self.scores, self.new(fresh)])
        return np.array([self.scores[[self.rows[w] for w in words]].sum(0) if words else np.zeros(self.scores.shape[1]) for words in split]).reshape(len(texts), -1)


@functools.lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def letters(text: str = "text"):
    """Lower-cased letter runs between single blanks."""
    return F.lower(F.regexp_replace(F.col(text), r"\P{L}+", " "))


def train(docs: DataFrame, path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Learn from ``docs`` (doc_id, text, lang): rows of folds 0, 1 and 3 of 4 with a language, ``sample`` of each."""
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    may = may.select("lang", F.xxhash64(F.col("doc_id").cast("long")).alias("draw"), "text")
    # one row a document in the ranking, which keeps no more than the sample's of each task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = may.select("lang", "draw").distinct().withColumn("rank", rank).where(F.col("rank") <= sample)
    last = drawn.groupBy("lang").agg(F.max("draw").alias("last"))
    taken = may.join(last, "lang").where(F.col("draw") <= F.col("last")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    words = taken.select("lang", F.explode(F.split(letters(), " ")).alias("word")).where("word != ''")
    counted: dict[str, dict[str, int]] = {}
    for r in words.groupBy("lang", "word").count().collect():
        counted.setdefault(r.lang, {})[r.word] = r[2]
    return learn(_vocabulary(path), counted)


def _predictor(path: str, languages: list[str], table: np.ndarray):
    held: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Scorer(_vocabulary(path), table))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = [], []
            for k in range(0, len(texts), 200):
                part = [x or "" for x in texts[k : k + 200]]
                sums = held[0].texts(part) if languages else np.zeros((len(part), 1))
                best = sums.argmax(1)
                share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for text, b, s in zip(part, best.tolist(), share.tolist(), strict=True):
                    known = bool(languages) and not (not text or text.isspace())
                    names.append(languages[b] if known else "und")
                    scores.append(s if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), letters().alias("letters"))
    return rows.mapInArrow(_predictor(path, *model), "doc_id long, held_out boolean, lang_pred string, score double")
