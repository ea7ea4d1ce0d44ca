"""Byte-level BPE over content-defined chunks, each encoded once and reused by every text of a worker that holds it.

The vocabulary is a public one: a ``tokenizer.json`` of kind BPE with the byte-level pre-tokeniser; it is read, never
trained. A text is cut where a rolling hash of its last ``WINDOW`` bytes has ``ZEROS`` low zero bits, moved on to the
next place where a non-space is followed by white space. There every pre-token ends whatever surrounds it, so the ids
of the two sides join without change. Where no such place follows within ``REACH`` bytes (scripts without spaces, long
runs), the cut stays where the hash put it; then the join is repaired: the pre-tokens around it are encoded again,
together, from the last place in the left and to the first in the right where a pre-token surely ends, and the ids
outside must then agree with those that the chunks gave alone. A chunk's ids are kept under its bytes in a table of at most ``CACHE_BYTES``; when full it is emptied, so memory
is bounded and results don't depend on it. A new chunk is put together from a bounded table of words where its spaces
all follow non-spaces, for the same reason as above.

Strings of special tokens inside a text become their ids, as the tokenizers library does by default; they cut the text
before anything else.

Defined cases: null and empty texts give no ids and the empty text; repeated rows each get their row; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import hashing as H
from textloom.llm.common import text_buffers, tune

WINDOW, ZEROS, REACH = 8, 9, 512
#: Entries of the table of words, and bytes of a word in it.
WORDS, WORD_BYTES = 200_000, 64
CACHE_BYTES = 48 << 20

#: The byte-level pre-tokeniser's pattern, fixed by the vocabulary format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = ~H.NON_SPACE

#: A space after what is a space, or could be one.
UNSURE_SPACE = re.compile(rb"(?:[\x00-\x20\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe2[\x80\x81][\x80-\xaf]|\xe3\x80\x80) ")


def packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Space to some definitions and not to others; never an anchor.
_UNSURE = frozenset("\x1c\x1d\x1e\x1f\x85")


@functools.lru_cache(1 << 16)
def _kind(c: str) -> int:
    return 0 if c.isspace() else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3


def sure_end(c: str, d: str) -> bool:
    """Whether a pre-token ends between the characters ``c`` and ``d`` whatever stands around them."""
    return c != "'" and c not in _UNSURE and d not in _UNSURE and _kind(c) != 0 and _kind(c) != _kind(d)


class Codec:
    """Encoder and decoder of one vocabulary; one is made in each worker."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        # ids follow the order of merges in this kind of vocabulary, so they serve as ranks
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.steady = Tokenizer.from_file(path)
        self.bytes = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.special_bytes = [x.encode() for x in self.special]
        listed = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.size = np.array([len(x) for x in listed])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(listed), np.uint8)
        self.kept: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.held, self.most, self.encoded = 0, cache_bytes, 0

    def cuts(self, data: np.ndarray) -> tuple[list[int], list[bool]]:
        """Where a text's bytes are cut, and whether a join there needs no repair."""
        n = len(data)
        if n < 4 * WINDOW:
            return [], []
        x = H._BYTE[data]
        with np.errstate(over="ignore"):
            rolled = x[WINDOW - 1 :].copy()
            for j in range(1, WINDOW):
                rolled += x[WINDOW - 1 - j : n - j] * H._GRAM[j]
        want = np.flatnonzero((H.mix(rolled) & np.uint64((1 << ZEROS) - 1)) == 0) + WINDOW
        space = _SPACE[data]
        safe = np.flatnonzero(space[1:] & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
        after = np.append(safe, n + REACH)[np.searchsorted(safe, want)]
        out: dict[int, bool] = {}
        for w, s in zip(want.tolist(), after.tolist(), strict=True):
            if s - w <= REACH and s < n:
                out[s] = True
            else:
                while w < n and data[w] & 0xC0 == 0x80:  # never inside a character
                    w += 1
                if w < n:
                    out.setdefault(w, False)
        places = sorted(out)
        return places, [out[p] for p in places]

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a chunk that starts and ends at a cut, packed as 32-bit integers; made once while they are kept."""
        ids = self.kept.get(raw)
        if ids is None:
            ids = self._fresh(raw)
            self.encoded += len(raw)
            self.held += len(raw) + len(ids) + 200
            if self.held > self.most:
                self.kept.clear()
                self.held = len(raw) + len(ids) + 200
            self.kept[raw] = ids
        return ids

    def _fresh(self, raw: bytes) -> bytes:
        """A chunk in which each space follows a non-space is encoded by what stands between spaces, from a table."""
        if UNSURE_SPACE.search(raw):
            return packed(self.raw(raw.decode()))
        parts = raw.split(b" ")
        found = [self.words.get(x) for x in parts[1:]]
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    found[k] = packed(self.raw(" " + parts[k + 1].decode()))
                    if len(parts[k + 1]) <= WORD_BYTES:
                        if len(self.words) >= WORDS:
                            self.words.clear()
                        self.words[parts[k + 1]] = found[k]
        return (packed(self.raw(parts[0].decode())) if parts[0] else b"") + b"".join(found)

    def plain(self, raw: bytes) -> bytes:
        """Packed ids of a text in which no special token occurs."""
        places, safe = self.cuts(np.frombuffer(raw, np.uint8))
        bounds = [0, *places, len(raw)]
        if all(safe):
            return b"".join([self.chunk(raw[a:b]) for a, b in zip(bounds, bounds[1:])])
        return packed(self.repaired(raw, bounds, safe))

    def repaired(self, raw: bytes, bounds: list[int], safe: list[bool]) -> list[int]:
        """Ids of a text with joins that can change them.

        What lies between the last sure end of a pre-token left of a join and the first to its right is encoded again
        as one text; the ids outside have to split there.
        """
        out: list[int] = []
        run: list[str] = []  # neighbours without a sure end in them or between them: one pre-token, or part of one
        text, ids = raw[: bounds[1]].decode(), unpacked(self.chunk(raw[: bounds[1]]))
        for a, b, sound in zip(bounds[1:-1], bounds[2:], safe, strict=True):
            right, its = raw[a:b].decode(), unpacked(self.chunk(raw[a:b]))
            if sound or sure_end(text[-1], right[0]):
                out += self.raw("".join(run)) if run else ids
                run, text, ids = [], right, its
                continue
            x = 0 if run else self._last_end(text)
            y = self._first_end(right)
            head = "".join(run) if run else text[x:]
            if not run and x:
                out += self._split(ids, len(text[:x].encode()))[0]
            if y == len(right):
                run = run or [head]
                run.append(right)
            else:
                run, ids, right = [], self.raw(head + right[:y]) + self._split(its, len(right[:y].encode()))[1], head + right
            text = right
        return out + (self.raw("".join(run)) if run else ids)

    @staticmethod
    def _last_end(text: str) -> int:
        """The last place inside ``text`` where a pre-token surely ends, else 0."""
        return next((k for k in range(len(text) - 1, 0, -1) if sure_end(text[k - 1], text[k])), 0)

    @staticmethod
    def _first_end(text: str) -> int:
        return next((k for k in range(1, len(text)) if sure_end(text[k - 1], text[k])), len(text))

    def raw(self, text: str) -> list[int]:
        """Ids of a text outside the table. One merges long pre-tokens in time n log n, the other is fast on short."""
        if len(text) > 4096:
            return self.steady.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def _split(self, ids: list[int], size: int) -> tuple[list[int], list[int]]:
        """``ids`` up to ``size`` bytes and after."""
        k = 0
        while size > 0:
            size -= len(self.bytes[ids[k]])
            k += 1
        if size:
            raise ValueError("a token crosses a sure end of a pre-token")
        return ids[:k], ids[k:]

    def encode(self, raw: bytes) -> bytes:
        """Ids of a whole text in UTF-8, packed as little-endian 32-bit integers."""
        if self.marks is None or not any(x in raw for x in self.special_bytes):
            return self.plain(raw)
        text, out, at = raw.decode(), b"", 0
        for m in self.marks.finditer(text):
            out += self.plain(text[at : m.start()].encode()) + packed([self.special[m.group()]])
            at = m.end()
        return out + self.plain(text[at:].encode())

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.size[i]
        ends = np.cumsum(sizes)
        if not len(i):
            return b""
        return self.flat[np.repeat(self.start[i] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes()


@functools.lru_cache(1)
def _codec(path: str) -> Codec:
    """One for all tasks of a worker process, so that its tables stay warm."""
    return Codec(path)


def _coder(path: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            counts, ids_sha, text_sha, all_ids, back = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = codec.encode(data[a:b].tobytes())
                text = codec.decode(ids)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
                if texts:
                    all_ids.append(unpacked(ids))
                    back.append(text.decode("utf-8", "replace"))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``texts`` also ids and decoded, for every row."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return docs.mapInArrow(_coder(path, texts), schema)
