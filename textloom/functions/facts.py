"""Facts of one text that rules look at: format, protected spans, masked text, words, sentences, paragraphs, lines.

Plain Python over one text, run by the Arrow kernels of ``textloom.operators``; Spark has no function that gives the
offsets of matches. Offsets are in code points, ends exclusive. Every fact takes time in proportion to the text, whatever
it holds: no pattern can split one run in several ways, and spans merge by a sort.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np

# Token patterns, marks of formats, names of spans.
WORD = re.compile(r"\b[\w’'-]+\b")
NUMBER = re.compile(r"(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?%?(?!\w)")
URL = re.compile(r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>()\[\]{}]+")
EMAIL = re.compile(r"(?i)(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]|\.[A-Za-z0-9])")
DOI = re.compile(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b")
AUTOLINK = re.compile(r"(?i)<(?:(?:https?://|mailto:)[^>]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,})>")
CITATION = re.compile(r"\[(?:\d+(?:\s*[-–,]\s*\d+)*)\]")
FOOTNOTE = re.compile(r"\[\^[^\]\r\n]+\]")
AUTHOR_DATE = re.compile(r"\((?:[A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?(?:\s*&\s*[A-Z][A-Za-z'’-]+)?),?\s+\d{4}[a-z]?\)")
NAMED_SOURCE = re.compile(r"\([A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?,?\s+\d{4}[a-z]?\)|\baccording\s+to\s+[A-Z][A-Za-z'’-]+")
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e fig eq".split())
CLOSERS = "\"'”’)]}"
SUFFIXES = {"md": "markdown", "markdown": "markdown", "mdown": "markdown", "html": "html", "htm": "html", "tex": "latex", "latex": "latex"}
BLOCK_MARK = re.compile(r"(?m)^\s{0,3}(?:#{1,6}\s|[-*+]\s|```|~~~)")
HTML_MARK = re.compile(r"(?i)<(?:html|body|article|section|p|pre|code)\b")
LATEX_MARK = re.compile(r"\\(?:begin|section|chapter|documentclass)\b")
VERBATIM = "verbatim verbatim* Verbatim Verbatim* lstlisting lstlisting* minted minted* alltt".split()
BREAK = r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"
# End of fixed values.

_END = re.compile(r"[.!?][" + re.escape(CLOSERS) + r"]*(?=\s|\Z)|" + BREAK)
_SEPARATOR = re.compile(BREAK + r"[\r\n]*")
_SOLID = re.compile(r"\S")
_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
_FENCE = re.compile(r"(?:\A|(?<=[\r\n])) {0,3}(`{3,}|~{3,})([^\r\n]*)(?:\r\n|\n|\r|\Z)")
_INDENTED = re.compile(r"(?:\A|(?<=[\r\n]))(?: {4}|\t)\S[^\r\n]*(?:\r\n|\n|\r|\Z)")
_QUOTED_LINE = re.compile(r"(?:\A|(?<=[\r\n])) {0,3}>(?=\s|\Z)[^\r\n]*(?:\r\n|\n|\r|\Z)")
_TICKS = re.compile("`+")
# an escaped bracket ends a link only where no other one follows on its line
_LINK = re.compile(r"!?\[[^\]\r\n]*\]\((?:(?:\\.|[^)\\\r\n])*+\)|[^\r\n]*\))")
_REFERENCE = re.compile(r"!?\[[^\]\r\n]+\]\[[^\]\r\n]*\]")
_LINKED = re.compile(r"\]\([^\r\n)]+\)")
_OPEN_HTML = re.compile(r"(?i)<(pre|code)\b[^>]*>")
_OPEN_LATEX = re.compile(r"\\begin\{(" + "|".join(re.escape(v) for v in VERBATIM) + r")\}")
# an open quote takes the rest of its line, as none after it on that line can close either; only closed ones have a group
_QUOTES = {"“": re.compile(r"“[^”\r\n]*+(”)?"), "‘": re.compile(r"‘[^’\r\n]*+(’)?"), '"': re.compile(r'(?<!\\)"(?=(?:\\.|[^"\r\n]){2})(?:[^"\r\n]|(?<=\\)")*+(?<!\\)(")')}
_JSON = re.compile(r'(?m)^[^\S\n]*"(?:(?:\\.|[^"\\\r\n])++|[^"\r\n]+)"\s*+:\s*+("(?:(?:\\.|[^"\\\r\n])*+|[^"\r\n]*)")')
_SHOWN = re.compile(r"[^\r\n]")
_RUN = re.compile(r"\w+")
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})


def _abbreviated(text: str, dot: int) -> bool:
    """Whether the full stop at ``dot`` belongs to an abbreviation or an initial."""
    first = dot
    while first and (text[first - 1] == "." or ("A" <= text[first - 1] <= "z" and text[first - 1].isalpha())):
        first -= 1
    token = text[first:dot].lstrip(".").rstrip(".").lower()
    return len(token) == 1 or token in ABBREVIATIONS


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Pieces that end at a mark before white space, or at a blank line; abbreviations and initials end none."""

    def solid(at: int) -> int:
        m = _SOLID.search(text, at)
        return m.start() if m else len(text)

    out, first = [], solid(0)
    for m in _END.finditer(text):
        stop = m.start() if m[0][0] in "\r\n" else m.end()
        if first >= stop or (m[0][0] == "." and _abbreviated(text, m.start())):
            continue
        out.append((first, stop))
        first = solid(m.end())
    return out + [(first, len(text))] if first < len(text) else out


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """What stands between blank lines, without the white space around it."""
    out, at = [], 0
    for end, after in [*(m.span() for m in _SEPARATOR.finditer(text)), (len(text), len(text))]:
        piece = text[at:end]
        solid = piece.strip()
        if solid:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(solid)))
        at = after
    return out


def _mark_class() -> str:
    """Combining marks, which ``\\w`` leaves out."""
    return "".join(chr(c) for c in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M")


_PLAIN_WORD = re.compile(r"\w[\w’'-]*")
_MARKED_WORD = re.compile(rf"[\w{_mark_class()}][\w{_mark_class()}’'-]*")
_MAY_BE_MARK = re.compile(r"[^\x00-\u02ff\u2010-\u2027]")
_SHORT = re.compile(r"(?<![A-Za-z.])((?i:" + "|".join(re.escape(x) for x in "mr mrs ms dr prof sr jr st vs etc e.g i.e fig eq".split()) + r")|[A-Za-z])\.")
_CLOSED = re.compile(r"([.!?][" + re.escape(CLOSERS) + r"]*)(?:[\t\n\f\r ]+|\Z)")
_PIECE = re.compile("\x01|" + BREAK)


def _solid_words(text: str) -> list[str]:
    """Words with their combining marks; the pattern that knows these is several times slower."""
    return (_MARKED_WORD if _MAY_BE_MARK.search(text) else _PLAIN_WORD).findall(text)


def joined_sentences(text: str) -> list[list[str]]:
    """Lower-cased words of each sentence, where the dot of an abbreviation or initial is left out before anything is cut.

    What such a dot stood between is one word (``a.klsd``), and any mark left before ASCII white space ends a sentence.
    """
    closed = _CLOSED.sub("\\1\x01", _SHORT.sub(r"\1", text))
    # one by one where that matters: no final sigma, no dot of its own after an i
    lower = "".join(c.lower()[0] for c in closed) if "Σ" in closed or "İ" in closed else closed.lower()
    return [words for piece in _PIECE.split(lower) if (words := _solid_words(piece))]


def joined_segments(text: str) -> dict:
    """What ``operators.audit.segments`` gives, by ``joined_sentences`` and so without offsets; no paragraph without a word."""
    sentences, n, pieces = joined_sentences(text), len(_solid_words(text)), re.split(BREAK, text)
    paragraphs = [(n, len(sentences))] if len(pieces) == 1 else [(len(_solid_words(p)), len(joined_sentences(p))) for p in pieces]
    return {
        "words": n,
        "sentences": [{"words": len(w), "opening": f"{w[0]} {w[1]}" if len(w) > 1 else None} for w in sentences],
        "paragraphs": [{"words": w, "sentences": k} for w, k in paragraphs if k],
    }


def detect_format(text: str, name: str | None = None) -> str:
    """markdown, html, latex or plain, by the name's suffix, then by marks in the text."""
    base = re.split(r"[\\/]", name)[-1] if name else ""
    known = SUFFIXES.get(base.rpartition(".")[2].lower()) if "." in base[1:] else None
    if known:
        return known
    if BLOCK_MARK.search(text) or ("`" in text and re.search(r"`[^`\r\n]+`", text)) or any(_opened(text, m.start()) for m in _LINKED.finditer(text)):
        return "markdown"
    return "html" if "<" in text and HTML_MARK.search(text) else "latex" if "\\" in text and LATEX_MARK.search(text) else "plain"


def _opened(text: str, close: int) -> bool:
    """Whether a bracket with something in it ends at ``close``."""
    low = max(text.rfind(c, max(0, close - 4096), close) for c in "]\r\n") + 1
    return "[" in text[max(low, close - 4096) : close - 1]


def _inside(starts: Sequence[int], ends: Sequence[int], start: int, end: int) -> int:
    """Index of the first of the sorted, disjoint spans that overlaps, or -1."""
    i = bisect_right(ends, start)
    return i if i < len(starts) and starts[i] < end else -1


def _fences(text: str) -> list[tuple[int, int]]:
    out, opened = [], None
    for m in _FENCE.finditer(text):
        mark, rest = m[1], m[2]
        if opened is None:
            if not rest or rest[0] not in "`~":
                opened = (m.start(), mark)
        elif mark[0] == opened[1][0] and len(mark) >= len(opened[1]) and not rest.strip():
            out.append((opened[0], m.end()))
            opened = None
    return out if opened is None else [*out, (opened[0], len(text))]


def _inline_code(text: str, fences: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    starts, ends = [a for a, _ in fences], [b for _, b in fences]
    at, gone = 0, 1 << 60  # runs of that length or more have no partner any more
    while m := _TICKS.search(text, at):
        k = _inside(starts, ends, m.start(), m.start() + 1)
        if k >= 0:
            at = ends[k]
            continue
        at, size = m.end(), len(m[0])
        close = text.find(m[0], at) if size < gone else -1
        if close < 0:
            gone = min(gone, size)
        elif text.find("\n\n", at, close) < 0:
            yield m.start(), close + size
            at = close + size


def _enclosed(text: str, opening: re.Pattern[str], closing: str) -> Iterator[tuple[int, int]]:
    """From an opening to the next closing that carries its name."""
    at, none = 0, set()
    while m := opening.search(text, at):
        at, name = m.start() + 1, m[1].lower() if opening.flags & re.I else m[1]
        end = None if name in none else re.compile(closing % re.escape(name), opening.flags & re.I).search(text, m.end())
        if end:
            yield m.start(), end.end()
            at = end.end()
        else:
            none.add(name)


def _raw_spans(text: str, fmt: str, extra: Sequence[str], edit_quotes: bool) -> Iterator[tuple[int, int, str, bool, bool]]:
    """Protected spans as they are found: start, end, kind, kept from analysis, kept from edits."""

    def of(found, kind: str, analysis: bool = True, edit: bool = True):
        for m in found:
            a, b = m if isinstance(m, tuple) else m.span()
            yield a, b, kind, analysis, edit

    if fmt == "markdown":
        fences = _fences(text)
        starts, ends = [a for a, _ in fences], [b for _, b in fences]
        yield from of(fences, "markdown_fenced_code")
        yield from of((m for m in _INDENTED.finditer(text) if _inside(starts, ends, *m.span()) < 0), "markdown_indented_code")
        yield from of(_QUOTED_LINE.finditer(text), "markdown_blockquote", False)
        yield from of(_inline_code(text, fences), "markdown_inline_code")
        if "](" in text:
            yield from of(_LINK.finditer(text), "markdown_link")
        if "][" in text:
            yield from of(_REFERENCE.finditer(text), "markdown_reference_link")
        if "[^" in text:
            yield from of(FOOTNOTE.finditer(text), "markdown_footnote")
    elif fmt == "html":
        last = text.rfind(">") + 1
        yield from of(_enclosed(text, _OPEN_HTML, r"</%s\s*>"), "html_code")
        comment = r"<!--.*?-->|" if "-->" in text else ""
        yield from of(re.compile(comment + r"<![^>]*>|<[^>]+>", re.S).finditer(text, 0, last), "html_markup")
    elif fmt == "latex":
        yield from of(_enclosed(text, _OPEN_LATEX, r"\\end\{%s\}"), "latex_verbatim")
    if "://" in text or "www." in text.lower():
        yield from of(URL.finditer(text), "url")
    if "@" in text:
        yield from of(EMAIL.finditer(text), "email")
    if "10." in text:
        yield from of(DOI.finditer(text), "doi")
    if "<" in text:
        yield from of(AUTOLINK.finditer(text, 0, text.rfind(">") + 1), "autolink")
    if "[" in text:
        yield from of(CITATION.finditer(text), "numeric_citation", False)
    if "(" in text:
        yield from of(AUTHOR_DATE.finditer(text), "author_date_citation", False)
    for mark, quote in _QUOTES.items():
        if mark in text:
            yield from of((m for m in quote.finditer(text) if m[1]), "quoted_text", False, not edit_quotes)
    if '"' in text and ":" in text:
        yield from of((m.span(1) for m in _JSON.finditer(text)), "json_string")
    for i, p in enumerate(extra, 1):
        yield from of(re.finditer(p, text), f"profile_pattern_{i}")


class Spans:
    """Protected spans in order, overlapping and touching ones as one: kinds together, flags or-ed."""

    def __init__(self, found: list[tuple[int, int, str, bool, bool]]) -> None:
        found = [s for s in found if s[1] > s[0]]
        self.start = self.end = np.zeros(0, np.int64)
        self.kind, self.analysis, self.edit = [], np.zeros(0, bool), np.zeros(0, bool)
        if found:
            start, end = np.array([s[0] for s in found]), np.array([s[1] for s in found])
            order = np.lexsort((end, start))
            start, reach = start[order], np.maximum.accumulate(end[order])
            heads = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            groups = np.split(order, heads[1:])
            self.start, self.end = start[heads], reach[np.append(heads[1:], len(order)) - 1]
            self.kind = ["+".join(sorted({found[i][2] for i in g.tolist()})) for g in groups]
            flag = lambda k: np.logical_or.reduceat(np.array([s[k] for s in found])[order], heads)
            self.analysis, self.edit = flag(3), flag(4)
        quoted = np.array([any(q in k for q in ("quoted_text", "markdown_blockquote")) for k in self.kind], bool)
        self._ways = {"analysis": self._way(self.analysis), "edit": self._way(self.edit), "analysis or quoted": self._way(self.analysis | quoted)}

    def _way(self, flag: np.ndarray) -> tuple[list[int], list[int], list[str]]:
        keep = np.flatnonzero(flag)
        return self.start[keep].tolist(), self.end[keep].tolist(), [self.kind[i] for i in keep.tolist()]

    def at(self, start: int, end: int, way: str) -> str | None:
        """Kind of the first span of that way that overlaps."""
        starts, ends, kinds = self._ways[way]
        k = _inside(starts, ends, start, end)
        return kinds[k] if k >= 0 else None

    def mask(self, text: str) -> str:
        """Spans kept from analysis as blanks; line ends stay, so offsets do."""
        starts, ends, _ = self._ways["analysis"]
        out, at = [], 0
        for a, b in zip(starts, ends, strict=True):
            out += [text[at:a], _SHOWN.sub(" ", text[a:b])]
            at = b
        return "".join(out) + text[at:] if out else text


class Segments:
    """Words, sentences, paragraphs and lines of a text, each found once and only if asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def words(self) -> np.ndarray:
        """Where words start."""
        return np.array([m.start() for m in WORD.finditer(self.text)], np.int64)

    @cached_property
    def low(self) -> str:
        return self.text.lower()

    @property
    def word_count(self) -> int:
        return len(self.words)

    def token(self, i: int) -> str:
        """The i-th word, lower-cased."""
        return WORD.match(self.text, int(self.words[i]))[0].lower()

    def _words_in(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each span, and number of words."""
        first = np.searchsorted(self.words, spans[:, 0])
        return first, np.searchsorted(self.words, spans[:, 1]) - first

    @cached_property
    def _sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = np.array(sentence_spans(self.text), np.int64).reshape(-1, 2)
        first, n = self._words_in(spans)
        return spans[n > 0], first[n > 0], n[n > 0]

    @property
    def sentences(self) -> np.ndarray:
        """Rows (start, end) of sentences that hold a word."""
        return self._sentences[0]

    @property
    def sentence_words(self) -> np.ndarray:
        return self._sentences[2]

    @property
    def sentence_first(self) -> np.ndarray:
        return self._sentences[1]

    @cached_property
    def paragraphs(self) -> np.ndarray:
        return np.array(paragraph_spans(self.text), np.int64).reshape(-1, 2)

    @cached_property
    def paragraph_words(self) -> np.ndarray:
        return self._words_in(self.paragraphs)[1]

    @cached_property
    def paragraph_sentences(self) -> np.ndarray:
        starts = self.sentences[:, 0]
        return np.searchsorted(starts, self.paragraphs[:, 1]) - np.searchsorted(starts, self.paragraphs[:, 0])

    @cached_property
    def lines(self) -> list[tuple[int, int, str]]:
        """(start, end with the line end, line without it)."""
        return [(m.start(), m.end(), m[1]) for m in _LINE.finditer(self.text) if m.end() > m.start()]

    @cached_property
    def line_starts(self) -> list[int]:
        """Where lines start after a line feed; other line ends count for none."""
        return [0, *(m.end() for m in re.finditer("\n", self.text))]

    def place(self, offset: int) -> tuple[int, int]:
        """1-based line and column."""
        k = bisect_right(self.line_starts, offset)
        return k, offset - self.line_starts[k - 1] + 1

    @cached_property
    def vocabulary(self) -> set[str]:
        """Lower-cased runs of word characters, as a pattern without regard to case takes them."""
        strange = not self.text.isascii() and any(c in self.text for c in "ſıİK")
        return set(_RUN.findall(self.text.translate(_FOLD).lower() if strange else self.low))


class Facts(Segments):
    """A text, its format and protected spans, and the segments of what is left to analyse (``clean``)."""

    def __init__(self, text: str, fmt: str = "auto", name: str | None = None, extra: Sequence[str] = (), edit_quotes: bool = False) -> None:
        super().__init__(text)
        self.format = detect_format(text, name) if fmt == "auto" else fmt
        self.spans = Spans(list(_raw_spans(text, self.format, extra, edit_quotes)))
        self.masked = self.spans.mask(text)
        self.clean = Segments(self.masked) if self.masked != text else self

    def sourced(self, start: int, end: int) -> bool:
        """Whether a link, DOI, citation or named source stands around a match."""
        around = self.text[max(0, start - 100) : end + 240]
        return any(p.search(around) for p in (URL, DOI, CITATION, NAMED_SOURCE))

    def opens_sentence(self, offset: int) -> bool:
        """Whether only quotes, brackets and blanks stand between ``offset`` and a sentence end or line start."""
        while offset and self.text[offset - 1] in " \t\"'“‘([{":
            offset -= 1
        return not offset or self.text[offset - 1] in ".!?\r\n"
