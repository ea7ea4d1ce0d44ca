"""Column functions over one text, of built-in expressions; a null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns (Java regular expressions).
WORD = r"(?U)\b[\w’'-]+\b"
NUMBER = r"(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?%?(?!\w)"
URL = r"\b(?:https?://|ftp://|www\.)[^\s<>()\[\]{}]+"
EMAIL = r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]|\.[A-Za-z0-9])"
CONTRACTION = r"\b\w+(?:n(?:'|’)t|(?:'|’)(?:m|re|ve|ll|d|s))\b"
ADDRESS = r"\b(?:I|me|my|we|our|you|your)\b"
PARENTHETICAL = r"\([^()\n]{2,160}\)"
# End of fixed values.

#: A blank line. The set repeats, not a choice of line ends: a repeated choice recurses and overflows on long runs.
BREAK = r"(?:\r\n|\r|\n)[ \t]*[\r\n]+"


def count(text: Column, pattern: str, flags: str = "iU") -> Column:
    return F.regexp_count(text, F.lit(f"(?{flags})" + pattern))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, BREAK), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+\z", "")), lambda p: p != "")


def detect_format(text: Column, name: Column | None = None) -> Column:
    """markdown, html, latex or plain, by the name's suffix, then by marks in the text."""
    name = F.lower(name) if name is not None else F.lit("")
    out = F.when(name.rlike(r"\.(md|markdown|mdown)\z"), "markdown").when(name.rlike(r"\.html?\z"), "html").when(name.rlike(r"\.(tex|latex)\z"), "latex")
    marks = text.rlike(r"(?mU)^\s{0,3}(?:#{1,6}\s|[-*+]\s|```|~~~)") | text.rlike(r"`[^`\r\n]+`|\[[^\]\r\n]+\]\([^\r\n)]+\)")
    return out.when(marks, "markdown").when(text.rlike(r"(?is)<(?:html|body|article|section|p|pre|code)\b"), "html").when(text.rlike(r"\\(?:begin|section|chapter|documentclass)\b"), "latex").otherwise("plain")
