"""Cross-site boilerplate lines: distinct sites per line by HyperLogLog, exact near the threshold, in DataFrame functions.

A text is cut at line feeds. A line (spaces trimmed at both ends; one that is then empty is never removed) is
boilerplate if it stands in texts of at least ``sites`` distinct sites. Per line hash a HyperLogLog sketch of sites is
built on each task and merged by aggregation, so a line that a third of all rows share costs one sketch per task. Lines
whose estimate is far above the threshold are boilerplate, far below are not; those within ``BAND`` of it get an exact
count of distinct (line, site) pairs, which are made distinct before they meet by line.

Lines to remove are joined back by hash: broadcast while they number at most ``BROADCAST_LINES`` (counted first), else
each is copied to ``SALTS`` salts, and rows carry the salt of their document, so a line of a third of all rows is
spread. What comes back to a document is the positions to drop, one row per document.

Defined cases: null text stays null with no lines; null sites count as none; repeated rows change no distinct count;
a line's removal takes its line feed with it; documents that lose no line are returned as they are, byte for byte;
an empty table gives an empty result; rows are told apart by (doc_id, text), others by nothing. ``clean`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, row_count_up_to

SITES = 10
#: Share of the threshold on both sides of it that is counted exactly: over 6 standard errors at 2**LG_K registers.
BAND, LG_K = 0.2, 11
BROADCAST_LINES, SALTS = 50_000, 64


def _line_key(line: str = "line"):
    return F.xxhash64(line, F.length(line))


def lines(docs: DataFrame) -> DataFrame:
    """Rows (site, key) for each line of ``docs`` (text, source) that isn't blank."""
    each = docs.select(F.col("source").cast("string").alias("site"), F.explode(F.split("text", "\n", -1)).alias("raw"))
    each = each.select("site", F.trim("raw").alias("line")).where("line != '' and site is not null")
    return each.select("site", _line_key().alias("key"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of the lines that stand on at least ``sites`` sites."""
    each = lines(docs)
    spread = each.groupBy("key").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).where(F.col("n") >= sites)
    spread = cut(spread.select("key", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= (1 - BAND) * sites))
    sure = spread.where(F.col("about") > (1 + BAND) * sites).select("key")
    near = spread.where(F.col("about") <= (1 + BAND) * sites).select("key")
    if row_count_up_to(near, BROADCAST_LINES) <= BROADCAST_LINES:
        pairs = each.join(F.broadcast(near), "key", "left_semi").distinct()
    else:
        pairs = each.distinct().join(near, "key", "left_semi")
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key")
    return cut(sure.unionAll(exact))


def dropped(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, drop) of the documents that lose lines, with the positions of those."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    each = each.withColumn("line", F.trim("raw")).where("line != ''").select("doc_id", "text_key", "at", _line_key().alias("key"))
    if row_count_up_to(keys, BROADCAST_LINES) <= BROADCAST_LINES:
        hit = each.join(F.broadcast(keys), "key", "left_semi")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = each.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi")
    # positions are collected as bits of words of 60 lines, so that repeated rows are one and partial rows are small
    bits = hit.groupBy("doc_id", "text_key", (F.col("at") / 60).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, at % 60))").alias("bits"))
    return bits.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drop"))


def _marked(docs: DataFrame, sites: int) -> DataFrame:
    """``docs`` with the columns of the result beside a struct of its own."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    plain = docs.select("doc_id", "text", "source")
    drop = dropped(plain, boilerplate(plain, sites)).select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key"), "drop")
    on = F.col("own.doc_id").eqNullSafe(F.col("drop_id")) & (F.xxhash64("own.text") == F.col("drop_key"))
    joined = named.join(drop, on, "left")
    text = F.col("own.text")
    parts = F.split(text, "\n", -1)
    word = lambda i: F.coalesce(F.try_element_at("drop", (i / 60).cast("int")), F.lit(0).cast("long"))
    gone = lambda i: F.bit_get(word(i), (i % 60).cast("int")) == 1
    kept = F.array_join(F.filter(parts, lambda x, i: ~gone(i)), "\n")
    removed = F.coalesce(F.aggregate(F.map_values("drop"), F.lit(0), lambda s, x: s + F.bit_count(x)), F.lit(0))
    return joined.select("own", F.col("own.doc_id").alias("doc_id"), F.when(F.col("drop").isNull(), text).otherwise(kept).alias("kept"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.isNull().alias("no_text"))


def clean(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text`` and ``n_chars`` (if there) brought up to date."""
    new = {"text": F.col("kept")} | ({"n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast("long")} if "n_chars" in docs.columns else {})
    return _marked(docs, sites).select(*[new.get(c, F.col(f"own.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, text_chars, text_sha256) for every document; null text has no lines."""
    marked = _marked(docs.select("doc_id", "text", "source"), sites)
    lines_of = F.when(F.col("no_text"), 0).otherwise(F.col("n_lines")).cast("long")
    text = F.coalesce("kept", F.lit(""))
    return marked.select("doc_id", lines_of.alias("n_lines"), "n_removed", F.length(text).cast("long").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"))
