"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, decontam, langid, line_dedup, media, near_dup, quality, revisits, toxicity


def tokenizer_dir() -> str:
    """Folder of the public vocabularies: TEXTLOOM_TOKENIZERS, or the installed package's."""
    named = os.environ.get("TEXTLOOM_TOKENIZERS")
    if named:
        return named
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers"


def vocabulary(name: str) -> str:
    return os.path.join(tokenizer_dir(), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    return langid.predict(docs, path, langid.train(docs, path))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.gallery(table(spark, sf_dir, "embeddings")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest_chats(chat.format_chats(rows.unionByName(extra)))


SQL2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, contains(text, '</turn>') OR contains(role, '</turn>') OR contains(role, ': ') OR contains(text, '###') OR contains(role, '###') AS bad,
    length(text) + length(role) + 13 AS plain,
    length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 13 AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (sum(CASE WHEN bad THEN escaped ELSE plain END) + count(*) - 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


SQL6 = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
bad AS (SELECT trim(raw) AS line FROM l WHERE trim(raw) != '' AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.SITES}),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON trim(l.raw) = bad.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  length(coalesce(kept, ''))::BIGINT AS text_chars, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of ``pages``: each page's full response, and a later not-modified capture under another
    spelling of its URL. One revisit in 7 has another tag, one in 5 no tag (then dates or digests decide)."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    p = p.withColumn("tag", F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))).withColumn("ts", 1700000000 + F.col("h") % 2592000)
    date = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    first = p.select(
        (F.col("id") * 2).alias("record_id"), "url", "ts", F.lit("response").alias("kind"), F.when(F.col("id") % 5 != 0, F.col("tag")).alias("etag"), F.when(F.col("id") % 3 != 0, date(F.col("ts"))).alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), date(F.col("ts")), F.lit("expires"), F.lit("0")).alias("headers"),
    )
    later = F.col("ts") + F.col("h") % 700000
    again = p.select(
        (F.col("id") * 2 + 1).alias("record_id"), F.concat("url", F.when(F.col("url").contains("#"), "x").when(F.col("url").contains("?"), "&utm_medium=crawl").otherwise("#seen")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("W/"), F.when(F.col("id") % 7 == 0, '"other"').otherwise(F.col("tag")))).alias("etag"), F.when(F.col("id") % 3 != 0, date(F.col("ts"))).alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), date(later)).alias("headers"),
    )
    return first.unionByName(again)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(crawl_records(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    return found.select("record_id", "url_key", "refers_to", "refers_ts", "status", listed.alias("headers"))


SQL7 = r"""
WITH RECURSIVE digits AS (SELECT page_id AS id, url, coalesce(html, '') AS html FROM pages),
crc0(n, i, c) AS (SELECT n, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM crc0 WHERE i < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM crc0 WHERE i = 8),
p AS (SELECT id, url, sha1(html) AS digest,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM digits, tab),
q AS (SELECT *, 1700000000 + h % 2592000 AS ts, '"' || left(digest, 12) || '"' AS tag FROM p),
r AS (
  SELECT id * 2 AS record_id, url, ts, 'response' AS kind, CASE WHEN id % 5 != 0 THEN tag END AS etag,
    CASE WHEN id % 3 != 0 THEN strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS lm, digest, ts AS own_ts FROM q
  UNION ALL
  SELECT id * 2 + 1, url || CASE WHEN contains(url, '#') THEN 'x' WHEN contains(url, '?') THEN '&utm_medium=crawl' ELSE '#seen' END, ts + h % 700000, 'revisit',
    CASE WHEN id % 5 != 0 THEN CASE WHEN id % 7 = 0 THEN '"other"' ELSE tag END END,
    CASE WHEN id % 3 != 0 THEN strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END, digest, ts + h % 700000 FROM q),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM r),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x != '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|sessionid)(=|$)'))) AS kept FROM bare),
k AS (SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM parts),
w AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(id := record_id, ts := ts, etag := etag, lm := lm, digest := digest) END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM k),
s AS (SELECT *, coalesce(CASE WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN etag = f.etag END, CASE WHEN lm IS NOT NULL AND f.lm IS NOT NULL THEN lm = f.lm END, CASE WHEN digest IS NOT NULL AND f.digest IS NOT NULL THEN digest = f.digest END) AS ok FROM w WHERE kind = 'revisit')
SELECT record_id, url_key, CASE WHEN ok THEN f.id END AS refers_to, CASE WHEN ok THEN f.ts END AS refers_ts,
  CASE WHEN f IS NULL OR f.id IS NULL THEN 'orphan' WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN ok THEN 'content-type=text/html;date=' || strftime(to_timestamp(own_ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ';expires=0' END AS headers
FROM s
"""


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


SQL8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
c AS (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS k, min(doc_id) AS node, any_value(len(sh)) AS n, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT node, n, unnest(sh) AS g FROM c),
pairs AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS nab
  FROM x a JOIN x b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * nab >= 85 * (na + nb - nab)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT node, node FROM c UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.k = md5(array_to_string(list_sort(s.sh), chr(10))) LEFT JOIN comp ON comp.node = c.node
"""


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_media_copies": op5_media_copies,
    "op10_quality_classifier": op10_quality_classifier,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_bpe_encoding": op9_bpe_encoding,
}

SQL = {
    "op2_chat_formatting": SQL2,
    "op3_benchmark_decontamination": SQL3,
    "op6_line_dedup": SQL6,
    "op7_warc_revisits": SQL7,
    "op8_minhash_near_dedup": SQL8,
}
