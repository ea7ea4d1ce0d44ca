"""The corpus pipeline: quality, line dedup, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. A stage
works on all rows that its predecessor kept. Stages are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, line_dedup, near_dup, quality
from textloom.llm.common import cut, row_count_up_to
from textloom.llm.queries import vocabulary


#: Contaminated texts without an id up to which their keys are broadcast.
BAD_TEXTS = 100_000


def _key(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    return "_".join(["key", *docs.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose doc_id is in ``ids`` (one column, never null)."""
    key = _key(docs)
    return docs.join(ids.toDF(key), F.col("doc_id") == F.col(key), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites."""
    return line_dedup.clean(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): the one with the smallest id.

    Rows that repeat an id with its text are one document, of which one row stays; rows without an id are in no group.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = cut(found.where("not kept and doc_id is not null").select("doc_id").distinct())
    # written first: without repeated rows, which are the exception, their join costs nothing
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    key = _key(docs)
    again = docs.join(repeated.toDF(key), F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(_without(docs, repeated), gone).unionByName(_without(again, gone))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Rows without an id are looked at one by one, each by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contamination(docs.select("doc_id", "text"), benchmark)
    kept = _without(docs, found.where("contaminated and doc_id is not null").select("doc_id").distinct())
    nameless = docs.where("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    key = _key(docs)
    bad = decontam.contamination(nameless, benchmark).where("contaminated").select("doc_id").distinct().toDF(key)
    bad = F.broadcast(bad) if row_count_up_to(bad, BAD_TEXTS) <= BAD_TEXTS else bad
    return kept.join(bad, F.col("doc_id").isNull() & (F.xxhash64("text") == F.col(key)), "left_anti")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: The first stage's model is beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
