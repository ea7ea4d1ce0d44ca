"""The audit over streams: it works row by row and keeps no state, so a stream's rows go through the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import audit
from textloom.sources.configs import PolicyConfig


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (source, text) of the text files that come into a folder, one row a file."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def gate_stream(stream: DataFrame, config: PolicyConfig | None = None) -> DataFrame:
    """A stream of (source, finding_count, failure_count, status) for a stream of (source, text)."""
    config = config or PolicyConfig()
    return audit.gate(audit.policy_audit(stream, config, source="source"), ["source"], config.fail_on)
