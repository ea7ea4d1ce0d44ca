"""Files and streams in and out: strict UTF-8 texts as rows, and results as files that are whole or not there."""

from __future__ import annotations

import contextlib
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source, text) for the files of a path or glob, line ends as they are; a file that isn't UTF-8 fails the job."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source"), F.expr("validate_utf8(cast(content as string))").alias("text"))


def read_input(path: str) -> str:
    """One text: a regular file, or standard input for ``-``."""
    if path == "-":
        return sys.stdin.read()
    if not os.path.isfile(path):
        raise OSError(f"no regular file: {path}")
    with open(path, "rb") as f:
        try:
            return f.read().decode("utf-8")
        except UnicodeDecodeError as e:
            raise OSError(f"{path} is not UTF-8: {e}") from e


def write_whole(path: str, text: str, mode_of: str | None = None) -> None:
    """Write beside the target and move there, so that readers see the old file or the new one; ``mode_of``: whose mode it takes."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(prefix=f".{os.path.basename(path)}.", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(text.encode())
            f.flush()
            os.fsync(f.fileno())
        if mode_of and os.path.exists(mode_of):
            os.chmod(temporary, os.stat(mode_of).st_mode & 0o7777)
        os.replace(temporary, path)
    except OSError:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise
