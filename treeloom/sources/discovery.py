"""Files of a checkout: scan, prune, hash, classify, count."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions.text import language

#: Folders that are never read, and the size in bytes up to which a file is.
IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".idea", ".vscode")
MAX_BYTES = 1_000_000


def ignored(path: Column) -> Column:
    """Whether any part of a path is a folder that is never read."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))


def prune(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (relative_path, length, ...) with ``kept``; a file of just the limit stays."""
    if max_bytes <= 0:
        raise ValueError("the limit must be positive")
    return files.withColumn("kept", ~ignored(F.col("relative_path")) & (F.col("length") <= max_bytes))


def describe(files: DataFrame) -> DataFrame:
    """Rows of the file table from (snapshot_id, relative_path, length, content) of kept files."""
    f = files.select("snapshot_id", "relative_path", language(F.col("relative_path")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))
    return f.withColumn("id", ids.source_file_id()).select("id", *f.columns)


def scan(spark: SparkSession, folder: str, snapshot_id: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(snapshot_id, relative_path, length, content) of the files to read below a folder; the size limit reaches the scan."""
    root = os.path.abspath(folder)
    if not os.path.isdir(root):
        raise NotADirectoryError(folder)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(f"file://{root}")
    path = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 2**31 - 1)
    df = df.where(F.col("length") <= max_bytes).select(F.lit(snapshot_id).alias("snapshot_id"), path.alias("relative_path"), "length", "content")
    return df.where(~ignored(F.col("relative_path")))


def ignored_count(folder: str, max_bytes: int = MAX_BYTES) -> int:
    """Entries, folders included, that a scan leaves out; folders are only visible to the file system, so the driver walks it."""
    n = 0
    for at, folders, files in os.walk(folder):
        below = any(p in IGNORED for p in os.path.relpath(at, folder).split(os.sep))
        for name in (*folders, *files):
            n += below or name in IGNORED or (name in files and os.path.getsize(os.path.join(at, name)) > max_bytes)
    return n


def summary(files: DataFrame, *by: str) -> DataFrame:
    """Files and bytes per language."""
    return files.groupBy(*by, "language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


def decoded(files: DataFrame) -> DataFrame:
    """files with ``text``: UTF-8 with every line break as one, null where the bytes are no UTF-8."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.regexp_replace(text, "\r\n?", "\n"))
