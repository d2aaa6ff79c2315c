"""Source files that do not parse: whole token streams through the bundled grammars, first unrecoverable error per file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.sources.languages import LANGUAGES, first_problem


def decoded(content: bytes | None) -> str:
    """Text of a file: UTF-8 without byte order mark; undecodable bytes become a character no grammar accepts outside strings."""
    return (content or b"").decode("utf-8", "replace").removeprefix("﻿")


def parse_files(files: DataFrame) -> DataFrame:
    """(source_file_id, language, error) of every file in a language with a grammar; error is null where it parses.

    Files of another or no language give no row. Null, empty and blank contents parse. Repeated rows give repeated results;
    any further columns are ignored. A file is parsed as a whole, however long.
    """

    def run(batches):
        for b in batches:
            languages = b.column(1).to_pylist()
            errors = [first_problem(lang, decoded(content.as_py())) for lang, content in zip(languages, b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(errors, pa.string())], ["source_file_id", "language", "error"])

    known = files.where(F.col("language").isin(*LANGUAGES) & F.col("source_file_id").isNotNull())
    return known.select("source_file_id", "language", "content").mapInArrow(run, "source_file_id string, language string, error string")


def rates(parsed: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files, failures and their rate per repository and language. repositories: (source_file_id, repository_id)."""
    j = parsed.join(repositories.select(F.col("source_file_id").alias("_id"), "repository_id"), F.col("source_file_id") == F.col("_id"), "left")
    g = j.groupBy("repository_id", "language").agg(F.count("*").alias("files"), F.count("error").alias("failed"))
    return g.withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))
