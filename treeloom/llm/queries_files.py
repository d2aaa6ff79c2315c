"""Queries over files: those that do not parse, those no one wrote by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.llm import handwritten, syntax
from treeloom.llm.files import files


def p6_found(spark, sf_dir):
    """Each file that the parser of its language rejects."""
    return syntax.parse_files(files(spark, sf_dir)).where("error is not null").select("source_file_id").distinct()


def p6_errors(spark, sf_dir):
    """The first unrecoverable error of each rejected file."""
    return syntax.parse_files(files(spark, sf_dir)).where("error is not null")


def p6_rates(spark, sf_dir):
    """Files, failures and failure rate per repository and language."""
    f = files(spark, sf_dir)
    return syntax.rates(syntax.parse_files(f), f.select("source_file_id", "repository_id").distinct())


def p7_found(spark, sf_dir):
    """Each file that is generated, minified, vendored or mainly data."""
    return handwritten.machine_made(files(spark, sf_dir)).select("source_file_id")


def p7_kinds(spark, sf_dir):
    """What each of those files is."""
    return handwritten.machine_made(files(spark, sf_dir))


def p7_remaining(spark, sf_dir):
    """Files and hand-written files per language."""
    f = files(spark, sf_dir).select("source_file_id", "language").distinct()
    j = f.join(handwritten.machine_made(files(spark, sf_dir)), "source_file_id", "left")
    return j.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("kind").isNull()).alias("hand_written"))


QUERIES = {f.__name__: f for f in (p6_found, p6_errors, p6_rates, p7_found, p7_kinds, p7_remaining)}
SQL: dict[str, str] = {}
