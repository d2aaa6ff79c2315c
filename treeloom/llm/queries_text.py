"""Queries over document texts: packing and subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.llm import packing, subjects
from treeloom.sources.project import table


def p8_containers(spark, sf_dir):
    """The container of 2,048 tokens, and the place in it, of every document."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_fill(spark, sf_dir):
    """How full the containers are."""
    return packing.fill(p8_containers(spark, sf_dir))


def _subjects(spark, sf_dir):
    return subjects.document_subjects(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "subjects"), table(spark, sf_dir, "subject_labels"))


def p10_found(spark, sf_dir):
    """Each document and each subject that one of its paragraphs deals with."""
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark, sf_dir):
    """Documents and characters per subject and kind of source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.substring_index("source", "/", 1).alias("source_kind"))
    j = p10_found(spark, sf_dir).join(docs, "doc_id")
    return j.groupBy("subject", "source_kind").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p10_found, p10_composition)}
SQL: dict[str, str] = {}
