"""Files of a checkout with what the tables say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.records import path_key, uuid_key
from treeloom.llm.winners import holding_rows
from treeloom.session import broadcast_if_small
from treeloom.sources import project as P


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file_id, relative_path, language, size_bytes, snapshot_id, repository_id, content), a row per path by the row that holds.

    Contents never cross a shuffle: what the tables say is reduced to the files that have content and meets them broadcast
    where it was counted to be small.
    """
    c = holding_rows(P.table(spark, sf_dir, "file_contents"), "path", norm=path_key).select(uuid_key("source_file_id").alias("source_file_id"), F.col("_key").alias("path"), "content")
    ids = P.table(spark, sf_dir, "file_contents").select(uuid_key("source_file_id").alias("id")).distinct()
    known = P.source_files(spark, sf_dir).join(ids, "id", "left_semi")
    snaps = P.snapshots(spark, sf_dir).select(F.col("id").alias("_snap"), "repository_id")
    known = known.join(broadcast_if_small(snaps), F.col("snapshot_id") == F.col("_snap"), "left")
    known = known.select(F.col("id").alias("_id"), "relative_path", F.lower(F.trim("language")).alias("language"), "size_bytes", "snapshot_id", "repository_id")
    out = c.join(broadcast_if_small(known), F.col("source_file_id") == F.col("_id"), "left")
    path = F.coalesce("relative_path", F.regexp_replace("path", "^checkouts/[^/]+/", ""))
    return out.select("source_file_id", path.alias("relative_path"), "language", "size_bytes", "snapshot_id", "repository_id", "content")
