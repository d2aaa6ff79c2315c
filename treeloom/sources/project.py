"""The project tables as sources: each record once, by the row that holds, in normal spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.records import hash_key, latest, path_key, strip, uuid_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir, table_, ids, others, key="id", first=False, **norm):
    df = table(spark, sf_dir, table_).select(*[uuid_key(c).alias(c) for c in ids], *[norm.get(c, F.col)(c).alias(c) for c in others], "recorded_at")
    return latest(df, [key], [c for c in (*ids, *others, "recorded_at") if c != key], first=first)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = lambda c: F.upper(strip(c))
    return _records(spark, sf_dir, "snapshots", ["id", "repository_id"], ["commit_sha", "branch", "remote_url", "status", "created_at"], status=up)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "source_files", ["id", "snapshot_id"], ["relative_path", "language", "size_bytes", "content_hash"], relative_path=path_key, content_hash=hash_key)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "symbols", ["id", "source_file_id", "parent_symbol_id"], ["name", "qualified_name", "kind", "start_line", "end_line"], name=strip, qualified_name=strip)


def symbol_relations(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    return _records(spark, sf_dir, "symbol_relations", ["id", "source_symbol_id", "target_symbol_id"], ["kind"], first=first)


def source_file_relations(spark: SparkSession, sf_dir: str, first: bool = False) -> DataFrame:
    return _records(spark, sf_dir, "source_file_relations", ["id", "source_file_id", "target_file_id"], ["kind"], first=first)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READY snapshots in order: (snapshot_id, series, seq, next_snapshot_id); equal times fall to the smaller id."""
    ready = snapshots(spark, sf_dir).where("status = 'READY' and repository_id is not null")
    w = Window.partitionBy("repository_id").orderBy(F.col("created_at").asc_nulls_first(), "id")
    return ready.select(F.col("id").alias("snapshot_id"), F.col("repository_id").alias("series"), F.row_number().over(w).alias("seq"), F.lead("id").over(w).alias("next_snapshot_id"))


def indexed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, repository_id) of each repository's READY snapshot with the latest created_at."""
    ready = snapshots(spark, sf_dir).where("status = 'READY'")
    best = ready.groupBy("repository_id").agg(F.max(F.struct(F.col("created_at"), F.col("id"))).alias("_r"))
    return best.select(F.col("_r.id").alias("snapshot_id"), "repository_id")
