"""Snapshots of repositories: comparison, plans, reuse of unchanged work, choice of the snapshot before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import ids


def compare(previous: DataFrame, current: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, relative_path, previous_id, current_id, change_kind) of two sets of files: ADDED, DELETED, MODIFIED or UNCHANGED.

    A full outer join on the path (and on ``by``, to compare many pairs at once); equal hashes, also two nulls, are no change.
    """
    p = previous.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("relative_path").alias("_path"), F.col("id").alias("previous_id"), F.col("content_hash").alias("_hash"))
    on = F.col("relative_path") == F.col("_path")
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    j = current.select(*by, "relative_path", F.col("id").alias("current_id"), "content_hash").join(p, on, "full_outer")
    kind = F.when(F.col("previous_id").isNull(), "ADDED").when(F.col("current_id").isNull(), "DELETED").when(F.col("content_hash").eqNullSafe(F.col("_hash")), "UNCHANGED").otherwise("MODIFIED")
    return j.select(*[F.coalesce(b, f"_{b}").alias(b) for b in by], F.coalesce("relative_path", "_path").alias("relative_path"), "previous_id", "current_id", kind.alias("change_kind"))


def change_counts(changes: DataFrame, *by: str) -> DataFrame:
    k = F.col("change_kind")
    return changes.groupBy(*by).agg(*[F.count_if(k == x).alias(x.lower()) for x in ("ADDED", "DELETED", "MODIFIED", "UNCHANGED")])


def plan(changes: DataFrame) -> DataFrame:
    """``action`` per change: REUSE what is unchanged, ANALYZE what was added or modified, DELETE what is gone."""
    return changes.withColumn("action", F.when(F.col("change_kind") == "UNCHANGED", "REUSE").when(F.col("change_kind") == "DELETED", "DELETE").otherwise("ANALYZE"))


def previous_ready(snapshots: DataFrame) -> DataFrame:
    """snapshots with ``previous_id``: the READY snapshot of the repository with the latest strictly earlier created_at.

    A range window by time keeps snapshots of equal time apart from each other; the larger id wins among equal times.
    """
    w = Window.partitionBy("repository_id").orderBy(F.unix_micros("created_at")).rangeBetween(Window.unboundedPreceding, -1)
    ready = F.when(F.col("status") == "READY", F.struct("created_at", "id"))
    return snapshots.withColumn("previous_id", F.max(ready).over(w)["id"])


def symbol_pairs(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(previous_file_id, current_file_id, old_id, new_id, ...) of the symbols of unchanged files, with the ids they get.

    pairs: (previous_file_id, current_file_id). A symbol is known by qualified name, kind and lines; of several alike the largest
    old id stands for them.
    """
    s = symbols.join(pairs, F.col("source_file_id") == F.col("previous_file_id"))
    s = s.withColumn("new_id", ids.entity_id("symbols", "current_file_id", "kind", "qualified_name", "start_line", "end_line"))
    return s.select("previous_file_id", "current_file_id", F.col("id").alias("old_id"), "new_id", "name", "qualified_name", "kind", "start_line", "end_line", F.col("parent_symbol_id").alias("old_parent_id"))


def reuse_symbols(mapped: DataFrame) -> DataFrame:
    """The symbols of the new snapshot, parents carried over where the parent was; from ``symbol_pairs``."""
    parents = mapped.select("current_file_id", F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    j = mapped.alias("m").join(parents.alias("p"), (F.col("m.old_parent_id") == F.col("p._old")) & (F.col("m.current_file_id") == F.col("p.current_file_id")), "left")
    return j.select(
        F.col("m.new_id").alias("id"), F.col("m.current_file_id").alias("source_file_id"), "name", "qualified_name", "kind", "start_line", "end_line", F.col("p._new").alias("parent_symbol_id")
    ).dropDuplicates(["id"])


def remap_edges(edges: DataFrame, mapped: DataFrame, same_file: bool) -> DataFrame:
    """Symbol edges of reused files between the new symbols; only inside files, or only across them."""
    a = mapped.select(F.col("old_id").alias("_a"), F.col("new_id").alias("source_symbol_id_"), F.col("current_file_id").alias("_af"))
    b = mapped.select(F.col("old_id").alias("_b"), F.col("new_id").alias("target_symbol_id_"), F.col("current_file_id").alias("_bf"))
    j = edges.join(a, F.col("source_symbol_id") == F.col("_a")).join(b, F.col("target_symbol_id") == F.col("_b"))
    j = j.where((F.col("_af") == F.col("_bf")) if same_file else (F.col("_af") != F.col("_bf")))
    e = j.select(F.col("source_symbol_id_").alias("source_symbol_id"), F.col("target_symbol_id_").alias("target_symbol_id"), "kind")
    return e.withColumn("id", ids.symbol_edge_id()).dropDuplicates(["id"])


def remap_file_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Import edges between reused files, by the new files' ids."""
    a = pairs.select(F.col("previous_file_id").alias("_a"), F.col("current_file_id").alias("_an"))
    b = pairs.select(F.col("previous_file_id").alias("_b"), F.col("current_file_id").alias("_bn"))
    j = edges.join(a, F.col("source_file_id") == F.col("_a")).join(b, F.col("target_file_id") == F.col("_b"))
    e = j.select(F.col("_an").alias("source_file_id"), F.col("_bn").alias("target_file_id"), "kind").where("source_file_id <> target_file_id")
    return e.withColumn("id", ids.file_edge_id()).dropDuplicates(["id"])


def reuse_chunks(chunks: DataFrame, mapped: DataFrame, snapshot_of: DataFrame) -> DataFrame:
    """Chunks of reused files under the new snapshot, file and symbol, with ``old_id`` for the vectors.

    snapshot_of: (current_file_id, snapshot_id) of the new files.
    """
    m = mapped.select(F.col("old_id").alias("_s"), F.col("new_id").alias("_new_symbol"), F.col("current_file_id").alias("_file")).dropDuplicates(["_s", "_file"])
    s = snapshot_of.select(F.col("current_file_id").alias("_f"), F.col("snapshot_id").alias("_snap"))
    j = chunks.join(m, F.col("symbol_id") == F.col("_s")).join(s, F.col("_file") == F.col("_f"))
    j = j.withColumn("old_id", F.col("id")).withColumn("snapshot_id", F.col("_snap")).withColumn("source_file_id", F.col("_file")).withColumn("symbol_id", F.col("_new_symbol"))
    return j.withColumn("id", ids.chunk_id()).select(*chunks.columns, "old_id")


def reuse_vectors(vectors: DataFrame, reused: DataFrame) -> DataFrame:
    """Vectors of reused chunks under the new ids; a chunk without vector has none."""
    r = reused.select(F.col("old_id").alias("_old"), F.col("id").alias("_id"), F.col("snapshot_id").alias("_snap"), F.col("source_file_id").alias("_file"), F.col("symbol_id").alias("_sym"))
    j = vectors.join(r, F.col("chunk_id") == F.col("_old"))
    new = {"chunk_id": "_id", "snapshot_id": "_snap", "source_file_id": "_file", "symbol_id": "_sym"}
    return j.select(*[F.col(new.get(c, c)).alias(c) for c in vectors.columns])


def file_tree(files: DataFrame, *by: str) -> DataFrame:
    """(*by, path, name, depth, is_folder): every file and every folder above one, each once."""
    parts = F.split("relative_path", "/")
    p = files.select(*by, parts.alias("_p")).select(*by, "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    p = p.select(*by, F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "/").alias("path"), F.element_at("_p", F.col("depth")).alias("name"), "depth", (F.col("depth") < F.size("_p")).alias("is_folder"))
    return p.groupBy(*by, "path", "name", "depth").agg(F.max("is_folder").alias("is_folder"))
