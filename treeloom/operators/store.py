"""Writes over keyed tables as DataFrame rewrites: upserts, deletes with counts, lookups and the purge of a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_write(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key, the one written last; of rows written at once the largest. Aggregated before the shuffle."""
    others = [c for c in rows.columns if c not in (key, seq)]
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(seq, *others)).alias("_r"))
    return g.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def with_first_position(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """As ``last_write``, with the position of the key's first write as ``position``: an overwrite keeps its place."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("position"))
    return last_write(rows, key, seq).join(first, key)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` put in by key. ``new`` must hold a key once (see ``last_write``)."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_where(table: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of those deleted). A condition that is null keeps its row."""
    gone = F.coalesce(condition, F.lit(False))
    return table.where(~gone), table.agg(F.count_if(gone).alias("deleted"))


def delete_in(table: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete rows whose ``column`` is among the single column ``keys``; an empty list deletes nothing."""
    k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    on = F.col(column) == F.col("_k")
    return table.join(k, on, "left_anti"), table.join(k, on, "left_semi").agg(F.count("*").alias("deleted"))


def delete_touching(edges: DataFrame, source: str, target: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete edges with either end among ``nodes``; an edge with both ends counts once."""
    k = nodes.select(F.col(nodes.columns[0]).alias("_k")).distinct()
    kept = edges.join(k, F.col(source) == F.col("_k"), "left_anti").join(k, F.col(target) == F.col("_k"), "left_anti")
    by_source = edges.join(k, F.col(source) == F.col("_k"), "left_semi")
    by_target = edges.join(k, F.col(source) == F.col("_k"), "left_anti").join(k, F.col(target) == F.col("_k"), "left_semi")
    return kept, by_source.unionByName(by_target).agg(F.count("*").alias("deleted"))


def by_key(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == value).limit(1)


def listed(table: DataFrame, order: Sequence[str], **equal: str) -> DataFrame:
    """Rows with the given values in the given order; ties by id, so that the order is total."""
    tail = [c for c in ("id", "chunk_id") if c in table.columns and c not in order]
    return reduce(lambda t, kv: t.where(F.col(kv[0]) == kv[1]), equal.items(), table).orderBy(*order, *tail)


def newest(table: DataFrame, by: str, at: str = "created_at") -> DataFrame:
    """The newest row of each ``by``; equal times fall to the larger id."""
    others = [c for c in table.columns if c not in (by, at)]
    order = (["id"] if "id" in others else []) + [c for c in others if c != "id"]
    g = table.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(F.struct(at, *order)).alias("_r"))
    return g.select(*[F.col(by) if c == by else F.col(f"_r.{c}").alias(c) for c in table.columns])


def repeated(table: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once: breaches of a uniqueness rule."""
    return table.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


PURGED = ("vectors", "symbol_relations", "source_file_relations", "import_references", "chunks", "symbols", "source_files", "snapshots")


def purge(tables: dict[str, DataFrame], snapshots: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the given snapshots, counts (snapshot_id, table_name, deleted)) for any number of snapshots at once.

    The order is vectors, symbol edges, file edges, imports, chunks, symbols, files, the snapshot; jobs stay. Edges go when
    either end goes; one with ends in two purged snapshots counts for the snapshot of its source.
    """
    s = snapshots.select(F.col(snapshots.columns[0]).alias("_snap")).distinct()
    files = tables["source_files"].join(s, F.col("snapshot_id") == F.col("_snap")).select(F.col("id").alias("_file"), "_snap")
    symbols = tables["symbols"].join(files, F.col("source_file_id") == F.col("_file")).select(F.col("id").alias("_sym"), "_snap")
    out, counts = {}, []

    def drop(name: str, column: str, keys: DataFrame, key: str) -> None:
        t = tables.get(name)
        if t is not None:
            out[name] = t.join(keys, F.col(column) == F.col(key), "left_anti")
            counts.append(t.join(keys, F.col(column) == F.col(key)).select("_snap", F.lit(name).alias("table_name")))

    def drop_edges(name: str, source: str, target: str, keys: DataFrame, key: str) -> None:
        t = tables.get(name)
        if t is not None:
            out[name] = t.join(keys, F.col(source) == F.col(key), "left_anti").join(keys, F.col(target) == F.col(key), "left_anti")
            a = t.join(keys, F.col(source) == F.col(key)).select("_snap")
            b = t.join(keys, F.col(source) == F.col(key), "left_anti").join(keys, F.col(target) == F.col(key)).select("_snap")
            counts.append(a.unionByName(b).select("_snap", F.lit(name).alias("table_name")))

    drop("vectors", "snapshot_id", s, "_snap")
    drop_edges("symbol_relations", "source_symbol_id", "target_symbol_id", symbols, "_sym")
    drop_edges("source_file_relations", "source_file_id", "target_file_id", files, "_file")
    drop("import_references", "source_file_id", files, "_file")
    drop("chunks", "snapshot_id", s, "_snap")
    drop("symbols", "source_file_id", files, "_file")
    drop("source_files", "snapshot_id", s, "_snap")
    drop("snapshots", "id", s, "_snap")
    rest = {n: t for n, t in tables.items() if n not in out}
    all_ = reduce(DataFrame.unionByName, counts).groupBy(F.col("_snap").alias("snapshot_id"), "table_name").agg(F.count("*").alias("deleted"))
    return out | rest, all_


def first_positions(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows whose keys did not occur before, in the order of ``seq``."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
