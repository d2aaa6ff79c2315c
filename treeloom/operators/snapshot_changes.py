"""What changed between full snapshots: a bucketed key-to-hash index that each delivery probes and then replaces.

``advance`` is one delivery: it compares only key and hash, fetches payload for changed keys, and returns the next index.
``SnapshotIndex`` keeps the index as a table in buckets of a shared folder, for any number of series (repositories) at once, and
swaps it delivery by delivery; ``history`` feeds a whole history through it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.session import BROADCAST_ROWS, broadcast_if_small
from treeloom.sources.keyed import KeyedTable

ADDED, MODIFIED, DELETED = "ADDED", "MODIFIED", "DELETED"


def advance(index: DataFrame, new: DataFrame, payload: list[str] | None = None, old_rows: DataFrame | None = None, on: tuple[str, ...] = ("key",)) -> tuple[DataFrame, DataFrame]:
    """(changes, next index) of one delivery. index: (*on, hash); new: (*on, hash, *payload); both unique by ``on``.

    The join carries keys and hashes only; old values, when asked for by ``old_rows``, are fetched for changed keys alone. A null
    hash equals a null hash only.
    """
    here, there = F.lit(True), [F.col(c).alias(f"_{c}") for c in on]
    n = new.select(*there, F.col("hash").alias("_h"), here.alias("_new"))
    o = index.select(*on, "hash", here.alias("_old"))
    j = o.join(n, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in on]), "full_outer")
    kind = F.when(F.col("_old").isNull(), ADDED).when(F.col("_new").isNull(), DELETED).when(~F.col("hash").eqNullSafe(F.col("_h")), MODIFIED)
    changes = j.select(*[F.coalesce(c, f"_{c}").alias(c) for c in on], F.col("hash").alias("old_hash"), F.col("_h").alias("new_hash"), kind.alias("change_kind")).where("change_kind is not null")
    if payload and old_rows is not None:
        old = old_rows.select(*on, *[F.col(c).alias(f"old_{c}") for c in payload])
        fresh = new.select(*on, *[F.col(c).alias(f"new_{c}") for c in payload])
        changes = changes.join(old, list(on), "left").join(fresh, list(on), "left")
    return changes, new.select(*on, "hash")


class SnapshotIndex:
    """The index on disk. A delivery reads it once, writes its changes and the next index, and swaps by one rename.

    The number of a delivery is the number of its commit, so a new object over the same folder goes on where the last one stopped.
    """

    CHANGES = "series string, key string, old_hash string, new_hash string, change_kind string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self._table = KeyedTable(spark, f"{self.path}/index", "series string, key string, hash string", ["series", "key"], buckets)

    @property
    def version(self) -> int:
        """The number of the latest delivery, -1 before the first."""
        return self._table.version

    def read(self) -> DataFrame:
        return self._table.read()

    def deliver(self, new: DataFrame, number: int | None = None, series: DataFrame | None = None, small: bool | None = None) -> DataFrame:
        """The changes of one delivery of (key, hash), or (series, key, hash) with the ``series`` (column series) that it is for.

        All keys of a delivered series that don't come are deleted, also where the series came empty; series that aren't
        delivered stay as they are. Rows with a null key, or of a series that isn't delivered, are dropped. ``small`` says whether
        ``series`` was counted to be fit for a broadcast; without it, it is counted.
        """
        number = self.version + 1 if number is None else number
        changes_at = f"{self.path}/changes/v={number}"
        if number > self.version:
            fresh = new.where("key is not null") if series is not None else new.where("key is not null").select(F.lit("").alias("series"), "key", "hash")
            old = self.read()
            if series is not None:
                named = series.select("series").distinct()
                named = broadcast_if_small(named) if small is None else F.broadcast(named) if small else named
                fresh, rest, old = fresh.join(named, "series", "left_semi"), old.join(named, "series", "left_anti"), old.join(named, "series", "left_semi")
            changes, index = advance(old, fresh, on=("series", "key"))
            changes.write.mode("overwrite").parquet(changes_at)
            if series is not None:
                index = index.unionByName(rest.select(*index.columns))
            self._table.replace(index, range(self._table.buckets), number)
        return self.spark.read.schema(self.CHANGES).parquet(changes_at)


def history(index: SnapshotIndex, rows: DataFrame, steps: DataFrame, seqs: int) -> DataFrame:
    """(snapshot_id, key, change_kind) between each delivery and the one before it in its series, by the index.

    rows: (snapshot_id, key, hash), a row per snapshot and key; steps: (snapshot_id, series, seq), seq counting from 1 to at most
    ``seqs`` without gaps. Delivery n holds the n-th snapshots of all series, so the loop is as long as the longest history and each
    round reads the rows of its snapshots and the index, nothing else. Rows of snapshots not in ``steps`` play no part; the first
    snapshot of a series has no changes.
    """
    out, small = None, steps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for seq in range(1, seqs + 1):
        now = steps.where(F.col("seq") == seq).select("series", "snapshot_id")
        now = F.broadcast(now) if small else now
        fresh = rows.where(F.col("seq") == seq) if "seq" in rows.columns else rows
        changes = index.deliver(fresh.join(now, "snapshot_id").select("series", "key", "hash"), index.version + 1, now, small)
        if seq > 1:
            named = changes.join(now, "series").select("snapshot_id", "key", "change_kind")
            out = named if out is None else out.unionByName(named)
    if out is None:
        return rows.sparkSession.createDataFrame([], "snapshot_id string, key string, change_kind string")
    return out
