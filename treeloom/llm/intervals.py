"""Unions of intervals per key, as windows over sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Disjoint intervals [start, stop) covering the same positions per key; touching ones are joined."""
    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col(start)).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_run")
