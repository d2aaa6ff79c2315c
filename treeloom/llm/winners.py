"""Rows that hold, without shuffling wide columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.records import uuid_key
from treeloom.session import broadcast_if_small


def key16(x: Column) -> Column:
    """A uuid as 16 bytes; None for what isn't one."""
    return F.when(F.length(x) == 36, F.unhex(F.translate(x, "-", "")))


def holding_rows(df: DataFrame, key: str, at: str = "recorded_at", norm: Callable[[Column], Column] = uuid_key) -> DataFrame:
    """The rows of ``df`` that hold (latest ``at`` per key), as wide as they came, with ``key`` in normal form as ``_key``.

    Only keys and times are shuffled, to find the times that lost; the wide rows meet the losing (key, time) pairs by an anti
    join, broadcast where they were counted to be few. Rows of one key with equal times all stay: repeated deliveries of
    one row, which the operators treat as one record because they carry one key. A null key drops the row, a null time is oldest.
    """
    t = F.coalesce(F.unix_micros(at), F.lit(-(2**62)))
    keyed = df.withColumn("_key", norm(F.col(key))).withColumn("_at", t).where("_key is not null")
    slim = keyed.select("_key", "_at")
    best = slim.groupBy("_key").agg(F.max("_at").alias("_best"), F.min("_at").alias("_first")).where("_first < _best")
    lost = broadcast_if_small(best.select(F.col("_key").alias("_k"), "_best"))
    return keyed.join(lost, (F.col("_key") == F.col("_k")) & (F.col("_at") < F.col("_best")), "left_anti").drop("_at")


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by the hash of ``key`` where they lie, never more than twice as many.

    Nothing is sorted or shuffled, so the cost of a sample doesn't grow with the number of tasks; a small table is taken whole.
    """
    if total <= rows:
        return df
    share = int(rows / total * (1 << 40))
    return df.where(F.shiftrightunsigned(F.xxhash64(key), 24) < share).limit(2 * rows)
