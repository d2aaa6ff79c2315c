"""Full snapshots that arrive as files: each delivery is compared with the index of the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.snapshot_changes import SnapshotIndex


def follow(stream: DataFrame, index: SnapshotIndex, checkpoint: str):
    """Write the changes of every delivery of (key, hash) rows below the index; one micro-batch is one delivery.

    The batch's number is the delivery's, so one that is replayed, also by a new index over the same folder, isn't taken twice.
    """

    def deliver(df: DataFrame, batch: int) -> None:
        if batch > index.version:
            index.deliver(df.groupBy("key").agg(F.max("hash").alias("hash")), batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver).start()
