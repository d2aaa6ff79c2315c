"""Orphan references kept while rows stream in: each micro-batch moves the keyed state by one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.orphans import OrphanState

#: kind is reference, arrival, deletion or purge; all but a reference use target_table, target_id and at.
EVENTS = "kind string, table_name string, record_id string, target_table string, target_id string, at timestamp"


def advance(state: OrphanState, events: DataFrame, batch: int) -> None:
    """Move ``state`` by the events (``EVENTS``) of one micro-batch; one that was done before changes nothing."""
    kept = events.persist()
    try:
        references = kept.where("kind = 'reference'").select("table_name", "record_id", "target_table", "target_id", F.col("at").alias("referred_at"))
        state.advance(references, kept.where("kind <> 'reference'").select("target_table", "target_id", F.col("kind").alias("event"), "at"), batch)
    finally:
        kept.unpersist()


def start(state: OrphanState, stream: DataFrame, checkpoint: str):
    """Follow a stream of events; the query is returned running. A restart takes a new state over the same folder."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: advance(state, df, i)).start()
