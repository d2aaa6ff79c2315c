"""References to records that do not exist, kept as keyed state that new rows of any side move forward.

State, all of it keyed by the target: ``parents`` holds when a key was first and last seen, when it was last deleted and whether a
log of deletions names it; ``references`` holds every reference with its orphan_kind, null while it has its parent. A step takes any
number of new references and events: new references probe the index, arriving parents resolve or re-date waiting references,
deletions reopen resolved ones. ``OrphanState`` keeps both sides in buckets of a shared folder and touches only the buckets of
a batch; queries and the stream (treeloom.streaming.orphan_stream) move the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.session import broadcast_if_small
from treeloom.sources.keyed import KeyedTable

REFERENCES = "table_name string, record_id string, target_table string, target_id string, referred_at timestamp"
PARENTS = "target_table string, target_id string, first_seen timestamp, last_seen timestamp, deleted_at timestamp, named boolean"
#: Events of targets: ``arrival`` of a row, ``deletion`` of its rows, ``purge`` for an entry of a log that leaves the rows that are there.
EVENTS = "target_table string, target_id string, event string, at timestamp"
_OLDEST = "0001-01-01"


def arrivals(rows: DataFrame, table: str, key: str = "id", at: str = "recorded_at") -> DataFrame:
    return rows.select(F.lit(table).alias("target_table"), F.col(key).alias("target_id"), F.lit("arrival").alias("event"), F.col(at).cast("timestamp").alias("at"))


def purges(log: DataFrame, record_id: str, record_table: str, at: str) -> DataFrame:
    return log.select(F.col(record_table).alias("target_table"), F.col(record_id).alias("target_id"), F.lit("purge").alias("event"), F.col(at).cast("timestamp").alias("at"))


def index_parents(parents: DataFrame, events: DataFrame) -> DataFrame:
    """The parent index moved by a batch of events, one row per target. Partial aggregation folds repeated keys before the shuffle.

    A row that arrived without a time counts as the oldest. Rows are there from their first arrival after the last deletion; of
    rows that arrived before a deletion that comes in late, only the latest is remembered.
    """
    key = ["target_table", "target_id"]
    e = events.where("target_id is not null and target_table is not null").withColumn("at", F.coalesce("at", F.lit(_OLDEST).cast("timestamp")))
    arrival, deletion = F.when(F.col("event") == "arrival", F.col("at")), F.when(F.col("event") == "deletion", F.col("at"))
    flat = e.select(*key, arrival.alias("first_seen"), arrival.alias("last_seen"), deletion.alias("deleted_at"), (F.col("event") == "purge").alias("named"))
    rows = parents.select(*flat.columns).unionByName(flat)
    gone = rows.where("deleted_at is not null").groupBy(*key).agg(F.max("deleted_at").alias("_gone"))
    rows = rows.join(broadcast_if_small(gone), key, "left")
    after = lambda c: F.when(F.col("_gone").isNull() | (F.col(c) > F.col("_gone")), F.col(c))
    return rows.groupBy(*key).agg(
        F.min(F.coalesce(after("first_seen"), after("last_seen"))).alias("first_seen"), F.max(after("last_seen")).alias("last_seen"),
        F.max("_gone").alias("deleted_at"), F.max(F.col("named") | F.col("_gone").isNotNull()).alias("named"),
    )


def probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``references`` with orphan_kind: null for those that found their parent in time.

    ``late``: the target has rows, all later than the reference; ``deleted``: no row but a deletion names it; else ``missing``.
    A null target refers to nothing and leaves; a reference without time counts as older than any parent with a time. Many
    references to one target are a skewed left side, which adaptive execution splits; the index side has one row per key.
    """
    p = parents.select(F.col("target_table").alias("_t"), F.col("target_id").alias("_id"), F.col("first_seen").alias("_seen"), F.col("named").alias("_named"))
    j = references.where("target_id is not null").join(p, (F.col("target_table") == F.col("_t")) & (F.col("target_id") == F.col("_id")), "left")
    late = F.col("_seen") > F.coalesce(F.col("referred_at"), F.lit(_OLDEST).cast("timestamp"))
    kind = F.when(late, "late").when(F.col("_seen").isNotNull(), None).when(F.coalesce(F.col("_named"), F.lit(False)), "deleted").otherwise("missing")
    return j.select(*[c for c in references.columns if c != "orphan_kind"], kind.alias("orphan_kind"))


def step(parents: DataFrame, references: DataFrame, new_references: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move the state by one batch: (new parents, all references with their orphan_kind)."""
    now = index_parents(parents, events)
    return now, probe(references.select(*new_references.columns).unionByName(new_references), now)


class OrphanState:
    """Parents and references in buckets by target. A batch reads and writes the buckets it touches and no other.

    The number of a batch is the number of its commit, so a batch that is replayed changes nothing, also by a new object after a
    restart. Parents are committed first: a batch that failed between the two finds its parents done and goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        key = ["target_table", "target_id"]
        self.spark, self.path = spark, path.rstrip("/")
        self._parents = KeyedTable(spark, f"{self.path}/parents", PARENTS, key, buckets)
        self._references = KeyedTable(spark, f"{self.path}/references", f"{REFERENCES}, orphan_kind string", key, self._parents.buckets)

    @property
    def version(self) -> int:
        return self._references.version

    def parents(self) -> DataFrame:
        return self._parents.read()

    def references(self) -> DataFrame:
        return self._references.read()

    def orphans(self) -> DataFrame:
        """The references that are orphans now."""
        return self.references().where("orphan_kind is not null")

    def advance(self, references: DataFrame, events: DataFrame, batch: int, everywhere: bool = False) -> None:
        """One batch of references (``REFERENCES``) and events (``EVENTS``); both are read more than once.

        ``everywhere`` saves the look for touched buckets where a batch is known to be large.
        """
        if batch <= self.version:
            return
        references, events = references.where("target_id is not null"), events.where("target_id is not null")
        touched = range(self._parents.buckets) if everywhere else self._parents.touched(references, events)
        if self._parents.version < batch:
            self._parents.replace(index_parents(self._parents.read(touched), events), touched, batch)
        waiting = self._references.read(touched).select(*references.columns).unionByName(references)
        self._references.replace(probe(waiting, self._parents.read(touched)), touched, batch)


def counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, kind and month of the reference; a reference without time counts under a null month."""
    m = F.date_format("referred_at", "yyyy-MM").alias("month")
    return orphans.groupBy("table_name", "orphan_kind", m).agg(F.count("*").alias("orphans"))
