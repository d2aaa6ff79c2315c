from datetime import UTC, datetime, timedelta

from treeloom.operators.orphans import OrphanState
from treeloom.operators.snapshot_changes import SnapshotIndex
from treeloom.streaming import orphan_stream, snapshot_stream
from treeloom.streaming.orphan_stream import EVENTS

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def _deliver(spark, at, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def test_orphans_of_a_stream(spark, tmp_path):
    at = str(tmp_path / "events")
    ref = lambda r, s, h: ("reference", "chunks", r, "symbols", s, T0 + timedelta(hours=h))
    parent = lambda s, h: ("arrival", None, None, "symbols", s, T0 + timedelta(hours=h))
    steps = [
        ([ref("r1", "s1", 5), ref("r2", "s2", 5), ref("r3", None, 5)], {"r1": "missing", "r2": "missing"}),
        ([parent("s1", 1), parent("s2", 9), ("purge", None, None, "symbols", "s3", T0), ("purge", None, None, "symbols", "s1", T0)], {"r2": "late"}),
        ([ref("r4", "s3", 1), parent("s2", 2), ref("r5", "s1", 0)], {"r4": "deleted", "r5": "late"}),
        ([("deletion", None, None, "symbols", "s1", T0 + timedelta(hours=20))], {"r4": "deleted", "r5": "deleted", "r1": "deleted"}),
        ([parent("s1", 10)], {"r4": "deleted", "r5": "deleted", "r1": "deleted"}),
        ([parent("s1", 30)], {"r4": "deleted", "r5": "late", "r1": "late"}),
    ]
    for rows, want in steps:
        _deliver(spark, at, rows, EVENTS)
        state = OrphanState(spark, str(tmp_path / "state"), buckets=3)  # a new object each time, as after a restart
        query = orphan_stream.start(state, spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(at), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        assert {r["record_id"]: r["orphan_kind"] for r in state.orphans().collect()} == want
    assert OrphanState(spark, str(tmp_path / "state")).version == len(steps) - 1


def test_changes_of_a_stream(spark, tmp_path):
    at, schema = str(tmp_path / "deliveries"), "key string, hash string"
    for i, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1"), ("c", "1")]]):
        _deliver(spark, at, rows, schema)
        index = SnapshotIndex(spark, str(tmp_path / "index"), buckets=2)
        query = snapshot_stream.follow(spark.readStream.schema(schema).parquet(at), index, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
        assert index.version == i and SnapshotIndex(spark, str(tmp_path / "index")).version == i
    got = spark.read.parquet(f"{tmp_path}/index/changes/v=1")
    assert {(r["key"], r["change_kind"]) for r in got.collect()} == {("a", "MODIFIED"), ("b", "DELETED"), ("c", "ADDED")}
