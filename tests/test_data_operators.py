import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from treeloom.functions.records import latest, path_key, uuid_key
from treeloom.operators import hierarchy, orphans, snapshot_changes
from treeloom.operators.orphans import OrphanState
from treeloom.sources.keyed import KeyedTable
from treeloom.streaming import orphan_stream
from treeloom.streaming.orphan_stream import EVENTS

T0 = datetime(2025, 1, 1, tzinfo=UTC)
DAY = timedelta(days=1)


def test_spellings(spark):
    u = "0a0bbd54-d675-51f6-a55c-e543e5e1e309"
    rows = [u, u.upper() + "\t", f"urn:uuid:{u}", "{" + u + "}", u.replace("-", ""), " " + u, None, "", "0a33bf3a-9182"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(uuid_key("x")).collect()]
    assert got == [u] * 6 + [None, "", "0a33bf3a-9182"]
    paths = ["a/b.py", "./a/b.py", "a\\b.py", "a//b.py", "a/./b.py", "././a/b.py ", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(paths)], "i int, x string").orderBy("i").select(path_key("x")).collect()]
    assert got == ["a/b.py"] * 6 + [None]


def test_latest_takes_the_row_that_holds(spark):
    df = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + DAY), ("a", 3, T0 + DAY), ("b", 1, None), ("b", 2, T0), (None, 9, T0)], "id string, v int, recorded_at timestamp")
    assert {tuple(r) for r in latest(df, ["id"], ["v"]).collect()} == {("a", 3), ("b", 2)}
    assert {tuple(r) for r in latest(df, ["id"], ["v"], first=True).collect()} == {("a", 1), ("b", 2)}
    assert latest(df.limit(0), ["id"], ["v"]).count() == 0


def _brute(parents: dict):
    out = {}
    for n in parents:
        seen, at = [], n
        while at not in seen and parents.get(at) in parents:
            seen.append(at)
            at = parents[at]
        out[n] = (at, len(seen)) if at not in seen else (min(seen[seen.index(at) :]), -1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trees_cycles_and_gaps(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03}" for i in range(120)]
    parents = {}
    for i, n in enumerate(ids):
        x = rng.random()
        parents[n] = None if x < 0.05 else "gone" if x < 0.1 else ids[i - 1] if x < 0.6 and i else rng.choice(ids)
    got = {r["id"]: (r["root_id"], r["depth"]) for r in hierarchy.contract(spark.createDataFrame(list(parents.items()), "id string, parent_id string")).collect()}
    assert got == _brute(parents)


def test_long_chain_hot_parent_and_paths(spark):
    rows = [(f"c{i:04}", f"c{i - 1:04}" if i else None, f"x{i}") for i in range(300)] + [(f"leaf{i}", "c0000", None) for i in range(200)] + [("loop", "loop", "l"), ("into", "loop", "i"), (None, "c0000", "z")]
    df = spark.createDataFrame(rows, "id string, parent_id string, name string").withColumn("w", F.lit(1)).withColumn("lo", F.lit("clash"))
    p = {r["id"]: r for r in hierarchy.contract(df, label="name").collect()}
    assert len(p) == 502
    assert p["c0299"]["depth"] == 299 and p["c0299"]["path"] == [f"x{i}" for i in range(300)]
    assert p["leaf7"]["path"] == ["x0", "leaf7"] and p["loop"]["depth"] == -1 and p["into"]["root_id"] == "loop" and p["into"]["path"] is None
    d = hierarchy.descendants(hierarchy.contract(df.where("id like 'c000%'"), label="name"))
    assert d.count() == 45 and d.where("ancestor_id = 'c0000'").count() == 9
    assert hierarchy.contract(df.limit(0)).count() == 0


REFS = [("chunks", "r1", "symbols", "s1", T0), ("chunks", "r2", "symbols", "s2", T0), ("chunks", "r3", "symbols", "gone", T0), ("chunks", "r4", "symbols", "never", T0), ("chunks", "r5", "symbols", None, T0), ("files", "r6", "files", "s1", None)]


def test_orphans(spark):
    refs = spark.createDataFrame(REFS, orphans.REFERENCES).withColumn("purged", F.lit("clash"))
    rows = spark.createDataFrame([("s1", T0), ("s1", T0 + DAY), ("s2", T0 + DAY)], "id string, recorded_at timestamp")
    gone = spark.createDataFrame([("gone", "symbols"), ("s1", "symbols"), (None, "symbols")], "record_id string, record_table string")
    arrived = orphans.arrivals(rows, "symbols").unionByName(orphans.purges(gone.withColumn("at", F.lit(None)), "record_id", "record_table", "at"))
    none = spark.createDataFrame([], orphans.PARENTS)
    probe = lambda r, e: orphans.probe(r, orphans.index_parents(none, e)).where("orphan_kind is not null")
    got = {(r["record_id"], r["orphan_kind"]) for r in probe(refs, arrived).collect()}
    assert got == {("r2", "late"), ("r3", "deleted"), ("r4", "missing"), ("r6", "missing")}
    assert probe(refs.limit(0), arrived).count() == 0
    assert orphans.counts(probe(refs, arrived.limit(0))).agg(F.sum("orphans")).first()[0] == 5


def _orphans_by_hand(events):
    """target -> arrivals after its last deletion, the names that a deletion or a log gave, and what that makes of each reference."""
    out = {}
    for kind, _, r, _, t, at in events:
        if kind == "reference" and t is not None:
            of = [e for e in events if e[4] == t]
            gone = max((e[5] for e in of if e[0] == "deletion"), default=None)
            seen = [e[5] for e in of if e[0] == "arrival" and (gone is None or e[5] > gone)]
            named = gone is not None or any(e[0] == "purge" for e in of)
            out[r] = None if seen and min(seen) <= at else "late" if seen else "deleted" if named else "missing"
    return {(r, k) for r, k in out.items() if k}


def test_orphan_state_by_steps_with_a_new_object_each(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["reference"] * 5 + ["arrival"] * 3 + ["deletion", "purge"]
    events = [(rng.choice(kinds), "chunks", f"r{i}", "symbols", f"s{rng.randrange(25)}", T0 + timedelta(hours=i)) for i in range(160)]
    events.append(("reference", "chunks", "none", "symbols", None, T0))
    for b in range(4):
        batch = spark.createDataFrame(events[b * 40 : b * 40 + 40 + (b == 3)], EVENTS)
        for _ in range(2):  # a replayed batch changes nothing
            orphan_stream.advance(OrphanState(spark, str(tmp_path), buckets=5), batch, b)
    once = OrphanState(spark, str(tmp_path / "once"))
    orphan_stream.advance(once, spark.createDataFrame(events, EVENTS), 0)
    pick = lambda s: {(r["record_id"], r["orphan_kind"]) for r in s.orphans().collect()}
    state = OrphanState(spark, str(tmp_path))
    assert pick(state) == pick(once) == _orphans_by_hand(events) and len(pick(once)) > 20
    # A batch that failed after the parents were committed is taken up where it stopped.
    more = [("reference", "chunks", "x1", "symbols", "s1", T0), ("deletion", None, None, "symbols", "s1", T0 + timedelta(days=99))]
    batch = spark.createDataFrame(more, EVENTS)
    half = OrphanState(spark, str(tmp_path))
    half._parents.replace(orphans.index_parents(half._parents.read(), batch.where("kind = 'deletion'").selectExpr("target_table", "target_id", "kind event", "at")), range(5), 4)
    orphan_stream.advance(OrphanState(spark, str(tmp_path)), batch, 4)
    assert {k for r, k in pick(OrphanState(spark, str(tmp_path))) if r == "x1"} == {"deleted"}


def test_keyed_tables_touch_what_they_must(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k string, v int", ["k"], buckets=7)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    t.replace(rows, range(7), 0)
    one = rows.where("k = 'k3'").withColumn("v", F.lit(-1))
    at = t.touched(one)
    assert len(at) == 1
    t.replace(t.read(at).join(one.select("k"), "k", "left_anti").unionByName(one), at, 1)
    again = KeyedTable(spark, str(tmp_path), "k string, v int", ["k"], buckets=3)
    assert again.buckets == 7 and again.version == 1
    assert {r["k"]: r["v"] for r in again.read().collect()} == {f"k{i}": -1 if i == 3 else i for i in range(50)}
    again.replace(rows.limit(0), again.touched(rows), 2)
    assert again.read().count() == 0
    with pytest.raises(ValueError):
        again.replace(rows, range(7), 2)


def _chain(history):
    out = []
    for i in range(1, len(history)):
        a, b = history[i - 1], history[i]
        out += [(f"v{i + 1}", k, "ADDED" if k not in a else "DELETED" if k not in b else "MODIFIED") for k in {*a, *b} if a.get(k, 0) != b.get(k, 0)]
    return sorted(out)


def test_changes_between_all_snapshots(spark, tmp_path):
    rng = random.Random(3)
    history = [{f"p{k}": rng.choice(["h1", "h2", None]) for k in rng.sample(range(40), 25)} for _ in range(5)] + [{}, {"p1": "h"}]
    rows = [(f"v{i + 1}", k, h, T0) for i, s in enumerate(history) for k, h in s.items()] + [("unknown", "p1", "h", T0), ("v1", None, "h", T0), ("v1", "p77", "old", None)]
    history[0]["p77"] = "old"
    n = len(history)
    steps = spark.createDataFrame([(f"v{i + 1}", "repo", i + 1) for i in range(n)] + [("w1", "other", 1), ("w2", "other", 2)], "snapshot_id string, series string, seq int")
    rows += [("w1", "p1", "h", T0), ("w2", "p1", "h2", T0)]
    df = spark.createDataFrame(rows, "snapshot_id string, key string, hash string, recorded_at timestamp").withColumn("series", F.lit("clash"))
    df = latest(df, ["snapshot_id", "key"], ["hash"])
    through = lambda d, at: sorted(tuple(r) for r in snapshot_changes.history(snapshot_changes.SnapshotIndex(spark, str(tmp_path / at), 3), d, steps, n).collect())
    assert through(df, "all") == sorted([*_chain(history), ("w2", "p1", "MODIFIED")])
    got = _chain(history)
    by_index = []
    for i, s in enumerate(history):
        ch = snapshot_changes.SnapshotIndex(spark, str(tmp_path / "one"), buckets=4).deliver(spark.createDataFrame(list(s.items()), "key string, hash string")).collect()
        by_index += [(f"v{i + 1}", r["key"], r["change_kind"]) for r in ch if i]
    assert sorted(by_index) == got
    assert through(df.limit(0), "none") == []
    assert snapshot_changes.history(snapshot_changes.SnapshotIndex(spark, str(tmp_path / "no")), df, steps, 0).count() == 0
