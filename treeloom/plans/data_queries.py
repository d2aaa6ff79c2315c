"""Registered queries of the general data operators, with their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.records import latest, strip, uuid_key
from treeloom.operators import hierarchy, orphans, snapshot_changes
from treeloom.session import broadcast_if_small, materialize, shared_dir
from treeloom.sources import project as P
from treeloom.sources.keyed import buckets_for


def _trees(spark: SparkSession, sf_dir: str, label: str | None = None) -> DataFrame:
    s = P.symbols(spark, sf_dir).select("id", F.col("parent_symbol_id").alias("parent_id"), *([label] if label else []))
    return hierarchy.contract(s, label=label)


def p3_found(spark, sf_dir):
    """Root and depth of every symbol; -1 and the cycle's smallest id where the chain never ends."""
    return _trees(spark, sf_dir).select(F.col("id").alias("symbol_id"), "root_id", F.col("depth").cast("int").alias("depth"))


def p3_paths(spark, sf_dir):
    """Full path of every symbol from its root, by names; null for symbols of cycles."""
    t = _trees(spark, sf_dir, "name")
    return t.select(F.col("id").alias("symbol_id"), "root_id", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("full_path"))


def p3_descendants(spark, sf_dir):
    """Every ancestor-descendant pair of the trees with its distance."""
    return hierarchy.descendants(_trees(spark, sf_dir, "name"))


def p3_cycles(spark, sf_dir):
    """Each cycle by its smallest id, with the number of symbols on it or leading into it."""
    return _trees(spark, sf_dir).where("depth = -1").groupBy(F.col("root_id").alias("cycle_id")).agg(F.count("*").alias("symbols"))


#: Batches that the history of references and targets is moved through the state in.
_PERIODS = 3


def _orphans(spark, sf_dir):
    """The orphans after the whole history went through the keyed state, period by period."""
    T = lambda n: P.table(spark, sf_dir, n)

    def refs(name, col, target):
        r = T(name).select(uuid_key("id").alias("record_id"), uuid_key(col).alias("target_id"), F.col("recorded_at").alias("referred_at"))
        r = r.where("record_id is not null").groupBy("record_id").agg(F.min(F.struct(F.coalesce("referred_at", F.lit("9999-12-31").cast("timestamp")).alias("o"), F.col("target_id"), F.col("referred_at"))).alias("_r"))
        return r.select(F.lit(name).alias("table_name"), "record_id", F.lit(target).alias("target_table"), F.col("_r.target_id").alias("target_id"), F.col("_r.referred_at").alias("referred_at")).where("target_id is not null")

    references = refs("symbol_relations", "target_symbol_id", "symbols").unionByName(refs("chunks", "symbol_id", "symbols")).unionByName(refs("source_file_relations", "target_file_id", "source_files"))
    rows = lambda n: orphans.arrivals(T(n).select(uuid_key("id").alias("id"), "recorded_at"), n)
    log = T("purge_log").select(uuid_key("record_id").alias("record_id"), F.lower(strip("record_table")).alias("record_table"), "purged_at")
    events = rows("symbols").unionByName(rows("source_files")).unionByName(orphans.purges(log.where("record_table in ('symbols', 'source_files')"), "record_id", "record_table", "purged_at"))
    references = materialize(references, "references")
    ends = references.agg(F.min("referred_at"), F.max("referred_at"), F.count("*")).first()
    first, last = ends[0] or datetime(2000, 1, 1), ends[1] or datetime(2000, 1, 1)
    edges = [first + (last - first) * k / _PERIODS for k in range(1, _PERIODS)]
    state = orphans.OrphanState(spark, f"{shared_dir(spark)}/treeloom/orphans-{uuid.uuid4().hex}", buckets_for(ends[2]))
    for k in range(_PERIODS):
        inside = lambda c: (F.lit(True) if k == 0 else c >= edges[k - 1]) & (F.lit(True) if k == _PERIODS - 1 else c < edges[k])  # noqa: E731, B023
        within = lambda c: F.coalesce(inside(F.col(c)), F.lit(k == 0))  # noqa: E731, B023
        state.advance(references.where(within("referred_at")), events.where(within("at")), k, everywhere=True)
    return state.orphans()


def p4_found(spark, sf_dir):
    """Each referring record whose earliest row names a target without a row in time."""
    return _orphans(spark, sf_dir).select("table_name", "record_id", "orphan_kind")


def p4_by_month(spark, sf_dir):
    """Orphans per table, kind and month of recorded_at."""
    return orphans.counts(_orphans(spark, sf_dir))


def _changes(spark, sf_dir):
    """All changes, delivery by delivery through the index; what the tables say is sorted into deliveries once."""
    steps = P.deliveries(spark, sf_dir).select("snapshot_id", "series", "seq")
    steps = materialize(steps, "deliveries")
    f = P.source_files(spark, sf_dir).where("relative_path is not null").select("snapshot_id", F.col("relative_path").alias("key"), F.col("content_hash").alias("hash"), "recorded_at")
    f = f.join(broadcast_if_small(steps.select("snapshot_id", "seq")), "snapshot_id")
    f = latest(f, ["seq", "snapshot_id", "key"], ["hash"])
    f = materialize(f, "delivered-files", "seq")
    last, snaps = steps.agg(F.max("seq"), F.count("*")).first()
    index = snapshot_changes.SnapshotIndex(spark, f"{shared_dir(spark)}/treeloom/snapshot-index-{uuid.uuid4().hex}", buckets_for(f.count() // max(1, snaps // (last or 1))))
    return snapshot_changes.history(index, f, steps, last or 0)


def p5_found(spark, sf_dir):
    """Each path that differs between a READY snapshot and the READY one before it."""
    return _changes(spark, sf_dir).select("snapshot_id", F.col("key").alias("relative_path"), "change_kind")


def p5_counts(spark, sf_dir):
    """Changes per snapshot and kind."""
    return _changes(spark, sf_dir).groupBy("snapshot_id", "change_kind").agg(F.count("*").alias("paths"))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_cycles, p4_found, p4_by_month, p5_found, p5_counts)}

STRIP = r"regexp_replace({0}, '^[\s\x{{00a0}}\x{{feff}}]+|[\s\x{{00a0}}\x{{feff}}]+$', '', 'g')"


def uuid_sql(c: str) -> str:
    s = f"lower({STRIP.format(c)})"
    h = rf"regexp_replace(regexp_replace({s}, '^urn:uuid:', ''), '[{{}}\-]', '', 'g')"
    return rf"(case when regexp_matches({h}, '^[0-9a-f]{{32}}$') then substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12) else {s} end)"


def path_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace({STRIP.format(c)}, '\', '/'), '/{{2,}}', '/', 'g'), '^(\./)+', ''), '/(\./)+', '/', 'g')"


_SYM = f"""syms as (select id, arg_max(parent, recorded_at) parent, arg_max(name, recorded_at) as name from
  (select {uuid_sql('id')} id, coalesce({uuid_sql('parent_symbol_id')}, '') parent, {STRIP.format('name')} as name, recorded_at from symbols) group by id)"""
_LOOP = f"""with recursive {_SYM},
up as (select a.id, b.id parent, a.name from syms a left join syms b on a.parent = b.id),
tree(id, root_id, depth, full_path) as (select id, id, 0, name from up where parent is null
  union all select u.id, t.root_id, t.depth + 1, t.full_path || '/' || u.name from up u join tree t on u.parent = t.id),
bad as (select id, parent from up where id not in (select id from tree)),
walk(id, pos) as (select id, parent from bad union select w.id, b.parent from walk w join bad b on w.pos = b.id),
cyc as (select w.id from walk w where w.id = w.pos),
roots as (select w.id, min(w.pos) root_id from walk w where w.pos in (select id from cyc) group by w.id)"""
_DELIV = f"""snaps as (select id, arg_max(struct_pack(r := repo, s := status, c := created_at), recorded_at) v from
  (select {uuid_sql('id')} id, {uuid_sql('repository_id')} repo, upper(status) status, created_at, recorded_at from snapshots) group by id),
ready as (select id snapshot_id, v.r series, row_number() over (partition by v.r order by v.c, id) seq, lead(id) over (partition by v.r order by v.c, id) nxt from snaps where v.s = 'READY'),
rec as (select id, arg_max(struct_pack(s := sid, p := path, h := hash), recorded_at) v from
  (select {uuid_sql('id')} id, {uuid_sql('snapshot_id')} sid, {path_sql('relative_path')} path, lower({STRIP.format('content_hash')}) hash, recorded_at from source_files) group by id),
f as (select r.series, r.seq, r.snapshot_id, r.nxt, v.p path, v.h hash from rec join ready r on r.snapshot_id = v.s),
chg as (select b.snapshot_id, b.path relative_path, case when a.path is null then 'ADDED' else 'MODIFIED' end change_kind from f b left join f a on a.series = b.series and a.seq = b.seq - 1 and a.path = b.path
  where b.seq > 1 and (a.path is null or a.hash is distinct from b.hash)
  union all select a.nxt, a.path, 'DELETED' from f a left join f b on b.series = a.series and b.seq = a.seq + 1 and b.path = a.path where a.nxt is not null and b.path is null)"""
_REFS = " union all ".join(
    f"select '{t}' table_name, '{p}' target_table, id record_id, v.t target_id, v.a referred_at from (select id, min(struct_pack(a := recorded_at, t := target)) v from (select {uuid_sql('id')} id, {uuid_sql(c)} target, recorded_at from {t}) group by id)"
    for t, c, p in (("symbol_relations", "target_symbol_id", "symbols"), ("chunks", "symbol_id", "symbols"), ("source_file_relations", "target_file_id", "source_files"))
)
_ORPH = f"""refs as ({_REFS}),
par as ({' union all '.join(f"select '{t}' target_table, {uuid_sql('id')} id, min(recorded_at) seen from {t} group by 2" for t in ('symbols', 'source_files'))}),
dead as (select distinct lower(record_table) target_table, {uuid_sql('record_id')} id from purge_log),
orph as (select table_name, record_id, referred_at, case when p.id is not null then 'late' when d.id is not null then 'deleted' else 'missing' end orphan_kind
  from refs r left join par p on p.target_table = r.target_table and p.id = r.target_id left join dead d on d.target_table = r.target_table and d.id = r.target_id
  where r.target_id is not null and (p.id is null or p.seen > r.referred_at))"""

SQL = {
    "p3_found": _LOOP + " select id symbol_id, root_id, depth from tree union all select id, root_id, -1 from roots",
    "p3_paths": _LOOP + " select id symbol_id, root_id, depth, full_path from tree union all select id, root_id, -1, null from roots",
    "p3_descendants": f"with recursive {_SYM}, up as (select a.id, b.id parent from syms a left join syms b on a.parent = b.id), tree(id) as (select id from up where parent is null union all select u.id from up u join tree t on u.parent = t.id), "
    "clo(ancestor_id, descendant_id, distance) as (select u.parent, u.id, 1 from up u join tree t on u.id = t.id where u.parent is not null union all select u.parent, c.descendant_id, c.distance + 1 from clo c join up u on c.ancestor_id = u.id where u.parent is not null) select * from clo",
    "p3_cycles": _LOOP + " select root_id cycle_id, count(*) symbols from roots group by 1",
    "p4_found": f"with {_ORPH} select table_name, record_id, orphan_kind from orph",
    "p4_by_month": f"with {_ORPH} select table_name, orphan_kind, strftime(referred_at, '%Y-%m') as month, count(*) orphans from orph group by all",
    "p5_found": f"with {_DELIV} select snapshot_id, relative_path, change_kind from chg",
    "p5_counts": f"with {_DELIV} select snapshot_id, change_kind, count(*) paths from chg group by all",
}
