"""Registered queries of stores, lists, mapping and resolution, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions.records import latest, uuid_key
from treeloom.operators import analysis, jobs, relations, snapshots, store, validate
from treeloom.plans.data_queries import STRIP, uuid_sql
from treeloom.plans.graph_queries import EDGES, FILE_EDGES, FILES, INDEXED, SNAPS, SYMBOLS, entity_sql, latest_sql
from treeloom.plans.retrieval_queries import _checkout
from treeloom.sources import project as P


def upserted_symbols(spark, sf_dir):
    """First deliveries of symbols with the later ones put in."""
    s = P.table(spark, sf_dir, "symbols").select(uuid_key("id").alias("id"), "kind", "start_line", "end_line", "recorded_at")
    first = latest(s, ["id"], ["kind", "start_line", "end_line"], first=True)
    later = store.last_write(s.withColumn("seq", F.unix_micros("recorded_at")).drop("recorded_at"), "id", "seq").drop("seq")
    return store.upsert(first, later)


def deleted_rows(spark, sf_dir):
    """How many rows each kind of delete would remove for test files."""
    f, s = P.source_files(spark, sf_dir), P.symbols(spark, sf_dir)
    files = f.where(F.col("relative_path").startswith("tests/")).select("id")
    syms = s.join(files.select(F.col("id").alias("_f")), F.col("source_file_id") == F.col("_f"), "left_semi").select("id")
    a = store.delete_where(f, F.col("relative_path").startswith("tests/"))[1].withColumn("what", F.lit("files"))
    b = store.delete_in(s, "source_file_id", files)[1].withColumn("what", F.lit("symbols"))
    c = store.delete_touching(P.symbol_relations(spark, sf_dir), "source_symbol_id", "target_symbol_id", syms)[1].withColumn("what", F.lit("edges"))
    return a.unionByName(b).unionByName(c)


def listed_files(spark, sf_dir):
    """Place of every file in its snapshot's list, by path."""
    w = Window.partitionBy("snapshot_id").orderBy("relative_path", "id")
    return P.source_files(spark, sf_dir).select("snapshot_id", "id", F.row_number().over(w).alias("place"))


def listed_symbols(spark, sf_dir):
    """Place of every symbol in its file's list, by lines."""
    w = Window.partitionBy("source_file_id").orderBy("start_line", "end_line", "id")
    return P.symbols(spark, sf_dir).select("source_file_id", "id", F.row_number().over(w).alias("place"))


def listed_chunks(spark, sf_dir):
    """Parts of every symbol's chunks in order."""
    c = P.table(spark, sf_dir, "chunks").select(uuid_key("id").alias("id"), uuid_key("symbol_id").alias("symbol_id"), "part_index", "part_count", "recorded_at")
    c = latest(c, ["id"], ["symbol_id", "part_index", "part_count"]).where("symbol_id is not null")
    return c.groupBy("symbol_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("part_index")), lambda x: x.cast("string"))).alias("parts"))


def snapshot_by_commit(spark, sf_dir):
    """The snapshot of each commit of a repository."""
    return P.snapshots(spark, sf_dir).groupBy("repository_id", "commit_sha").agg(F.min("id").alias("snapshot_id"))


def first_ready(spark, sf_dir):
    """The oldest READY snapshot of each repository, which lists show first, beside the newest, and the progress shown."""
    s = P.snapshots(spark, sf_dir)
    ready = F.when(F.col("status") == "READY", F.struct("created_at", "id"))
    return s.groupBy("repository_id").agg(F.min(ready)["id"].alias("first_ready"), F.max(ready)["id"].alias("newest_ready"), F.min(F.when(F.col("status") == "READY", 100).otherwise(0)).alias("least_progress"))


def shown_fields(spark, sf_dir):
    """Short forms of commits and addresses, and a free-text match."""
    s = P.snapshots(spark, sf_dir)
    name = F.substring_index("remote_url", "/", -1)
    return s.select("id", F.substring("commit_sha", 1, 7).alias("short_sha"), F.upper(F.substring(name, 1, 2)).alias("initials"), F.lower("remote_url").contains(F.lower(F.trim(F.lit(" BAL ")))).alias("matches"))


def repository_addresses(spark, sf_dir):
    """Owner and name out of addresses of every usual form, made of the stored ones."""
    u = P.snapshots(spark, sf_dir).select("remote_url").distinct()
    kinds = F.array(F.regexp_replace("remote_url", "git.invalid", "github.com"), F.concat(F.regexp_replace("remote_url", "git.invalid", "github.com"), F.lit(".git/")), F.col("remote_url"), F.concat(F.regexp_replace("remote_url", "git.invalid", "github.com"), F.lit("/more")))
    e = u.select(F.explode(kinds).alias("url"))
    return e.select("url", validate.repository_parts(F.col("url")).alias("p")).select("url", F.col("p.owner").alias("owner"), F.col("p.name").alias("name"))


def job_gate(spark, sf_dir):
    """Snapshots for which a job may start."""
    from treeloom.plans.graph_queries import _job_log

    log = _job_log(spark, sf_dir).select("id", F.col("job_id").alias("snapshot_id"), "status", "created_at")
    return jobs.may_start(log, log.select(F.col("snapshot_id").alias("id")).distinct())


def _extracted(spark, sf_dir):
    w = Window.partitionBy("source_file_id").orderBy("start_line", "id")
    s = P.symbols(spark, sf_dir)
    return s.select("source_file_id", F.row_number().over(w).alias("ordinal"), "name", "kind", "start_line", "end_line", F.when(F.col("qualified_name").contains("."), F.substring_index("qualified_name", ".", 1)).alias("parent_name"))


def mapped_symbols(spark, sf_dir):
    """Symbols with ids and parents from rows as a parser gives them."""
    return relations.map_symbols(_extracted(spark, sf_dir)).select("source_file_id", "ordinal", "qualified_name", "id", "parent_symbol_id")


def resolved_calls(spark, sf_dir):
    """Call edges found again from the names of callers and callees, and from what files import."""
    s, e, fe = P.symbols(spark, sf_dir), P.symbol_relations(spark, sf_dir).where("kind = 'CALLS'"), P.source_file_relations(spark, sf_dir)
    a = s.select(F.col("id").alias("_a"), "source_file_id", F.col("name").alias("caller_name"))
    b = s.select(F.col("id").alias("_b"), F.col("name").alias("callee_name"))
    calls = e.join(a, F.col("source_symbol_id") == F.col("_a")).join(b, F.col("target_symbol_id") == F.col("_b")).select("source_file_id", "caller_name", "callee_name", F.lit(None).cast("string").alias("owner_name"))
    t = s.select(F.col("source_file_id").alias("_t"), F.col("name").alias("imported_name"))
    imports = fe.join(t, F.col("target_file_id") == F.col("_t")).select("source_file_id", "imported_name", F.lit(None).cast("string").alias("alias"))
    return relations.call_edges(calls, s, imports, fe).select("id", "source_symbol_id", "target_symbol_id")


def listed_imports(spark, sf_dir):
    """Imports of stored sources with the file shown for each."""
    f = _checkout(spark, sf_dir)
    a = analysis.analyze(f)
    return relations.list_imports(a["import_references"], f.select("id", "relative_path"), a["source_file_relations"]).select("id", "source_file_id", "module", "imported_name", "resolved_path")


def _reused(spark, sf_dir):
    from treeloom.plans.graph_queries import _reuse

    pairs, mapped = _reuse(spark, sf_dir)
    c = P.table(spark, sf_dir, "chunks").select(uuid_key("id").alias("id"), uuid_key("snapshot_id").alias("snapshot_id"), uuid_key("source_file_id").alias("source_file_id"), uuid_key("symbol_id").alias("symbol_id"), "part_index", "recorded_at")
    c = latest(c, ["id"], ["snapshot_id", "source_file_id", "symbol_id", "part_index"])
    return snapshots.reuse_chunks(c, mapped, pairs.select("current_file_id", "snapshot_id"))


def reused_chunks(spark, sf_dir):
    """Chunks carried over to a next snapshot."""
    return _reused(spark, sf_dir).select("id", "snapshot_id", "source_file_id", "symbol_id", "part_index", "old_id")


def reused_vectors(spark, sf_dir):
    """Vectors carried over with their chunks."""
    v = P.table(spark, sf_dir, "vectors").select(uuid_key("chunk_id").alias("chunk_id"), "recorded_at", F.size("vector").alias("n"))
    v = latest(v, ["chunk_id"], ["n"]).withColumns({c: F.lit(None).cast("string") for c in ("snapshot_id", "source_file_id", "symbol_id")})
    return snapshots.reuse_vectors(v, _reused(spark, sf_dir)).select("chunk_id", "snapshot_id", "n")


def _incremental(spark, sf_dir):
    """An incremental run over all stored checkouts; the files whose id begins with 0 are taken as changed."""
    f = _checkout(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256))
    prev = {t: P_(spark, sf_dir) for t, P_ in (("symbols", P.symbols), ("symbol_relations", P.symbol_relations), ("source_file_relations", P.source_file_relations))}
    prev["symbols"] = prev["symbols"].select("id", "source_file_id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_symbol_id")
    prev["symbol_relations"] = prev["symbol_relations"].select("id", "source_symbol_id", "target_symbol_id", "kind")
    prev["source_file_relations"] = prev["source_file_relations"].select("id", "source_file_id", "target_file_id", "kind")
    ids = ["id", "snapshot_id", "source_file_id", "symbol_id"]
    c = P.table(spark, sf_dir, "chunks").select(*[uuid_key(x).alias(x) for x in ids], *[x for x in P.table(spark, sf_dir, "chunks").columns if x not in ids])
    prev["chunks"] = latest(c, ["id"], [x for x in c.columns if x not in ("id", "recorded_at")])
    ids = ["chunk_id", "snapshot_id", "source_file_id", "symbol_id"]
    v = P.table(spark, sf_dir, "vectors").select(*[uuid_key(x).alias(x) for x in ids], *[x for x in P.table(spark, sf_dir, "vectors").columns if x not in ids])
    prev["vectors"] = latest(v, ["chunk_id"], [x for x in v.columns if x not in ("chunk_id", "recorded_at")])
    changed = F.substring("id", 1, 1) == "0"
    new = f.withColumns({"content_hash": F.when(changed, F.lit("changed")).otherwise(F.col("content_hash")), "id": F.concat(F.lit("next-"), F.col("id")), "snapshot_id": F.concat(F.lit("next-"), F.col("snapshot_id"))})
    # Files of one snapshot meet those of the next: the snapshot is part of the path they are compared by.
    tag = lambda df, s: df.withColumn("relative_path", F.concat(s, F.lit("/"), F.col("relative_path")))
    out = analysis.incremental(prev, tag(f, F.col("snapshot_id")), tag(new, F.regexp_replace("snapshot_id", "^next-", "")))
    return out


def incremental_counts(spark, sf_dir):
    """Rows of each table that an incremental run makes."""
    out, rows = _incremental(spark, sf_dir), None
    for t in ("symbols", "symbol_relations", "source_file_relations", "import_references", "chunks", "vectors"):
        n = out[t].agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(t))
        rows = n if rows is None else rows.unionByName(n)
    return rows


def incremental_counters(spark, sf_dir):
    """The ten counters of an incremental run."""
    return _incremental(spark, sf_dir)["counters"]


def pipeline_routes(spark, sf_dir):
    """Whether each snapshot is processed in full or from the READY one before it."""
    return analysis.route(P.snapshots(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        upserted_symbols, deleted_rows, listed_files, listed_symbols, listed_chunks, snapshot_by_commit, first_ready, shown_fields, repository_addresses, job_gate, mapped_symbols, resolved_calls, listed_imports, reused_chunks, reused_vectors,
        incremental_counts, incremental_counters, pipeline_routes,
    )
}

_GIT = "replace(remote_url, 'git.invalid', 'github.com')"
_REUSE_C = f"""files as ({FILES}), idx as ({INDEXED}), syms as ({SYMBOLS}), pairs as (select id prev, 'next-of-' || snapshot_id snap, {entity_sql('source_files', "'next-of-' || snapshot_id", 'relative_path')} cur from files where snapshot_id in (select snapshot_id from idx)),
mapped as (select distinct p.cur, p.snap, s.id old_id, {entity_sql('symbols', 'p.cur', 's.kind', 's.qualified_name', 's.start_line', 's.end_line')} new_id from syms s join pairs p on p.prev = s.source_file_id),
ch as ({latest_sql('chunks', ['id', 'snapshot_id', 'source_file_id', 'symbol_id'], {'part_index': 'part_index'})}),
re as (select {entity_sql('chunks', 'm.snap', 'm.cur', 'm.new_id', 'c.part_index')} id, m.snap snapshot_id, m.cur source_file_id, m.new_id symbol_id, c.part_index, c.id old_id from ch c join mapped m on m.old_id = c.symbol_id)"""
_LOG = "log as (select event_id id, user_id job_id, ts created_at, case event_type when 'view' then 'QUEUED' when 'click' then 'DISCOVERING' when 'purchase' then 'PROCESSING' when 'error' then 'FAILED' else 'READY' end status from events)"

SQL = {
    "pipeline_routes": f"with s as ({SNAPS}), r as (select a.id, a.repository_id, (select arg_max(b.id, struct_pack(c := b.created_at, i := b.id)) from s b where b.repository_id = a.repository_id and b.status = 'READY' and b.created_at < a.created_at) previous_id from s a) select *, case when previous_id is null then 'FULL' else 'INCREMENTAL' end as mode from r",
    "upserted_symbols": f"select id, v.kind kind, v.start_line start_line, v.end_line end_line from (select id, max(struct_pack(at_ := recorded_at, end_line := 0, kind := kind, start_line := start_line, end_line_ := end_line)) w, max(struct_pack(at_ := recorded_at, kind := kind, start_line := start_line, end_line := end_line)) v from (select {uuid_sql('id')} id, kind, start_line, end_line, recorded_at from symbols) group by id)",
    "deleted_rows": f"with files as ({FILES}), syms as ({SYMBOLS}), edges as ({EDGES}), f as (select id from files where starts_with(relative_path, 'tests/')), s as (select id from syms where source_file_id in (select id from f)) select 'files' what, count(*) deleted from f union all select 'symbols', count(*) from s union all select 'edges', count(*) from edges where source_symbol_id in (select id from s) or target_symbol_id in (select id from s)",
    "listed_files": f"select snapshot_id, id, row_number() over (partition by snapshot_id order by relative_path, id) place from ({FILES})",
    "listed_symbols": f"select source_file_id, id, row_number() over (partition by source_file_id order by start_line, end_line, id) place from ({SYMBOLS})",
    "listed_chunks": f"select symbol_id, array_to_string(list(part_index order by part_index), ',') parts from ({latest_sql('chunks', ['id', 'symbol_id'], {'part_index': 'part_index'})}) where symbol_id is not null group by 1",
    "snapshot_by_commit": f"select repository_id, commit_sha, min(id) snapshot_id from ({SNAPS}) group by 1, 2",
    "first_ready": f"select repository_id, arg_min(id, struct_pack(c := created_at, i := id)) filter (status = 'READY') first_ready, arg_max(id, struct_pack(c := created_at, i := id)) filter (status = 'READY') newest_ready, min(case when status = 'READY' then 100 else 0 end) least_progress from ({SNAPS}) group by 1",
    "shown_fields": f"select id, substr(commit_sha, 1, 7) short_sha, upper(substr(regexp_extract(remote_url, '[^/]*$'), 1, 2)) initials, contains(lower(remote_url), 'bal') matches from ({latest_sql('snapshots', ['id'], {'commit_sha': 'commit_sha', 'remote_url': 'remote_url'})})",
    "repository_addresses": f"with u as (select distinct remote_url from ({latest_sql('snapshots', ['id'], {'remote_url': 'remote_url'})})), e as (select unnest([{_GIT}, {_GIT} || '.git/', remote_url, {_GIT} || '/more']) url from u), c as (select url, regexp_replace(regexp_replace({STRIP.format('url')}, '/$', ''), '\\.git$', '') k from e) "
    "select url, case when regexp_matches(k, '^https://github\\.com/[^/]+/[^/]+$') then string_split(k, '/')[4] end as owner, case when regexp_matches(k, '^https://github\\.com/[^/]+/[^/]+$') then string_split(k, '/')[5] end as name from c",
    "job_gate": f"with {_LOG} select job_id snapshot_id, arg_max(status, struct_pack(c := created_at, i := id)) in ('READY', 'FAILED') allowed from log group by 1",
    "mapped_symbols": f"with x as (select source_file_id, row_number() over (partition by source_file_id order by start_line, id) as ordinal, name, kind, start_line, end_line, case when contains(qualified_name, '.') then string_split(qualified_name, '.')[1] end parent_name from ({SYMBOLS})), q as (select *, coalesce(parent_name || '.', '') || name as qualified_name from x), i as (select *, {entity_sql('symbols', 'source_file_id', 'kind', 'qualified_name', 'start_line', 'end_line')} id from q)"
    " select a.source_file_id, a.ordinal, a.qualified_name, a.id, (select arg_max(b.id, b.ordinal) from i b where b.source_file_id = a.source_file_id and b.qualified_name = a.parent_name and b.ordinal < a.ordinal) parent_symbol_id from i a",
    "resolved_calls": f"""with syms as ({SYMBOLS}), edges as ({EDGES}), fe as ({FILE_EDGES}), alone as (select source_file_id f, name n, min(id) id from syms group by 1, 2 having count(*) = 1),
      calls as (select distinct a.source_file_id f, a.name caller, b.name callee from edges e join syms a on a.id = e.source_symbol_id join syms b on b.id = e.target_symbol_id where e.kind = 'CALLS'),
      imp as (select distinct fe.source_file_id f, s.name n from fe join syms s on s.source_file_id = fe.target_file_id where s.name is not null), c as (select calls.f, callee, a.id src, l.id loc from calls join alone a on a.f = calls.f and a.n = caller left join alone l on l.f = calls.f and l.n = callee),
      away as (select distinct c.f, c.callee, c.src from c join imp on imp.f = c.f and imp.n = c.callee where loc is null), per as (select a.src, a.callee, e.t, min(s.id) sid from away a join (select distinct source_file_id f, target_file_id t from fe) e on e.f = a.f join syms s on s.source_file_id = e.t and s.name = a.callee group by 1, 2, 3 having count(*) = 1),
      found as (select src, loc dst from c where loc is not null union select src, arg_min(sid, t) from per group by src, callee) select distinct {entity_sql('symbol_relations', 'src', chr(39) + 'CALLS' + chr(39), 'dst')} id, src source_symbol_id, dst target_symbol_id from found where src <> dst""",
    "reused_chunks": f"with {_REUSE_C} select * from re",
    "reused_vectors": f"with {_REUSE_C}, v as ({latest_sql('vectors', ['chunk_id'], {'n': 'len(vector)'}, 'chunk_id')}) select re.id chunk_id, re.snapshot_id, v.n from v join re on re.old_id = v.chunk_id",
}
