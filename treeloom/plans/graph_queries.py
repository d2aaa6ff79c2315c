"""Registered queries over files, symbols and their graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions import text as T
from treeloom.functions.records import strip
from treeloom.operators import chunking, graph, jobs, relations, snapshots, store, validate
from treeloom.plans.data_queries import STRIP, path_sql, uuid_sql
from treeloom.session import broadcast_if_small
from treeloom.sources import discovery
from treeloom.sources import project as P


def latest_sql(table: str, ids_: list[str], others: dict[str, str], key: str = "id", at: str = "recorded_at") -> str:
    """SQL of a table's records by the row that holds; others: column -> expression."""
    cols = {**{c: uuid_sql(c) for c in ids_}, **others}
    inner = ", ".join(f"{e} as {c}" for c, e in cols.items())
    pack = ", ".join(f"{c} := {c}" for c in cols if c != key)
    outer = ", ".join(f"v.{c} as {c}" for c in cols if c != key)
    return f"select {key}, {outer} from (select {key}, max(struct_pack(at_ := {at}, {pack})) v from (select {inner}, {at} from {table}) group by {key})"


FILES = latest_sql("source_files", ["id", "snapshot_id"], {"relative_path": path_sql("relative_path"), "language": "language", "size_bytes": "size_bytes", "content_hash": f"lower({STRIP.format('content_hash')})"})
SYMBOLS = latest_sql("symbols", ["id", "source_file_id", "parent_symbol_id"], {"name": STRIP.format("name"), "qualified_name": STRIP.format("qualified_name"), "kind": "kind", "start_line": "start_line", "end_line": "end_line"})
EDGES = latest_sql("symbol_relations", ["id", "source_symbol_id", "target_symbol_id"], {"kind": "kind"})
FILE_EDGES = latest_sql("source_file_relations", ["id", "source_file_id", "target_file_id"], {"kind": "kind"})
SNAPS = latest_sql("snapshots", ["id", "repository_id"], {"commit_sha": "commit_sha", "branch": "branch", "status": f"upper({STRIP.format('status')})", "created_at": "created_at"})
INDEXED = f"select v.id snapshot_id, repository_id from (select repository_id, max(struct_pack(c := created_at, id := id)) v from ({SNAPS}) where status = 'READY' group by 1)"


def language_summary(spark, sf_dir):
    """Files and bytes per snapshot and stored language."""
    return discovery.summary(P.source_files(spark, sf_dir), "snapshot_id")


def language_detection(spark, sf_dir):
    """Files per language told by their path."""
    return P.source_files(spark, sf_dir).select(T.language(F.col("relative_path")).alias("language")).groupBy("language").agg(F.count("*").alias("files"))


def discovery_scan(spark, sf_dir):
    """Kept and ignored files of the stored checkouts by folder, size and decoding."""
    f = P.table(spark, sf_dir, "file_contents").select(F.regexp_replace(T.normal_path(F.translate("path", "\\", "/")), "^checkouts/[^/]+/", "").alias("relative_path"), "length", "content")
    d = discovery.prune(f, 10_000)
    return d.groupBy("kept", T.language(F.col("relative_path")).alias("language")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def content_hashes(spark, sf_dir):
    """SHA-256 of every stored content."""
    return P.table(spark, sf_dir, "file_contents").select("path", F.sha2("content", 256).alias("content_hash")).distinct()


def derived_ids(spark, sf_dir):
    """The version-5 id that each file's snapshot and path give."""
    return P.source_files(spark, sf_dir).select("id", ids.source_file_id().alias("derived_id"))


def list_files(spark, sf_dir):
    """Files of indexed snapshots."""
    s = broadcast_if_small(P.indexed_snapshots(spark, sf_dir))
    return P.source_files(spark, sf_dir).join(s.select("snapshot_id"), "snapshot_id").select("snapshot_id", "relative_path", "language", "size_bytes")


def list_symbol_relations(spark, sf_dir):
    """Edges between symbols of one file, by their names."""
    return relations.list_symbol_relations(P.symbols(spark, sf_dir), P.symbol_relations(spark, sf_dir))


def list_file_relations(spark, sf_dir):
    """Import edges with the target's path."""
    return relations.list_file_relations(P.source_files(spark, sf_dir), P.source_file_relations(spark, sf_dir))


def symbol_neighbours(spark, sf_dir):
    """Members, callees and callers of every symbol."""
    s = P.symbols(spark, sf_dir)
    return graph.symbol_neighbours(s.select("id"), P.symbol_relations(spark, sf_dir), s)


def file_neighbours(spark, sf_dir):
    """Imports and importers of every file."""
    f = P.source_files(spark, sf_dir)
    return graph.file_neighbours(f.select("id"), P.source_file_relations(spark, sf_dir), f)


def _walk(spark, sf_dir):
    s, e = P.symbols(spark, sf_dir), P.symbol_relations(spark, sf_dir)
    return graph.walk_calls(s.select("id"), e, s, 3)


def walk_calls(spark, sf_dir):
    """What every symbol of any kind reaches over calls within three steps, at the least depth."""
    return _walk(spark, sf_dir)


def walk_imports(spark, sf_dir):
    """What every importing file reaches over imports within three steps."""
    f, e = P.source_files(spark, sf_dir), P.source_file_relations(spark, sf_dir)
    return graph.walk_imports(e.select("source_file_id"), e, f, 3)


def depth_index(spark, sf_dir):
    """Places of the nodes that any symbol reaches within their depth."""
    return graph.depth_index(_walk(spark, sf_dir))


def induced_subgraph(spark, sf_dir):
    """Call edges inside what each symbol of any kind reaches."""
    return graph.induced(_walk(spark, sf_dir), P.symbol_relations(spark, sf_dir))


def edges_of_nodes(spark, sf_dir):
    """Edges out of and into every symbol."""
    return graph.touching(P.symbol_relations(spark, sf_dir), P.symbols(spark, sf_dir).select("id"))


def contains_edges(spark, sf_dir):
    """CONTAINS edges that the parents of symbols imply, with their ids."""
    return relations.contains_edges(P.symbols(spark, sf_dir)).select("id", "source_symbol_id", "target_symbol_id")


def _pairs(spark, sf_dir):
    d = broadcast_if_small(P.deliveries(spark, sf_dir))
    f = P.source_files(spark, sf_dir).join(d, "snapshot_id")
    f = f.groupBy("series", "seq", "snapshot_id", "relative_path").agg(F.max(F.struct("recorded_at", "id", "content_hash")).alias("_r")).select("series", "seq", "snapshot_id", "relative_path", "_r.id", "_r.content_hash")
    steps = broadcast_if_small(d.where("seq > 1").select("series", "seq"))
    cur = f.where("seq > 1").select("series", "seq", "relative_path", "id", "content_hash")
    prev = f.select("series", (F.col("seq") + 1).alias("seq"), "relative_path", "id", "content_hash").join(steps, ["series", "seq"], "left_semi")
    return prev, cur


def snapshot_compare(spark, sf_dir):
    """Every path of consecutive READY snapshots with its kind of change."""
    prev, cur = _pairs(spark, sf_dir)
    return snapshots.compare(prev, cur, ("series", "seq")).select("series", "seq", "relative_path", "change_kind")


def change_counts(spark, sf_dir):
    """Changes per snapshot by kind."""
    prev, cur = _pairs(spark, sf_dir)
    return snapshots.change_counts(snapshots.compare(prev, cur, ("series", "seq")), "series", "seq")


def incremental_plan(spark, sf_dir):
    """What an incremental run would copy, read and drop, per snapshot."""
    prev, cur = _pairs(spark, sf_dir)
    p = snapshots.plan(snapshots.compare(prev, cur, ("series", "seq")))
    return p.groupBy("series", "seq", "action").agg(F.count("*").alias("files"))


def previous_ready(spark, sf_dir):
    """The READY snapshot before each snapshot."""
    return snapshots.previous_ready(P.snapshots(spark, sf_dir)).select("id", "previous_id")


def newest_snapshot(spark, sf_dir):
    """The newest snapshot of each repository, whatever its status."""
    return store.newest(P.snapshots(spark, sf_dir).select("id", "repository_id", "status", "created_at"), "repository_id").select("repository_id", "id", "status")


def _reuse(spark, sf_dir):
    """Every indexed file under a next snapshot of its repository that left it as it is."""
    f = P.source_files(spark, sf_dir).join(broadcast_if_small(P.indexed_snapshots(spark, sf_dir)), "snapshot_id")
    nxt = F.concat(F.lit("next-of-"), "snapshot_id")
    pairs = f.select(F.col("id").alias("previous_file_id"), ids.entity_id("source_files", nxt, "relative_path").alias("current_file_id"), nxt.alias("snapshot_id"))
    return pairs, snapshots.symbol_pairs(pairs.select("previous_file_id", "current_file_id"), P.symbols(spark, sf_dir))


def reuse_symbols(spark, sf_dir):
    """Symbols carried over to a next snapshot, with new ids and parents."""
    return snapshots.reuse_symbols(_reuse(spark, sf_dir)[1]).select("id", "source_file_id", "qualified_name", "parent_symbol_id")


def remap_edges(spark, sf_dir):
    """Symbol edges carried over, inside files and across."""
    _, m = _reuse(spark, sf_dir)
    e = P.symbol_relations(spark, sf_dir)
    inside, across = snapshots.remap_edges(e, m, True), snapshots.remap_edges(e, m, False)
    return inside.withColumn("same_file", F.lit(True)).unionByName(across.withColumn("same_file", F.lit(False)))


def remap_file_edges(spark, sf_dir):
    """Import edges carried over."""
    return snapshots.remap_file_edges(P.source_file_relations(spark, sf_dir), _reuse(spark, sf_dir)[0])


def file_tree(spark, sf_dir):
    """Folders and files of indexed snapshots."""
    s = broadcast_if_small(P.indexed_snapshots(spark, sf_dir).select("snapshot_id"))
    return snapshots.file_tree(P.source_files(spark, sf_dir).join(s, "snapshot_id"), "snapshot_id")


def test_paths(spark, sf_dir):
    """Files in tests and not, per snapshot."""
    return P.source_files(spark, sf_dir).groupBy("snapshot_id", T.is_test_path(F.col("relative_path")).alias("is_test")).agg(F.count("*").alias("files"))


def question_kinds(spark, sf_dir):
    """Which held-out texts ask about tests, and which about behaviour."""
    return P.table(spark, sf_dir, "eval_items").select("item_id", T.asks(F.col("item_text"), T.TEST_WORDS).alias("tests"), T.asks(F.col("item_text"), T.TEST_WORDS_CONTEXT).alias("tests_context"), T.asks(F.col("item_text"), T.BEHAVIOUR_WORDS).alias("behaviour"))


def direct_children(spark, sf_dir):
    """Symbols directly inside others by their lines."""
    return chunking.direct_children(P.symbols(spark, sf_dir)).select("symbol_id", "child_id")


def local_imports(spark, sf_dir):
    """Resolution of a relative import that each file makes of the next file of its folder, without its suffix."""
    f = P.source_files(spark, sf_dir).join(broadcast_if_small(P.indexed_snapshots(spark, sf_dir).select("snapshot_id")), "snapshot_id")
    f = f.where("relative_path is not null")
    stem = T.stem(F.col("relative_path"))
    module = F.when(F.col("language") == "python", F.concat(F.lit("."), stem)).otherwise(F.concat(F.lit("./x/../"), stem))
    i = f.select(F.col("id").alias("import_id"), "snapshot_id", "relative_path", "language", module.alias("module"))
    return relations.resolve_local(i, f).select("import_id", "module", "target_file_id")


def alias_imports(spark, sf_dir):
    """Resolution of script imports by two path aliases."""
    f = P.source_files(spark, sf_dir).join(broadcast_if_small(P.indexed_snapshots(spark, sf_dir).select("snapshot_id")), "snapshot_id")
    pats = spark.createDataFrame([(0, "@src/*", 0, "src/*", "."), (0, "@src/*", 1, "web/*", "."), (1, "@any/*", 0, "./*", ".")], "pattern_pos int, pattern string, target_pos int, target string, base_url string")
    p = F.regexp_replace("relative_path", r"\.[^./]+$", "")
    module = F.when(p.startswith("src/") | p.startswith("web/"), F.concat(F.lit("@src/"), F.expr("substring(regexp_replace(relative_path, '\\\\.[^./]+$', ''), 5)"))).otherwise(F.concat(F.lit("@any/"), p))
    i = f.where(F.col("language").isin("javascript", "typescript", "tsx")).select(F.col("id").alias("import_id"), "snapshot_id", "relative_path", "language", module.alias("module"))
    return relations.resolve_alias(i, f, pats).select("import_id", "module", "target_file_id")


def record_audit(spark, sf_dir):
    """How many rows break each rule of the stored tables, by the rows as delivered."""
    out = None
    for t in ("source_files", "symbols", "chunks", "symbol_relations", "source_file_relations", "snapshots"):
        a = validate.audit(P.table(spark, sf_dir, t), t)
        out = a if out is None else out.unionByName(a)
    return out


def last_writes(spark, sf_dir):
    """Upsert of all deliveries of the snapshots in the order they were recorded."""
    rows = P.table(spark, sf_dir, "snapshots").select(F.lower(strip("id")).alias("id"), "status", F.unix_micros("recorded_at").alias("seq"))
    return store.with_first_position(rows, "id", "seq").select("id", "status", "seq", "position")


def duplicate_commits(spark, sf_dir):
    """Commits of a repository with more than one snapshot."""
    return store.repeated(P.snapshots(spark, sf_dir), "repository_id", "commit_sha")


def purge_counts(spark, sf_dir):
    """What purging every indexed snapshot removes, per snapshot and table."""
    T_ = lambda n: P.table(spark, sf_dir, n)
    from treeloom.functions.records import uuid_key

    tables = {
        "vectors": T_("vectors").select(uuid_key("chunk_id").alias("chunk_id"), uuid_key("snapshot_id").alias("snapshot_id")).distinct(), "chunks": T_("chunks").select(uuid_key("id").alias("id"), uuid_key("snapshot_id").alias("snapshot_id")).distinct(),
        "symbol_relations": P.symbol_relations(spark, sf_dir), "source_file_relations": P.source_file_relations(spark, sf_dir), "symbols": P.symbols(spark, sf_dir), "source_files": P.source_files(spark, sf_dir), "snapshots": P.snapshots(spark, sf_dir),
    }
    return store.purge(tables, P.indexed_snapshots(spark, sf_dir).select("snapshot_id"))[1]


def _job_log(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "DISCOVERING").when(F.col("event_type") == "purchase", "PROCESSING").when(F.col("event_type") == "error", "FAILED").otherwise("READY")
    return P.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"), status.alias("status"), F.floor("value").cast("int").alias("progress"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error_message"))


def job_audit(spark, sf_dir):
    """Transitions of jobs that break the rules, by kind of breach."""
    a = jobs.audit(_job_log(spark, sf_dir))
    return a.groupBy("previous_status", "status", "problem").agg(F.count("*").alias("transitions"))


def latest_job(spark, sf_dir):
    """The newest job state of each snapshot."""
    log = _job_log(spark, sf_dir).select("id", F.col("job_id").alias("snapshot_id"), "status", "created_at")
    return store.newest(log, "snapshot_id").select("snapshot_id", "id", "status")


QUERIES = {
    f.__name__: f
    for f in (
        language_summary, language_detection, discovery_scan, content_hashes, derived_ids, list_files, list_symbol_relations, list_file_relations, symbol_neighbours, file_neighbours, walk_calls, walk_imports, depth_index,
        induced_subgraph, edges_of_nodes, contains_edges, snapshot_compare, change_counts, incremental_plan, previous_ready, newest_snapshot, reuse_symbols, remap_edges, remap_file_edges, file_tree, test_paths, question_kinds,
        direct_children, local_imports, alias_imports, record_audit, last_writes, duplicate_commits, purge_counts, job_audit, latest_job,
    )
}



def suffix_sql(p: str) -> str:
    return f"regexp_extract(regexp_extract({p}, '[^/]*$'), '^.+(\\.[^.]+)$', 1)"


def language_sql(p: str) -> str:
    name = f"regexp_extract({p}, '[^/]*$')"
    by_name = " ".join(f"when {name} = '{n}' then '{v}'" for n, v in T.LANGUAGE_NAMES.items())
    by_suffix = " ".join(f"when lower({suffix_sql(p)}) in ({', '.join(repr(s) for s in all_.split())}) then '{lang}'" for lang, all_ in T.LANGUAGE_SUFFIXES.items())
    return f"(case {by_name} {by_suffix} else 'unknown' end)"


def uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    v = f"substr('89ab', 1 + (('0x' || substr({h}, 17, 1))::int & 3), 1)"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{v}||substr({h},18,3)||'-'||substr({h},21,12))"


def entity_sql(table: str, *parts: str) -> str:
    from treeloom.schemas import NAMESPACES

    return uuid5_sql(NAMESPACES[table], " || ':' || ".join(f"coalesce(cast({p} as varchar), 'None')" for p in parts))


def test_path_sql(p: str) -> str:
    q = f"lower(replace({p}, '\\', '/'))"
    n = f"regexp_extract({q}, '[^/]*$')"
    return f"coalesce(list_has_any(string_split({q}, '/'), ['test', 'tests', '__tests__']) or starts_with({n}, 'test_') or ends_with({n}, '_test.py') or contains({n}, '.test.') or contains({n}, '.spec.'), false)"


def asks_sql(q: str, words: list[str]) -> str:
    return f"coalesce(list_has_any(regexp_extract_all(lower({q}), '[a-z0-9_]+'), [{', '.join(repr(w) for w in words)}]), false)"


_CALLS = f"syms as ({SYMBOLS}), edges as ({EDGES}), calls as (select distinct source_symbol_id s, target_symbol_id t from edges where kind = 'CALLS' and target_symbol_id in (select id from syms))"
_WALK = f"""with recursive {_CALLS}, w(root_id, node_id, depth) as (select id, id, 0 from syms union select w.root_id, c.t, w.depth + 1 from w join calls c on w.node_id = c.s where w.depth < 3),
walked as (select root_id, node_id, min(depth) depth from w group by 1, 2 having min(depth) > 0)"""
_DEL = f"ready as (select id snapshot_id, repository_id series, row_number() over (partition by repository_id order by created_at, id) seq from ({SNAPS}) where status = 'READY' and repository_id is not null)"
_PAIRS = f"""{_DEL}, hist as (select series, seq, relative_path, v.id id, v.h content_hash from (select r.series, r.seq, f.relative_path, max(struct_pack(at_ := f.recorded_at, id := f.id, h := f.content_hash)) v
  from (select id, v.snapshot_id, v.relative_path, v.content_hash, v.at_ recorded_at from (select id, max(struct_pack(at_ := recorded_at, snapshot_id := snapshot_id, relative_path := relative_path, language := language, size_bytes := size_bytes, content_hash := content_hash)) v
  from (select {uuid_sql('id')} id, {uuid_sql('snapshot_id')} snapshot_id, {path_sql('relative_path')} relative_path, language, size_bytes, lower({STRIP.format('content_hash')}) content_hash, recorded_at from source_files) group by id)) f join ready r using (snapshot_id) group by 1, 2, 3)),
cmp as (select coalesce(b.series, a.series) series, coalesce(b.seq, a.seq + 1) seq, coalesce(b.relative_path, a.relative_path) relative_path,
  case when a.id is null then 'ADDED' when b.id is null then 'DELETED' when a.content_hash is not distinct from b.content_hash then 'UNCHANGED' else 'MODIFIED' end change_kind
  from (select * from hist where seq > 1) b full join (select h.* from hist h join ready r on r.series = h.series and r.seq = h.seq + 1) a on a.series = b.series and a.seq + 1 = b.seq and a.relative_path = b.relative_path)"""
_REUSE = f"""files as ({FILES}), idx as ({INDEXED}), syms as ({SYMBOLS}), pairs as (select id prev, {entity_sql('source_files', "'next-of-' || snapshot_id", 'relative_path')} cur from files where snapshot_id in (select snapshot_id from idx)),
mapped as (select p.cur, s.id old_id, {entity_sql('symbols', 'p.cur', 's.kind', 's.qualified_name', 's.start_line', 's.end_line')} new_id, s.qualified_name, s.parent_symbol_id from syms s join pairs p on p.prev = s.source_file_id)"""
_IDXF = f"files as ({FILES}), idx as ({INDEXED}), f as (select * from files where snapshot_id in (select snapshot_id from idx) and relative_path is not null)"
_PARENT = "regexp_replace(f.relative_path, '/?[^/]*$', '')"
_STEM = f"left(regexp_extract(f.relative_path, '[^/]*$'), length(regexp_extract(f.relative_path, '[^/]*$')) - length({suffix_sql('f.relative_path')}))"
_BASE = f"(case when {_PARENT} = '' then {_STEM} else {_PARENT} || '/' || {_STEM} end)"
_PYBASE = f"(case when {_PARENT} = '' then replace({_STEM}, '.', '/') else {_PARENT} || '/' || replace({_STEM}, '.', '/') end)"
_RULES = {
    "source_files": {"size_bytes is negative": "size_bytes < 0", "content_hash is no SHA-256": f"not coalesce(regexp_full_match(lower({STRIP.format('content_hash')}), '[0-9a-f]{{64}}'), false)"},
    "symbols": {"name is blank": f"coalesce({STRIP.format('name')}, '') = ''", "qualified_name is blank": f"coalesce({STRIP.format('qualified_name')}, '') = ''", "start_line isn't positive": "start_line <= 0", "end_line is before start_line": "end_line < start_line", "kind is unknown": "kind not in ('CLASS', 'FUNCTION', 'METHOD', 'INTERFACE')"},
    "chunks": {"text is blank": f"coalesce({STRIP.format('text')}, '') = ''", "code is blank": f"coalesce({STRIP.format('code')}, '') = ''", "part_index is negative": "part_index < 0", "part_count isn't positive": "part_count <= 0", "part_index is out of range": "part_index >= part_count"},
    "symbol_relations": {"edge is a loop": "source_symbol_id = target_symbol_id", "kind is unknown": "kind not in ('CONTAINS', 'CALLS')"},
    "source_file_relations": {"edge is a loop": "source_file_id = target_file_id", "kind is unknown": "kind <> 'IMPORTS'"},
    "snapshots": {"commit_sha is no SHA-1": f"not coalesce(regexp_full_match(lower({STRIP.format('commit_sha')}), '[0-9a-f]{{40}}'), false)", "remote_url is blank": f"coalesce({STRIP.format('remote_url')}, '') = ''", "status is unknown": "status not in ('PENDING', 'READY', 'FAILED')"},
}
_LOG = "log as (select event_id id, user_id job_id, ts created_at, case event_type when 'view' then 'QUEUED' when 'click' then 'DISCOVERING' when 'purchase' then 'PROCESSING' when 'error' then 'FAILED' else 'READY' end status, floor(value)::int progress, case when event_type = 'error' then 'failed' end error_message from events)"
_NORMAL = "array_to_string(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x not in ('', '.')), '/')"

SQL = {
    "language_summary": f"select snapshot_id, language, count(*) files, sum(size_bytes)::bigint size_bytes from ({FILES}) group by 1, 2",
    "language_detection": f"select {language_sql('relative_path')} as language, count(*) files from ({FILES}) group by 1",
    "discovery_scan": f"select not list_has_any(string_split(p, '/'), ['.git', '.venv', 'venv', '__pycache__', 'node_modules', 'dist', 'build', '.idea', '.vscode']) and length <= 10000 kept, {language_sql('p')} as language, count(*) files, sum(length)::bigint bytes from (select regexp_replace({_NORMAL}, '^checkouts/[^/]+/', '') p, length from file_contents) group by 1, 2",
    "content_hashes": "select distinct path, sha256(content) content_hash from file_contents",
    "derived_ids": f"select id, {entity_sql('source_files', 'snapshot_id', 'relative_path')} derived_id from ({FILES})",
    "list_files": f"select snapshot_id, relative_path, language, size_bytes from ({FILES}) where snapshot_id in (select snapshot_id from ({INDEXED}))",
    "list_symbol_relations": f"with syms as ({SYMBOLS}), edges as ({EDGES}) select a.source_file_id, a.qualified_name source_name, b.qualified_name target_name, e.kind from edges e join syms a on a.id = e.source_symbol_id join syms b on b.id = e.target_symbol_id and a.source_file_id = b.source_file_id",
    "list_file_relations": f"with files as ({FILES}), e as ({FILE_EDGES}) select e.source_file_id, e.target_file_id, f.relative_path target_path, e.kind from e join files f on f.id = e.target_file_id",
    "walk_imports": f"with recursive files as ({FILES}), e as ({FILE_EDGES}), calls as (select distinct source_file_id s, target_file_id t from e where kind = 'IMPORTS' and target_file_id in (select id from files)), w(root_id, node_id, depth) as (select distinct source_file_id, source_file_id, 0 from e where source_file_id in (select id from files) union select w.root_id, c.t, w.depth + 1 from w join calls c on w.node_id = c.s where w.depth < 3) select root_id, node_id, min(depth) depth from w group by 1, 2 having min(depth) > 0",
    "walk_calls": f"{_WALK} select * from walked",
    "depth_index": f"{_WALK} select *, row_number() over (partition by root_id, depth order by node_id) - 1 as index from walked",
    "induced_subgraph": f"{_WALK}, inside as (select root_id, node_id from walked union select root_id, root_id from walked), c as (select distinct source_symbol_id source, target_symbol_id target from edges where kind = 'CALLS') select a.root_id, c.source, c.target from c join inside a on a.node_id = c.source join inside b on b.node_id = c.target and a.root_id = b.root_id",
    "symbol_neighbours": f"with syms as ({SYMBOLS}), edges as ({EDGES}) select distinct * from (select r.id symbol_id, e.kind relation, e.target_symbol_id neighbour_id from syms r join edges e on e.source_symbol_id = r.id where e.kind in ('CONTAINS', 'CALLS') union all select r.id, 'CALLED_BY', e.source_symbol_id from syms r join edges e on e.target_symbol_id = r.id where e.kind = 'CALLS') where neighbour_id in (select id from syms)",
    "file_neighbours": f"with files as ({FILES}), e as ({FILE_EDGES}) select distinct * from (select r.id file_id, 'IMPORTS' relation, e.target_file_id neighbour_id from files r join e on e.source_file_id = r.id union all select r.id, 'IMPORTED_BY', e.source_file_id from files r join e on e.target_file_id = r.id) where neighbour_id in (select id from files)",
    "edges_of_nodes": f"with syms as ({SYMBOLS}), edges as ({EDGES}) select n.id node_id, 'OUT' direction, e.target_symbol_id other_id, e.kind from edges e join syms n on n.id = e.source_symbol_id union all select n.id, 'IN', e.source_symbol_id, e.kind from edges e join syms n on n.id = e.target_symbol_id",
    "contains_edges": f"select {entity_sql('symbol_relations', 'parent_symbol_id', chr(39) + 'CONTAINS' + chr(39), 'id')} id, parent_symbol_id source_symbol_id, id target_symbol_id from ({SYMBOLS}) where parent_symbol_id is not null",
    "snapshot_compare": f"with {_PAIRS} select * from cmp",
    "change_counts": f"with {_PAIRS} select series, seq, count(*) filter (change_kind = 'ADDED') added, count(*) filter (change_kind = 'DELETED') deleted, count(*) filter (change_kind = 'MODIFIED') modified, count(*) filter (change_kind = 'UNCHANGED') unchanged from cmp group by 1, 2",
    "incremental_plan": f"with {_PAIRS} select series, seq, case change_kind when 'UNCHANGED' then 'REUSE' when 'DELETED' then 'DELETE' else 'ANALYZE' end as action, count(*) files from cmp group by all",
    "previous_ready": f"with s as ({SNAPS}) select a.id, (select arg_max(b.id, struct_pack(c := b.created_at, i := b.id)) from s b where b.repository_id = a.repository_id and b.status = 'READY' and b.created_at < a.created_at) previous_id from s a",
    "newest_snapshot": f"select repository_id, v.i id, v.s status from (select repository_id, max(struct_pack(c := created_at, i := id, s := status)) v from ({SNAPS}) where repository_id is not null group by 1)",
    "reuse_symbols": f"with {_REUSE} select distinct on (m.new_id) m.new_id id, m.cur source_file_id, m.qualified_name, p.new_id parent_symbol_id from mapped m left join mapped p on p.old_id = m.parent_symbol_id and p.cur = m.cur",
    "remap_edges": f"with {_REUSE}, edges as ({EDGES}) select distinct {entity_sql('symbol_relations', 'a.new_id', 'e.kind', 'b.new_id')} id, a.new_id source_symbol_id, b.new_id target_symbol_id, e.kind, a.cur = b.cur same_file from edges e join mapped a on a.old_id = e.source_symbol_id join mapped b on b.old_id = e.target_symbol_id",
    "remap_file_edges": f"with {_REUSE}, edges as ({FILE_EDGES}) select distinct {entity_sql('source_file_relations', 'a.cur', 'e.kind', 'b.cur')} id, a.cur source_file_id, b.cur target_file_id, e.kind from edges e join pairs a on a.prev = e.source_file_id join pairs b on b.prev = e.target_file_id where a.cur <> b.cur",
    "file_tree": f"with {_IDXF}, p as (select snapshot_id, string_split(relative_path, '/') parts from f), x as (select snapshot_id, parts, unnest(range(1, len(parts) + 1)) depth from p) select snapshot_id, array_to_string(parts[1:depth], '/') path, parts[depth] as name, depth, max(depth < len(parts)) is_folder from x group by 1, 2, 3, 4",
    "test_paths": f"select snapshot_id, {test_path_sql('relative_path')} is_test, count(*) files from ({FILES}) group by 1, 2",
    "question_kinds": f"select item_id, {asks_sql('item_text', T.TEST_WORDS)} tests, {asks_sql('item_text', T.TEST_WORDS_CONTEXT)} tests_context, {asks_sql('item_text', T.BEHAVIOUR_WORDS)} behaviour from eval_items",
    "direct_children": f"with syms as ({SYMBOLS}), c as (select a.id symbol_id, a.start_line s, a.end_line e, b.id child_id, b.start_line cs, b.end_line ce from syms a join syms b on a.source_file_id = b.source_file_id and a.id <> b.id and b.start_line > a.start_line and b.end_line <= a.end_line) select symbol_id, child_id from c where not exists (select 1 from c o where o.child_id = c.child_id and o.s > c.s and o.e <= c.e)",
    "local_imports": f"with {_IDXF}, m as (select f.id, f.snapshot_id, f.language, case when f.language = 'python' then '.' || {_STEM} else './x/../' || {_STEM} end as module, case when f.language = 'python' then {_PYBASE} else {_BASE} end base from f),"
    f" c as (select m.id, m.snapshot_id, unnest(case when {suffix_sql('m.base')} <> '' then [{{'p': 0, 'e': ''}}] else [{', '.join(f'{chr(123)}{chr(39)}p{chr(39)}: {i}, {chr(39)}e{chr(39)}: {e!r}{chr(125)}' for i, e in enumerate(relations.LOCAL_ENDINGS))}] end) x, m.base from m),"
    " h as (select c.id, arg_min(f.id, struct_pack(p := c.x.p, i := f.id)) t from c join f on f.snapshot_id = c.snapshot_id and f.relative_path = c.base || c.x.e group by 1) select m.id import_id, m.module, h.t target_file_id from m left join h on h.id = m.id",
    "record_audit": " union all ".join(f"select '{t}' table_name, '{n.replace(chr(39), chr(39) * 2)}' as rule, count(*) filter (coalesce({e}, false)) broken from {t}" for t, rs in _RULES.items() for n, e in rs.items()),
    "last_writes": "select id, v.s status, epoch_us(v.a) seq, epoch_us(f) as position from (select id, max(struct_pack(a := recorded_at, s := status)) v, min(recorded_at) f from (select lower(trim(id)) id, status, recorded_at from snapshots) group by 1)",
    "duplicate_commits": f"select repository_id, commit_sha, count(*) as rows from ({SNAPS}) group by 1, 2 having count(*) > 1",
    "purge_counts": f"""with idx as ({INDEXED}), files as (select f.id, f.snapshot_id s from ({FILES}) f join idx using (snapshot_id)), allsyms as ({SYMBOLS}), syms as (select a.id, f.s from allsyms a join files f on f.id = a.source_file_id), se as ({EDGES}), fe as ({FILE_EDGES}), x as (
      select s snapshot_id, 'source_files' table_name from files union all select s, 'symbols' from syms union all select snapshot_id, 'snapshots' from idx
      union all select snapshot_id, 'chunks' from (select distinct {uuid_sql('id')} id, {uuid_sql('snapshot_id')} snapshot_id from chunks) join idx using (snapshot_id) union all select snapshot_id, 'vectors' from (select distinct {uuid_sql('chunk_id')} id, {uuid_sql('snapshot_id')} snapshot_id from vectors) join idx using (snapshot_id)
      union all select coalesce(a.s, b.s), 'symbol_relations' from se left join syms a on a.id = se.source_symbol_id left join syms b on b.id = se.target_symbol_id where coalesce(a.s, b.s) is not null
      union all select coalesce(a.s, b.s), 'source_file_relations' from fe left join files a on a.id = fe.source_file_id left join files b on b.id = fe.target_file_id where coalesce(a.s, b.s) is not null)
      select snapshot_id, table_name, count(*) deleted from x group by 1, 2""",
    "job_audit": f"with {_LOG}, l as (select *, lag(status) over w as previous_status, lag(progress) over w before_ from log window w as (partition by job_id order by created_at, id)) select previous_status, status, case when progress < 0 or progress > 100 then 'progress out of range' when status = 'FAILED' and trim(coalesce(error_message, '')) = '' then 'failure without message' when previous_status = 'READY' and status = 'FAILED' then 'ready job failed' when previous_status in ('READY', 'FAILED') and status <> previous_status then 'terminal state left' when progress < before_ then 'progress fell' end problem, count(*) transitions from l group by all",
    "latest_job": f"with {_LOG} select job_id snapshot_id, v.i id, v.s status from (select job_id, max(struct_pack(c := created_at, i := id, s := status)) v from log group by 1)",
}
_ALIAS_P = "regexp_replace(f.relative_path, '\\.[^./]+$', '')"
SQL["alias_imports"] = (
    f"with {_IDXF}, m as (select f.id, f.snapshot_id, case when {_ALIAS_P} like 'src/%' or {_ALIAS_P} like 'web/%' then '@src/' || substr({_ALIAS_P}, 5) else '@any/' || {_ALIAS_P} end as module from f where language in ('javascript', 'typescript', 'tsx')),"
    " t as (select id, snapshot_id, module, unnest(case when module like '@src/%' then [{'k': 0, 'b': 'src/' || substr(module, 6)}, {'k': 1, 'b': 'web/' || substr(module, 6)}] else [{'k': 2, 'b': substr(module, 6)}] end) x from m),"
    f" h as (select t.id, arg_min(f.id, struct_pack(k := t.x.k, p := f.relative_path, i := f.id)) t from t join f on f.snapshot_id = t.snapshot_id and f.relative_path in ({', '.join(f't.x.b || {e!r}' for e in relations.ALIAS_ENDINGS)}) group by 1)"
    " select m.id import_id, m.module, h.t target_file_id from m left join h on h.id = m.id"
)
