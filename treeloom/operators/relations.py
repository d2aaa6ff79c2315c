"""From extracted rows to linked ones: symbol parents, resolved imports, calls, and the lists shown for a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions.text import file_name, join_path, normal_path, parent_path, stem, suffix
from treeloom.session import broadcast_if_small


def map_symbols(extracted: DataFrame) -> DataFrame:
    """Symbols with qualified name, id and parent from (source_file_id, ordinal, name, kind, start_line, end_line, parent_name).

    The qualified name shows one level. The parent is the last symbol before this one in its file whose qualified name
    equals the parent's name; none if there is none. One shuffle by file and name: parents and children meet in a window.
    """
    q = F.when(F.col("parent_name").isNotNull(), F.concat_ws(".", "parent_name", "name")).otherwise(F.col("name"))
    s = extracted.withColumn("qualified_name", q)
    s = s.withColumn("id", ids.symbol_id())
    cols = ["source_file_id", "ordinal", "name", "kind", "start_line", "end_line", "qualified_name", "id"]
    offer = s.select("source_file_id", F.col("qualified_name").alias("_key"), "ordinal", F.col("id").alias("_offer"), F.lit(None).cast(s.select(F.struct(*cols)).schema[0].dataType).alias("_row"))
    ask = s.where("parent_name is not null").select("source_file_id", F.col("parent_name").alias("_key"), "ordinal", F.lit(None).cast("string").alias("_offer"), F.struct(*cols).alias("_row"))
    w = Window.partitionBy("source_file_id", "_key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    found = offer.unionByName(ask).withColumn("parent_symbol_id", F.last("_offer", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", "parent_symbol_id")
    alone = s.where("parent_name is null").select(*cols, F.lit(None).cast("string").alias("parent_symbol_id"))
    return alone.unionByName(found)


def contains_edges(symbols: DataFrame) -> DataFrame:
    """A CONTAINS edge from the parent to every symbol that has one."""
    e = symbols.where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("source_symbol_id"), F.col("id").alias("target_symbol_id"), F.lit("CONTAINS").alias("kind"))
    return e.withColumn("id", ids.symbol_edge_id()).dropDuplicates(["id"])


#: Endings tried on an imported path, in this order; for aliases as a set.
LOCAL_ENDINGS = ["", ".py", ".js", ".ts", ".tsx", "/__init__.py", "/index.js", "/index.ts", "/index.tsx"]
ALIAS_ENDINGS = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def module_path(path: Column, language: Column, module: Column) -> Column:
    """Path that a relative module names from a file: dots climb in Python, ``./`` and ``../`` elsewhere."""
    folder = parent_path(path)
    rest = F.regexp_replace(module, r"^\.+", "")
    level = F.length(module) - F.length(rest)
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    keep = F.greatest(F.size(parts) - (level - 1), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), keep), "/")
    python = F.when(rest == "", base).otherwise(join_path(base, F.translate(rest, ".", "/")))
    return F.when(language == "python", python).otherwise(normal_path(join_path(folder, module)))


def resolve_local(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with ``target_file_id``: the first of the candidate paths that is a file of the same snapshot.

    imports: (import_id, snapshot_id, relative_path, language, module). Only modules that begin with a dot are local. A path with
    a suffix stands for itself; others are tried with every ending in order. One equi-join on snapshot and path.
    """
    local = imports.where(F.col("module").startswith("."))
    p = local.withColumn("_base", module_path(F.col("relative_path"), F.col("language"), F.col("module")))
    several = F.array(*[F.concat(F.col("_base"), F.lit(e)) for e in LOCAL_ENDINGS])
    p = p.select("import_id", "snapshot_id", F.posexplode(F.when(suffix(F.col("_base")) != "", F.array("_base")).otherwise(several)).alias("_pos", "_path"))
    f = files.select(F.col("snapshot_id").alias("_snap"), F.col("relative_path").alias("_file_path"), F.col("id").alias("_file"))
    hit = p.join(f, (F.col("snapshot_id") == F.col("_snap")) & (F.col("_path") == F.col("_file_path")))
    best = hit.groupBy("import_id").agg(F.min(F.struct("_pos", "_file")).alias("_b")).select(F.col("import_id").alias("_i"), F.col("_b._file").alias("target_file_id"))
    return imports.join(best, F.col("import_id") == F.col("_i"), "left").drop("_i")


#: Path aliases of one project.
MAX_PATTERNS = 2_000


def resolve_alias(imports: DataFrame, files: DataFrame, patterns: DataFrame) -> DataFrame:
    """imports with ``target_file_id`` by path aliases: patterns in order, their targets in order, then the first file by path.

    patterns: (pattern_pos, pattern, target_pos, target, base_url) and, where there are several projects, the snapshot_id they are of;
    imports meet those of their own snapshot only. Without that column they are one project's configuration, which is read and
    stands in the plan as a constant, as far as it is one: over ``MAX_PATTERNS`` is an error. A pattern has one ``*`` or none; the matched part replaces every ``*`` of the target.
    """
    columns = ["pattern_pos", "pattern", "target_pos", "target", "base_url"]
    one = imports.select("import_id", "snapshot_id", "module")
    if "snapshot_id" in patterns.columns:
        p = broadcast_if_small(patterns.select(F.col("snapshot_id").alias("_of"), *columns))
        m = one.join(p, F.col("snapshot_id") == F.col("_of")).drop("_of")
    else:
        given = patterns.select(*columns).limit(MAX_PATTERNS + 1).collect()
        if len(given) > MAX_PATTERNS:
            raise ValueError("patterns of many projects need a snapshot_id")
        types = {f.name: f.dataType for f in patterns.schema}
        of = [F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in columns]) for r in given]
        m = one.withColumn("_p", F.explode(F.array(*of))).select(*one.columns, "_p.*") if of else one.limit(0).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    star = F.instr("pattern", "*") > 0
    head, tail = F.substring_index("pattern", "*", 1), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    fits = F.when(star, F.col("module").startswith(head) & F.col("module").endswith(tail)).otherwise(F.col("module") == F.col("pattern"))
    m = m.where(fits)
    middle = F.when(star, F.expr("substring(module, length(substring_index(pattern, '*', 1)) + 1, greatest(length(module) - length(substring_index(pattern, '*', 1)) - length(substring(pattern, instr(pattern, '*') + 1)), 0))")).otherwise(F.lit(""))
    base = F.regexp_replace(F.regexp_replace(join_path(F.coalesce("base_url", F.lit(".")), F.replace("target", F.lit("*"), middle)), r"^(\./)+", ""), r"/(\./)+", "/")
    c = m.select("import_id", "snapshot_id", "pattern_pos", "target_pos", F.explode(F.transform(F.array(*[F.lit(e) for e in ALIAS_ENDINGS]), lambda e: F.concat(base, e))).alias("_path"))
    f = files.select(F.col("snapshot_id").alias("_snap"), F.col("relative_path").alias("_file_path"), F.col("id").alias("_file"))
    hit = c.join(f, (F.col("snapshot_id") == F.col("_snap")) & (F.col("_path") == F.col("_file_path")))
    best = hit.groupBy("import_id").agg(F.min(F.struct("pattern_pos", "target_pos", "_file_path", "_file")).alias("_b"))
    best = best.select(F.col("import_id").alias("_i"), F.col("_b._file").alias("target_file_id"))
    return imports.join(best, F.col("import_id") == F.col("_i"), "left").drop("_i")


def resolve_imports(imports: DataFrame, files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Local resolution, then aliases for what stays open in the script languages."""
    local = resolve_local(imports, files)
    if patterns is None:
        return local
    open_ = imports.where(F.col("language").isin("javascript", "typescript", "tsx"))
    alias = resolve_alias(open_, files, patterns).select(F.col("import_id").alias("_i"), F.col("target_file_id").alias("_alias"))
    return local.join(alias, F.col("import_id") == F.col("_i"), "left").withColumn("target_file_id", F.coalesce("target_file_id", "_alias")).drop("_i", "_alias")


def import_edges(resolved: DataFrame, strict: bool = False) -> DataFrame:
    """IMPORTS edges, each once. A file that imports itself is left out, or an error when ``strict``."""
    e = resolved.where("target_file_id is not null").select("source_file_id", "target_file_id", F.lit("IMPORTS").alias("kind"))
    if strict:
        e = e.where(F.when(F.col("source_file_id") == F.col("target_file_id"), F.raise_error(F.lit("a file imports itself"))).otherwise(F.lit(True)))
    else:
        e = e.where("source_file_id <> target_file_id")
    return e.withColumn("id", ids.file_edge_id()).dropDuplicates(["id"])


def call_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame, file_edges: DataFrame) -> DataFrame:
    """CALLS edges from (source_file_id, caller_name, callee_name, owner_name).

    The caller must be the only symbol of its name in the file. Without an owner, the only symbol of the callee's name in the
    file is the target, and the call is dropped if that is the caller itself. Otherwise, if something imported in the
    file goes by the owner's (else the callee's) name, the imported files are searched in the order of their ids, and the first
    with exactly one symbol of the name (or of owner.callee as qualified name) gives the target.
    """
    alone = symbols.groupBy("source_file_id", "name").agg(F.count("*").alias("_n"), F.min("id").alias("_id")).where("_n = 1").drop("_n")
    caller = alone.select(F.col("source_file_id").alias("_cf"), F.col("name").alias("_cn"), F.col("_id").alias("source_symbol_id"))
    local = alone.select(F.col("source_file_id").alias("_lf"), F.col("name").alias("_ln"), F.col("_id").alias("_local"))
    c = calls.select("source_file_id", "caller_name", "callee_name", "owner_name").distinct()
    c = c.join(caller, (F.col("source_file_id") == F.col("_cf")) & (F.col("caller_name") == F.col("_cn"))).drop("_cf", "_cn")
    c = c.join(local, (F.col("source_file_id") == F.col("_lf")) & (F.col("callee_name") == F.col("_ln")) & F.col("owner_name").isNull(), "left").drop("_lf", "_ln")
    here = c.where("_local is not null").select("source_symbol_id", F.col("_local").alias("target_symbol_id"))
    names = imports.select(F.col("source_file_id").alias("_if"), F.explode(F.array("imported_name", "alias")).alias("_in")).where("_in is not null").distinct()
    away = c.where("_local is null").join(names, (F.col("source_file_id") == F.col("_if")) & (F.coalesce("owner_name", "callee_name") == F.col("_in")), "left_semi")
    away = away.select("source_symbol_id", "source_file_id", "callee_name", "owner_name").distinct()
    edges = file_edges.select(F.col("source_file_id").alias("_ef"), F.col("target_file_id").alias("_et")).distinct()
    s = symbols.select(F.col("source_file_id").alias("_sf"), F.col("name").alias("_sn"), F.col("qualified_name").alias("_sq"), F.col("id").alias("_sid"))
    reach = away.join(edges, F.col("source_file_id") == F.col("_ef"))
    by_name = reach.join(s, (F.col("_et") == F.col("_sf")) & (F.col("_sn") == F.col("callee_name")))
    by_full = reach.where("owner_name is not null").join(s, (F.col("_et") == F.col("_sf")) & (F.col("_sq") == F.concat_ws(".", "owner_name", "callee_name")))
    key = ["source_symbol_id", "callee_name", "owner_name", "_et"]
    per = by_name.unionByName(by_full).select(*key, "_sid").distinct().groupBy(*key).agg(F.count("*").alias("_n"), F.min("_sid").alias("_sid")).where("_n = 1")
    best = per.groupBy("source_symbol_id", "callee_name", "owner_name").agg(F.min(F.struct("_et", "_sid")).alias("_b"))
    e = here.unionByName(best.select("source_symbol_id", F.col("_b._sid").alias("target_symbol_id")))
    e = e.where("source_symbol_id <> target_symbol_id").withColumn("kind", F.lit("CALLS"))
    return e.withColumn("id", ids.symbol_edge_id()).dropDuplicates(["id"])


def list_symbol_relations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file_id, source_name, target_name, kind) of edges whose ends are both in one file."""
    a = symbols.select(F.col("id").alias("_a"), F.col("source_file_id"), F.col("qualified_name").alias("source_name"))
    b = symbols.select(F.col("id").alias("_b"), F.col("source_file_id").alias("_bf"), F.col("qualified_name").alias("target_name"))
    j = edges.join(a, F.col("source_symbol_id") == F.col("_a")).join(b, (F.col("target_symbol_id") == F.col("_b")) & (F.col("source_file_id") == F.col("_bf")))
    return j.select("source_file_id", "source_name", "target_name", "kind")


def list_file_relations(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file_id, target_file_id, target_path, kind) of edges to files that have a row."""
    t = files.select(F.col("id").alias("_t"), F.col("relative_path").alias("target_path"))
    return edges.join(t, F.col("target_file_id") == F.col("_t")).select("source_file_id", "target_file_id", "target_path", "kind")


def list_imports(imports: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports of files with the file shown for a relative module: the first by edge order whose name is part of the
    module, or with whose stem the module ends. A heuristic for display, not the resolution of edges.

    The candidates of an import are the few files its own file points to, by equi-join.
    """
    t = files.select(F.col("id").alias("_t"), F.col("relative_path").alias("_path"))
    e = edges.join(t, F.col("target_file_id") == F.col("_t")).select(F.col("source_file_id").alias("_s"), "_t", "_path")
    rel = imports.where(F.col("module").startswith(".")).join(e, F.col("source_file_id") == F.col("_s"))
    rel = rel.where(F.col("module").contains(file_name(F.col("_path"))) | F.col("module").endswith(stem(F.col("_path"))))
    first = rel.groupBy("id").agg(F.min(F.struct("_t", "_path")).alias("_b")).select(F.col("id").alias("_i"), F.col("_b._t").alias("resolved_file_id"), F.col("_b._path").alias("resolved_path"))
    return imports.join(first, F.col("id") == F.col("_i"), "left").drop("_i")
