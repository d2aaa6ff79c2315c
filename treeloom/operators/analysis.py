"""Whole-snapshot pipelines: analysis, indexing, and incremental indexing that copies what did not change."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions.vectors import deterministic_embedding
from treeloom.operators import chunking, relations, snapshots
from treeloom.session import materialize
from treeloom.sources import discovery, extract


def analyze(files: DataFrame, patterns: DataFrame | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """symbols, import_references, source_file_relations, symbol_relations, errors of files (file table columns and content).

    Two stages: everything that one file tells by itself, then calls, which need the symbols of all files. Contents are read
    once: what a file tells is written down, and all derived tables read that.
    """
    e = materialize(extract.extract(files.select(F.col("id").alias("source_file_id"), "language", "content"), strict), "extracted")
    symbols = materialize(relations.map_symbols(extract.rows_of(e, "symbols")), "symbols")
    imports = extract.rows_of(e, "imports").withColumn("id", ids.import_id())
    f = files.select(F.col("id").alias("_file"), "snapshot_id", "relative_path", "language")
    located = imports.join(f, F.col("source_file_id") == F.col("_file")).withColumn("import_id", F.col("id"))
    file_edges = materialize(relations.import_edges(relations.resolve_imports(located.dropDuplicates(["import_id"]), files.select("id", "snapshot_id", "relative_path"), patterns), strict), "import-edges")
    calls = relations.call_edges(extract.rows_of(e, "calls"), symbols, imports, file_edges)
    edges = relations.contains_edges(symbols).unionByName(calls)
    return {"symbols": symbols, "import_references": imports, "source_file_relations": file_edges, "symbol_relations": edges, "errors": e.where("error is not null").select("source_file_id", "error"), "parse_errors": e.where("error is null and has_errors").select("source_file_id")}


def counters(files: DataFrame, analyzed: dict[str, DataFrame]) -> DataFrame:
    """Per snapshot: files in all, analyzed, skipped for their language, not readable (error_files), analyzed in spite of syntax errors, and symbols."""
    ok = F.col("language").isin(*extract.LANGUAGES)
    err = analyzed["errors"].select(F.col("source_file_id").alias("_e")).distinct()
    per = analyzed["symbols"].groupBy(F.col("source_file_id").alias("_f")).agg(F.count("*").alias("_n"))
    bad = analyzed["parse_errors"].select(F.col("source_file_id").alias("_b")).distinct()
    j = files.select("id", "snapshot_id", "language").join(err, F.col("id") == F.col("_e"), "left").join(bad, F.col("id") == F.col("_b"), "left").join(per, F.col("id") == F.col("_f"), "left")
    analyzed_ = ok & F.col("_e").isNull()
    return j.groupBy("snapshot_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.coalesce(analyzed_, F.lit(False))).alias("analyzed_files"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped_files"),
        F.count_if(F.col("_e").isNotNull()).alias("error_files"), F.count_if(F.col("_b").isNotNull()).alias("files_with_parse_errors"), F.sum(F.coalesce("_n", F.lit(0))).alias("symbols"),
    )


def embed(chunks: DataFrame, vector: Callable[[Column], Column] | None = None, dimension: int = 64) -> DataFrame:
    """Vector rows of chunks; the vector stays in the row of its text, so nothing has to be matched by position."""
    make = vector or (lambda text: deterministic_embedding(text, dimension))
    return chunks.select(F.col("id").alias("chunk_id"), make(F.col("text")).cast("array<float>").alias("vector"), "snapshot_id", "source_file_id", "symbol_id", "relative_path", "language", "qualified_name", "symbol_kind")


def index(files: DataFrame, symbols: DataFrame, vector: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """chunks, vectors, and ``status``: what became of each file (indexed, no symbols, unreadable, no chunks)."""
    t = discovery.decoded(files.select("id", "content"))
    texts = t.where("text is not null").select(F.col("id").alias("source_file_id"), "text")
    chunks = materialize(chunking.chunk(symbols, files, texts), "chunks")
    n_symbols = symbols.groupBy(F.col("source_file_id").alias("_s")).agg(F.count("*").alias("_symbols"))
    n_chunks = chunks.groupBy(F.col("source_file_id").alias("_c")).agg(F.count("*").alias("_chunks"))
    j = t.select("id", F.col("text").isNotNull().alias("_ok")).join(n_symbols, F.col("id") == F.col("_s"), "left").join(n_chunks, F.col("id") == F.col("_c"), "left")
    status = F.when(F.col("_symbols").isNull(), "no symbols").when(~F.col("_ok"), "unreadable").when(F.col("_chunks").isNull(), "no chunks").otherwise("indexed")
    return {"chunks": chunks, "vectors": embed(chunks, vector), "status": j.select(F.col("id").alias("source_file_id"), status.alias("status"), F.coalesce("_chunks", F.lit(0)).alias("chunks"))}


def incremental(previous: dict[str, DataFrame], previous_files: DataFrame, files: DataFrame, patterns: DataFrame | None = None, complete: bool = False) -> dict[str, DataFrame]:
    """The tables of a new snapshot from those of the one before it and the new files (with content).

    Unchanged files are copied under new ids with their symbols, edges among copied files, chunks and vectors; only added and
    modified files are read. As the stored service does, imports of copied files and edges from copied to re-read files are not
    made; ``complete`` re-reads everything instead.
    """
    changes = materialize(snapshots.plan(snapshots.compare(previous_files, files)), "changes")
    todo = files if complete else files.join(changes.where("action = 'ANALYZE'").select("current_id"), F.col("id") == F.col("current_id"), "left_semi")
    fresh = analyze(todo.select(*files.columns), patterns)
    made = index(todo, fresh["symbols"])
    out = {k: fresh[k] for k in ("symbols", "import_references", "source_file_relations", "symbol_relations")} | {"chunks": made["chunks"], "vectors": made["vectors"], "changes": changes}
    readable = todo.select("id", "language").join(fresh["errors"].select("source_file_id").distinct(), F.col("id") == F.col("source_file_id"), "left_anti").where(F.col("language").isin(*extract.LANGUAGES))
    parts = {"reused_files": changes.where("action = 'REUSE'"), "analyzed_files": readable, "skipped_files": todo.join(readable.select(F.col("id").alias("_r")), F.col("id") == F.col("_r"), "left_anti"), "deleted_files": changes.where("action = 'DELETE'"), "indexed_chunks": made["chunks"]}
    if complete:
        return out | {"counters": _counters(parts | {"reused_files": changes.limit(0)})}
    pairs = changes.where("action = 'REUSE'").select(F.col("previous_id").alias("previous_file_id"), F.col("current_id").alias("current_file_id"))
    mapped = materialize(snapshots.symbol_pairs(pairs, previous["symbols"]), "carried-symbols")
    new_snapshot = files.select(F.col("id").alias("current_file_id"), "snapshot_id")
    reused = snapshots.reuse_chunks(previous["chunks"], mapped, new_snapshot)
    cols = out["symbols"].columns
    symbols = snapshots.reuse_symbols(mapped)
    out["symbols"] = out["symbols"].select(*[c for c in cols if c in symbols.columns]).unionByName(symbols)
    edges = snapshots.remap_edges(previous["symbol_relations"], mapped, True).unionByName(snapshots.remap_edges(previous["symbol_relations"], mapped, False))
    file_edges = snapshots.remap_file_edges(previous["source_file_relations"], pairs)
    vectors = snapshots.reuse_vectors(previous["vectors"], reused)
    out["symbol_relations"] = out["symbol_relations"].unionByName(edges)
    out["source_file_relations"] = out["source_file_relations"].unionByName(file_edges)
    out["chunks"] = out["chunks"].unionByName(reused.drop("old_id").select(*out["chunks"].columns))
    out["vectors"] = out["vectors"].unionByName(vectors.select(*out["vectors"].columns))
    out["counters"] = _counters(parts | {"reused_symbols": symbols, "reused_symbol_relations": edges, "reused_source_file_relations": file_edges, "reused_chunks": reused, "reused_vectors": vectors})
    return out


COUNTERS = ("reused_files", "analyzed_files", "skipped_files", "deleted_files", "reused_symbols", "reused_symbol_relations", "reused_source_file_relations", "reused_chunks", "reused_vectors", "indexed_chunks")


def _counters(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of ``COUNTERS``: the rows of each part, zero for parts that aren't there."""
    named = reduce(DataFrame.unionAll, [df.select(F.lit(n).alias("part")) for n, df in parts.items()])
    return named.agg(*[F.count_if(F.col("part") == n).alias(n) for n in COUNTERS])


def route(snapshots_: DataFrame) -> DataFrame:
    """(id, repository_id, previous_id, mode): INCREMENTAL where the repository has an earlier READY snapshot, else FULL."""
    return snapshots.previous_ready(snapshots_).select("id", "repository_id", "previous_id", F.when(F.col("previous_id").isNull(), "FULL").otherwise("INCREMENTAL").alias("mode"))


def process(snapshots_: DataFrame, snapshot_id: str, files_of: Callable[[str], DataFrame], tables_of: Callable[[str], dict[str, DataFrame]], patterns: DataFrame | None = None) -> tuple[str, dict[str, DataFrame]]:
    """(mode, tables) of a snapshot, by the way that ``route`` names; an unknown snapshot raises LookupError.

    ``files_of`` gives the files of a snapshot with content, ``tables_of`` what an earlier run made of one.
    """
    way = route(snapshots_).where(F.col("id") == snapshot_id).first()
    if way is None:
        raise LookupError(f"no snapshot {snapshot_id}")
    files = files_of(snapshot_id)
    if way["mode"] == "FULL":
        made = analyze(files, patterns)
        return "FULL", made | index(files, made["symbols"])
    return "INCREMENTAL", incremental(tables_of(way["previous_id"]), files_of(way["previous_id"]), files, patterns)
