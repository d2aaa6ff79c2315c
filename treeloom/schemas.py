"""Schemas of the stored tables, value sets of their enumerations, and the namespaces of their derived ids."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "projects": "id string, name string, description string, status string",
    "repositories": "id string, project_id string, provider string, remote_url string, owner string, name string, status string",
    "snapshots": "id string, repository_id string, commit_sha string, branch string, remote_url string, status string, created_at timestamp",
    "analysis_jobs": "id string, snapshot_id string, status string, progress int, error_message string, created_at timestamp, updated_at timestamp",
    "source_files": "id string, snapshot_id string, relative_path string, language string, size_bytes bigint, content_hash string",
    "symbols": "id string, source_file_id string, name string, qualified_name string, kind string, start_line int, end_line int, parent_symbol_id string",
    "import_references": "id string, source_file_id string, module string, imported_name string, alias string, line int",
    "source_file_relations": "id string, source_file_id string, target_file_id string, kind string",
    "symbol_relations": "id string, source_symbol_id string, target_symbol_id string, kind string",
    "chunks": "id string, snapshot_id string, source_file_id string, symbol_id string, kind string, text string, code string, relative_path string, language string, qualified_name string, symbol_kind string, start_line int, end_line int, part_index int, part_count int",
    "vectors": "chunk_id string, vector array<float>, snapshot_id string, source_file_id string, symbol_id string, relative_path string, language string, qualified_name string, symbol_kind string",
    "call_references": "id string, source_file_id string, caller_symbol_id string, callee_name string, line int",
}
#: Key of each table, and the column its files are partitioned by where one value is read or dropped at a time.
KEYS = {t: "chunk_id" if t == "vectors" else "id" for t in _DDL}
PARTITIONS = {"source_files": "snapshot_id", "chunks": "snapshot_id", "vectors": "snapshot_id"}

STATUSES = {
    "projects": ("ACTIVE", "ARCHIVED"), "repositories": ("ACTIVE", "UNAVAILABLE"), "snapshots": ("PENDING", "READY", "FAILED"),
    "analysis_jobs": ("QUEUED", "DISCOVERING", "PROCESSING", "READY", "FAILED"),
}
SYMBOL_KINDS = ("CLASS", "FUNCTION", "METHOD", "INTERFACE")
SYMBOL_EDGES, FILE_EDGES = ("CONTAINS", "CALLS"), ("IMPORTS",)

#: Name spaces of version-5 ids, needed for ids that equal those stored before.
NAMESPACES = {
    "source_files": "3c52e96d-65cf-4bb8-92c0-d16f90b8f91f",
    "symbols": "7a4cc4be-2a21-4f4d-b4c1-72123e06f0d6",
    "symbol_relations": "cb7bc2cf-7759-4f67-9b9b-827576c19136",
    "source_file_relations": "6c43cd72-86c2-4fdb-8f50-6438c4f9f73d",
    "chunks": "9fa4b5f7-3f9b-4ad0-a34e-a11e697ef790",
    "import_references": "18b69007-9398-4cbb-b745-4da91ba94425",
    "call_references": "d9e22871-8627-4b61-a4d2-6bcbf1430a1d",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def tables() -> list[str]:
    return list(_DDL)
