"""Rules of single records: what is wrong with a row, and rows in their stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.records import strip
from treeloom.schemas import STATUSES, SYMBOL_KINDS


def _blank(c: str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def rules(table: str) -> dict[str, Column]:
    """name -> condition of a row that breaks the rule."""
    c = F.col
    return {
        "source_files": {"size_bytes is negative": c("size_bytes") < 0, "content_hash is no SHA-256": ~F.coalesce(F.lower(strip("content_hash")).rlike("^[0-9a-f]{64}$"), F.lit(False))},
        "symbols": {
            "name is blank": _blank("name"), "qualified_name is blank": _blank("qualified_name"), "start_line isn't positive": c("start_line") <= 0, "end_line is before start_line": c("end_line") < c("start_line"), "kind is unknown": ~c("kind").isin(*SYMBOL_KINDS),
        },
        "chunks": {"text is blank": _blank("text"), "code is blank": _blank("code"), "part_index is negative": c("part_index") < 0, "part_count isn't positive": c("part_count") <= 0, "part_index is out of range": c("part_index") >= c("part_count")},
        "import_references": {"module is blank": _blank("module"), "line isn't positive": c("line") <= 0},
        "call_references": {"callee_name is blank": _blank("callee_name"), "line isn't positive": c("line") <= 0},
        "symbol_relations": {"edge is a loop": c("source_symbol_id") == c("target_symbol_id"), "kind is unknown": ~c("kind").isin("CONTAINS", "CALLS")},
        "source_file_relations": {"edge is a loop": c("source_file_id") == c("target_file_id"), "kind is unknown": c("kind") != "IMPORTS"},
        "snapshots": {"commit_sha is no SHA-1": ~F.coalesce(F.lower(strip("commit_sha")).rlike("^[0-9a-f]{40}$"), F.lit(False)), "remote_url is blank": _blank("remote_url"), "status is unknown": ~c("status").isin(*STATUSES["snapshots"])},
        "projects": {"name is blank": _blank("name")},
    }[table]


def violations(rows: DataFrame, table: str) -> DataFrame:
    """The rows with ``violations``, the names of the rules each breaks; rows that break none are left out."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules(table).items()]))
    return rows.withColumn("violations", broken).where(F.size("violations") > 0)


def audit(rows: DataFrame, table: str) -> DataFrame:
    """Rows and broken rules per rule of a table, zeros included, in one pass."""
    names = list(rules(table))
    agg = rows.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"r{i}") for i, cond in enumerate(rules(table).values())])
    return agg.select(F.lit(table).alias("table_name"), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"r{i}") for i in range(len(names))]))).alias("rule", "broken"))


def repository_parts(url: Column) -> Column:
    """owner and name of a https://github.com/owner/name address, slash and .git at the end allowed; null for anything else."""
    u = F.regexp_replace(F.regexp_replace(strip(url), "/$", ""), r"\.git$", "")
    m = lambda i: F.regexp_extract(u, "^https://github\\.com/([^/]+)/([^/]+)$", i)
    return F.when(m(1) != "", F.struct(m(1).alias("owner"), m(2).alias("name")))


def stored_snapshot(rows: DataFrame) -> DataFrame:
    """Snapshots in stored form: hash stripped and lower-cased, a blank branch null."""
    b = strip("branch")
    return rows.withColumns({"commit_sha": F.lower(strip("commit_sha")), "branch": F.when(b != "", b)})
