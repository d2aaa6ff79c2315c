"""Version-5 uuids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.schemas import NAMESPACES


def uuid5(namespace: str, name: Column) -> Column:
    """The version-5 uuid of a name: SHA-1 of name space and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def entity_id(table: str, *parts: Column | str) -> Column:
    """Id of an entity from its parts joined by colons; a null part counts as the text None."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return uuid5(NAMESPACES[table], F.concat_ws(":", *cols))


def source_file_id() -> Column:
    return entity_id("source_files", "snapshot_id", "relative_path")


def symbol_id() -> Column:
    return entity_id("symbols", "source_file_id", "kind", "qualified_name", "start_line", "end_line")


def import_id() -> Column:
    return entity_id("import_references", "source_file_id", "module", "imported_name", "alias", "line")


def chunk_id() -> Column:
    return entity_id("chunks", "snapshot_id", "source_file_id", "symbol_id", "part_index")


def symbol_edge_id() -> Column:
    return entity_id("symbol_relations", "source_symbol_id", "kind", "target_symbol_id")


def file_edge_id() -> Column:
    return entity_id("source_file_relations", "source_file_id", "kind", "target_file_id")
