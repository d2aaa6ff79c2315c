"""The symbol and file graphs: neighbours, bounded walks from many roots at once, induced sub-graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.session import broadcast_if_small, cut


def symbol_neighbours(roots: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, relation, neighbour_id) of each root: CONTAINS and CALLS by source, CALLED_BY by target of a call.

    Edges to or from symbols without a row are passed over; a root without a row has no neighbours; containers of a symbol
    are not neighbours.
    """
    ids = symbols.select(F.col("id").alias("_sym"))
    r = broadcast_if_small(roots.select(F.col(roots.columns[0]).alias("symbol_id")).distinct().join(ids, F.col("symbol_id") == F.col("_sym"), "left_semi"))
    out = edges.where(F.col("kind").isin("CONTAINS", "CALLS")).join(r, F.col("source_symbol_id") == F.col("symbol_id")).select("symbol_id", F.col("kind").alias("relation"), F.col("target_symbol_id").alias("neighbour_id"))
    back = edges.where("kind = 'CALLS'").join(r, F.col("target_symbol_id") == F.col("symbol_id")).select("symbol_id", F.lit("CALLED_BY").alias("relation"), F.col("source_symbol_id").alias("neighbour_id"))
    return out.unionByName(back).distinct().join(ids, F.col("neighbour_id") == F.col("_sym"), "left_semi")


def file_neighbours(roots: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, relation, neighbour_id) of each root file: IMPORTS and IMPORTED_BY, to and from files with a row."""
    ids = files.select(F.col("id").alias("_f"))
    r = broadcast_if_small(roots.select(F.col(roots.columns[0]).alias("file_id")).distinct().join(ids, F.col("file_id") == F.col("_f"), "left_semi"))
    out = edges.join(r, F.col("source_file_id") == F.col("file_id")).select("file_id", F.lit("IMPORTS").alias("relation"), F.col("target_file_id").alias("neighbour_id"))
    back = edges.join(r, F.col("target_file_id") == F.col("file_id")).select("file_id", F.lit("IMPORTED_BY").alias("relation"), F.col("source_file_id").alias("neighbour_id"))
    return out.unionByName(back).distinct().join(ids, F.col("neighbour_id") == F.col("_f"), "left_semi")


def walk(roots: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int, source: str, target: str) -> DataFrame:
    """(root_id, node_id, depth): every node reached from a root within ``max_depth`` steps, at its least depth, root excluded.

    A breadth-first frontier over all roots at once: one join per level, nodes seen before left out by an anti join, lineage cut
    per level. Cycles end by themselves, edges to nodes without a row lead nowhere. A negative depth is an error.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    known = nodes.select(F.col("id").alias("_known"))
    e = edges.select(F.col(source).alias("_src"), F.col(target).alias("_dst")).where("_src is not null and _dst is not null").distinct()
    e = cut(e.join(known, F.col("_dst") == F.col("_known"), "left_semi"))
    start = roots.select(F.col(roots.columns[0]).alias("root_id")).distinct().join(known, F.col("root_id") == F.col("_known"), "left_semi")
    seen = start.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("node_id") == F.col("_src")).select("root_id", F.col("_dst").alias("node_id")).distinct()
        frontier = cut(step.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def walk_calls(roots: DataFrame, edges: DataFrame, symbols: DataFrame, max_depth: int = 3) -> DataFrame:
    return walk(roots, edges.where("kind = 'CALLS'"), symbols, max_depth, "source_symbol_id", "target_symbol_id")


def walk_imports(roots: DataFrame, edges: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    return walk(roots, edges.where("kind = 'IMPORTS'"), files, max_depth, "source_file_id", "target_file_id")


def depth_index(walked: DataFrame) -> DataFrame:
    """``index``: the place of a node among the nodes of its root and depth, by id from 0."""
    return walked.withColumn("index", F.row_number().over(Window.partitionBy("root_id", "depth").orderBy("node_id")) - 1)


def induced(walked: DataFrame, edges: DataFrame, kind: str = "CALLS") -> DataFrame:
    """(root_id, source, target): edges of a kind whose ends are both the root or reached from it."""
    inside = walked.select("root_id", "node_id").unionByName(walked.select("root_id", F.col("root_id").alias("node_id")).distinct())
    e = edges.where(F.col("kind") == kind).select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target")).distinct()
    a = e.join(inside, F.col("source") == F.col("node_id")).drop("node_id")
    b = inside.select(F.col("root_id").alias("_r"), "node_id")
    return a.join(b, (F.col("target") == F.col("node_id")) & (F.col("root_id") == F.col("_r")), "left_semi").select("root_id", "source", "target")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, direction, other_id, kind): edges out of and into each of the given nodes."""
    n = broadcast_if_small(nodes.select(F.col(nodes.columns[0]).alias("node_id")).distinct())
    out = edges.join(n, F.col("source_symbol_id") == F.col("node_id")).select("node_id", F.lit("OUT").alias("direction"), F.col("target_symbol_id").alias("other_id"), "kind")
    into = edges.join(n, F.col("target_symbol_id") == F.col("node_id")).select("node_id", F.lit("IN").alias("direction"), F.col("source_symbol_id").alias("other_id"), "kind")
    return out.unionByName(into)
