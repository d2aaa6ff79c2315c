import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treeloom.sources import project as P

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_walks_start_at_symbols_of_every_kind(spark):
    s, e = P.symbols(spark, DATA), P.symbol_relations(spark, DATA).where("kind = 'CALLS' and source_symbol_id <> target_symbol_id")
    calling = e.join(s.select(F.col("id").alias("target_symbol_id")), "target_symbol_id").join(s.select(F.col("id").alias("source_symbol_id"), F.col("kind").alias("k")), "source_symbol_id")
    want = {tuple(r) for r in calling.select("source_symbol_id", "k").distinct().collect()}
    assert {k for _, k in want} >= {"FUNCTION", "METHOD"}
    q = entry.queries()
    for name in ("walk_calls", "depth_index", "induced_subgraph"):
        assert {r[0] for r in q[name](spark, DATA).select("root_id").distinct().collect()} == {i for i, _ in want}, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_neighbours_of_symbols_and_files_of_every_kind(spark):
    q = entry.queries()
    assert {r[0] for r in q["symbol_neighbours"](spark, DATA).select("relation").distinct().collect()} == {"CONTAINS", "CALLS", "CALLED_BY"}
    s, e = P.symbols(spark, DATA), P.symbol_relations(spark, DATA)
    assert q["edges_of_nodes"](spark, DATA).where("direction = 'OUT'").count() == e.join(s, F.col("source_symbol_id") == s["id"], "left_semi").count() > 0
    f, e = P.source_files(spark, DATA).select("id"), P.source_file_relations(spark, DATA)
    both = e.join(f.withColumnRenamed("id", "source_file_id"), "source_file_id", "left_semi").join(f.withColumnRenamed("id", "target_file_id"), "target_file_id", "left_semi")
    got = q["file_neighbours"](spark, DATA)
    assert {r[0] for r in got.where("relation = 'IMPORTS'").select("file_id").distinct().collect()} == {r[0] for r in both.select("source_file_id").distinct().collect()}
