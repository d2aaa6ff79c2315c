"""Queries of the operators with exact results: shared spans, neighbours, leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions.records import uuid_key
from treeloom.llm import leaks, neighbours, spans
from treeloom.llm.winners import holding_rows
from treeloom.plans.data_queries import uuid_sql
from treeloom.sources.project import table


def _code(spark, sf_dir):
    rows = holding_rows(table(spark, sf_dir, "chunks").select("id", "code", "recorded_at"), "id")
    return rows.select(F.col("_key").alias("key"), F.col("code").alias("text"))


def p1_found(spark, sf_dir):
    """Each chunk with a stretch of 200 characters that stands in another chunk, and how many of its characters are shared."""
    return spans.shared_chars(_code(spark, sf_dir)).select(F.col("key").alias("chunk_id"), "shared_chars")


def p1_spans(spark, sf_dir):
    """The shared stretches themselves."""
    return spans.shared_spans(_code(spark, sf_dir)).select(F.col("key").alias("chunk_id"), F.col("start").alias("start_char"), F.col("stop").alias("stop_char"))


def _neighbours(spark, sf_dir):
    v = holding_rows(table(spark, sf_dir, "vectors").select("chunk_id", "snapshot_id", "vector", "recorded_at"), "chunk_id")
    return neighbours.nearest(v.select(uuid_key("snapshot_id").alias("grp"), F.col("_key").alias("id"), F.col("vector").alias("v")))


def p2_found(spark, sf_dir):
    """Pairs of chunks of one snapshot where one is among the five most similar of the other."""
    return neighbours.pairs(_neighbours(spark, sf_dir)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_neighbours(spark, sf_dir):
    """The five most similar chunks of each chunk."""
    return _neighbours(spark, sf_dir).select(F.col("id").alias("chunk_id"), F.col("near_id").alias("near_chunk_id"), F.round("similarity", 9).alias("similarity"))


def _leaks(spark, sf_dir):
    return leaks.leaked_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    """Each document with the items of which it holds at least 12 consecutive words."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark, sf_dir):
    """The leaked stretches, by offsets in the normalised text."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", F.col("start").alias("start_char"), F.col("stop").alias("stop_char"))


def p9_items(spark, sf_dir):
    """Which items leaked, into how many documents."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_clean(spark, sf_dir):
    """Every document with its leaked stretches removed."""
    docs = table(spark, sf_dir, "documents")
    return leaks.without_leaks(docs, _leaks(spark, sf_dir)).select("doc_id", F.length("text").alias("kept_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_spans, p2_found, p2_neighbours, p9_found, p9_spans, p9_items, p9_clean)}
_ID = uuid_sql("id")
_WINDOWS = f"""with ch as (select id, max(struct_pack(at_ := recorded_at, code := code)) v from (select {_ID} id, code, recorded_at from chunks) group by id),
w as (select id, v.code code, unnest(range(length(v.code) - 199)) a from ch where length(v.code) >= 200), h as (select id, a, md5(substr(code, a + 1, 200)) k from w),
hot as (select k from h group by k having min(id) <> max(id)), m as (select id, a, lag(a) over (partition by id order by a) p from h where k in (select k from hot))"""
_NEAR = f"""with v0 as (select chunk_id, max(struct_pack(at_ := recorded_at, s := s, v := vector)) r from (select {uuid_sql('chunk_id')} chunk_id, {uuid_sql('snapshot_id')} s, vector, recorded_at from vectors) group by 1),
v as (select chunk_id, r.s s, r.v::double[] v from v0 where len(r.v) = 64 and len(list_filter(r.v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(r.v, lambda x: x <> 0)) > 0),
sims as (select a.chunk_id id, b.chunk_id near, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 12) sim from v a join v b on a.s = b.s and a.chunk_id <> b.chunk_id),
best as (select * from (select *, row_number() over (partition by id order by sim desc, near) r from sims) where r <= 5)"""
SQL = {
    "p1_found": f"{_WINDOWS} select id chunk_id, sum(least(200, a - coalesce(p, a - 200)))::int shared_chars from m group by 1",
    "p1_spans": f"{_WINDOWS}, i as (select id, a, sum(case when p is null or a > p + 200 then 1 else 0 end) over (partition by id order by a) g from m) select id chunk_id, min(a) start_char, max(a) + 200 stop_char from i group by id, g",
    "p2_found": f"{_NEAR} select distinct least(id, near) chunk_id_a, greatest(id, near) chunk_id_b from best",
    "p2_neighbours": f"{_NEAR} select id chunk_id, near near_chunk_id, round(sim, 9) similarity from best",
}
