"""Registered queries of retrieval, answers and their evaluation, and of the pipelines from source text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import text as T
from treeloom.functions.records import latest, path_key, strip, uuid_key
from treeloom.functions.vectors import deterministic_embedding
from treeloom.operators import analysis, chunking, evaluation, retrieval
from treeloom.plans.data_queries import STRIP
from treeloom.plans.graph_queries import EDGES, FILES, INDEXED, SYMBOLS, asks_sql, latest_sql, test_path_sql
from treeloom.session import broadcast_if_small, materialize

from treeloom.sources import project as P

_K = 5


def questions(spark, sf_dir):
    """The held-out texts, each asked of one indexed snapshot, with their vectors."""
    snaps = P.indexed_snapshots(spark, sf_dir).select("snapshot_id", F.row_number().over(Window.orderBy("snapshot_id")).alias("_n"))
    n = snaps.agg(F.max("_n")).first()[0] or 1
    q = P.table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("question_id"), F.concat(F.lit("How does this work? "), F.col("item_text")).alias("question"), (F.col("item_id") % n + 1).alias("_k"))
    q = q.join(broadcast_if_small(snaps), F.col("_k") == F.col("_n")).select("question_id", "question", "snapshot_id")
    return retrieval.embed_questions(q)


def vectors(spark, sf_dir):
    v = P.table(spark, sf_dir, "vectors").select(uuid_key("chunk_id").alias("chunk_id"), uuid_key("snapshot_id").alias("snapshot_id"), uuid_key("symbol_id").alias("symbol_id"), "vector", "recorded_at")
    return latest(v, ["chunk_id"], ["snapshot_id", "symbol_id", "vector"])


def chunks(spark, sf_dir):
    c = P.table(spark, sf_dir, "chunks").select(
        uuid_key("id").alias("id"), uuid_key("symbol_id").alias("symbol_id"), "code", path_key("relative_path").alias("relative_path"), "language", strip("qualified_name").alias("qualified_name"), "symbol_kind", "start_line", "end_line", "part_index", "recorded_at"
    )
    return latest(c, ["id"], [x for x in c.columns if x not in ("id", "recorded_at")])


def _ranked(spark, sf_dir):
    # Every step is read more than once below it, by counts and joins, so each is written once.
    q, v, s = materialize(questions(spark, sf_dir), "questions"), vectors(spark, sf_dir), materialize(P.symbols(spark, sf_dir), "symbols")
    h = materialize(retrieval.hits(retrieval.top_k(q, v, _K), v, s), "hits")
    e = materialize(retrieval.expand(h, P.symbol_relations(spark, sf_dir), s), "expansions")
    return q, h, e, materialize(retrieval.rerank(q, h, e, s, P.source_files(spark, sf_dir)), "ranking")


def _context(spark, sf_dir, **budget):
    q, _, _, r = _ranked(spark, sf_dir)
    return q, retrieval.build_context(q, r, chunks(spark, sf_dir), **budget)


def vector_topk(spark, sf_dir):
    """The five chunks of a question's snapshot most similar to it."""
    return retrieval.top_k(questions(spark, sf_dir), vectors(spark, sf_dir), _K).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "hit_rank")


def deterministic_vectors(spark, sf_dir):
    """Vectors of 40 dimensions made of the documents' hashes."""
    e = F.posexplode(deterministic_embedding(F.coalesce("text", F.lit("")), 40)).alias("dim", "x")
    return P.table(spark, sf_dir, "documents").select("doc_id", e).groupBy("doc_id").agg(F.round(F.sum(F.col("x") * (F.col("dim") + 1)), 6).alias("weighted"), F.round(F.max(F.when(F.col("dim") == 33, F.col("x"))), 9).alias("x33"))


def hybrid_hits(spark, sf_dir):
    """Symbols found by similarity, each at its first chunk."""
    return _ranked(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


def hybrid_expansions(spark, sf_dir):
    """Neighbours of the found symbols."""
    return _ranked(spark, sf_dir)[2].select("question_id", "source_id", "relation", "target_id", F.round("score", 6).alias("score"))


def hybrid_rerank(spark, sf_dir):
    """The ranking of found symbols and their neighbours."""
    r = _ranked(spark, sf_dir)[3]
    return r.select("question_id", "symbol_id", F.round("semantic_score", 6).alias("semantic_score"), "semantic_rank", F.array_join("graph_relations", ", ").alias("relations"), F.round("final_score", 6).alias("final_score"), "position")


def _items(c):
    return c.select("question_id", "item", "chunk_id", "qualified_name", "retrieval_origin", F.round("final_score", 6).alias("final_score"))


def context_items(spark, sf_dir):
    """What goes into the context of each question at the usual budget."""
    return _items(_context(spark, sf_dir)[1])


def context_tight_budget(spark, sf_dir):
    """The same with room for four items of 700 characters in all."""
    return _items(_context(spark, sf_dir, max_items=4, max_chars=700)[1])


def answer_sources(spark, sf_dir):
    """Sources shown with an answer."""
    return retrieval.sources(_context(spark, sf_dir)[1]).select("question_id", "item", "relative_path", "qualified_name", "symbol_kind", "language", "start_line", "end_line", "semantic_rank", "retrieval_origin")


def retrieval_diagnostics(spark, sf_dir):
    """Sources of each question by origin."""
    return retrieval.diagnostics(*_context(spark, sf_dir))


def formatted_context(spark, sf_dir):
    """The context as one text: its length and number of lines."""
    f = retrieval.format_context(*_context(spark, sf_dir))
    return f.select("question_id", F.length("formatted_context").alias("chars"), F.size(F.split("formatted_context", "\n")).alias("lines"))


def answers(spark, sf_dir):
    """Extractive answers."""
    return retrieval.answer(*_context(spark, sf_dir)).select("question_id", "answer")


def retrieval_metrics(spark, sf_dir):
    """Recall, precision, MRR and nDCG of each question, taking what similarity alone finds as expected."""
    _, h, _, r = _ranked(spark, sf_dir)
    expected = h.groupBy("question_id").agg(F.sort_array(F.collect_set("symbol_id")).alias("expected"))
    got = r.where("position <= 4").groupBy(F.col("question_id").alias("_q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol_id"))), lambda x: x["symbol_id"]).alias("retrieved"))
    m = evaluation.retrieval_metrics(expected.join(got, F.col("question_id") == F.col("_q"), "left"))
    return m.select("question_id", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "hit_rate", "mrr", "ndcg")], "expected_count", "retrieved_count", "relevant_retrieved_count")


def benchmark_summary(spark, sf_dir):
    """Means and pass rate over all questions."""
    m = retrieval_metrics(spark, sf_dir)
    for x in ("recall", "precision", "mrr", "ndcg"):
        m = m.withColumn(f"minimum_{x}", F.lit(0.5))
    b = evaluation.benchmark(evaluation.passes(m))
    return b.select("cases", "failed", *[F.round(x, 6).alias(x) for x in ("pass_rate", "mean_recall", "mean_precision", "mean_hit_rate", "mean_mrr", "mean_ndcg")])


def answer_metrics(spark, sf_dir):
    """How much of two expected facts and a source each document's text names."""
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"), F.array(F.lit("Reader"), F.lit("group")).alias("expected_facts"), F.array(F.lit("see also")).alias("expected_sources"))
    return evaluation.answer_metrics(d).select("doc_id", F.round("fact_coverage", 6).alias("fact_coverage"), F.round("source_coverage", 6).alias("source_coverage"))


def embedding_texts(spark, sf_dir):
    """The text that is embedded for each chunk, from its parts."""
    c = chunks(spark, sf_dir)
    t = chunking.embedding_text(F.coalesce("language", F.lit("")), F.col("relative_path"), F.coalesce("qualified_name", F.lit("")), F.col("symbol_kind"), F.col("code"))
    return c.select("id", F.sha2(t, 256).alias("text_hash"))


def code_lines(spark, sf_dir):
    """Lines and first indentation of each chunk's code."""
    c = chunks(spark, sf_dir).withColumn("l", T.split_lines(F.col("code")))
    return c.select("id", F.size("l").alias("lines"), F.length(T.indentation(F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")))).alias("indent"))


def _checkout(spark, sf_dir):
    c = P.table(spark, sf_dir, "file_contents").select(uuid_key("source_file_id").alias("_id"), path_key("path").alias("_p"), "content", "recorded_at")
    c = latest(c, ["_p"], ["_id", "content"]).select("_id", "content")
    return P.source_files(spark, sf_dir).join(c, F.col("id") == F.col("_id")).select("id", "snapshot_id", "relative_path", "language", "content")


def extracted_symbols(spark, sf_dir):
    """Symbols of every stored source, with parents and ids."""
    return analysis.analyze(_checkout(spark, sf_dir))["symbols"].select("id", "source_file_id", "qualified_name", "kind", "start_line", "end_line", "parent_symbol_id")


def extracted_imports(spark, sf_dir):
    """Imports of every stored source."""
    return analysis.analyze(_checkout(spark, sf_dir))["import_references"].select("id", "source_file_id", "module", "imported_name", "alias", "line")


def extracted_import_edges(spark, sf_dir):
    """Resolved imports between stored sources."""
    return analysis.analyze(_checkout(spark, sf_dir))["source_file_relations"]


def extracted_symbol_edges(spark, sf_dir):
    """CONTAINS and CALLS edges of stored sources."""
    return analysis.analyze(_checkout(spark, sf_dir))["symbol_relations"]


def analysis_counters(spark, sf_dir):
    """Files, skipped files, errors and symbols per snapshot."""
    f = _checkout(spark, sf_dir)
    return analysis.counters(f, analysis.analyze(f))


def source_chunks(spark, sf_dir):
    """Chunks cut from stored sources by their extracted symbols."""
    f = _checkout(spark, sf_dir)
    return analysis.index(f, analysis.analyze(f)["symbols"])["chunks"].select("id", "symbol_id", "qualified_name", F.length("code").alias("chars"), F.sha2("text", 256).alias("text_hash"))


def index_status(spark, sf_dir):
    """What indexing did with each file."""
    f = _checkout(spark, sf_dir)
    return analysis.index(f, analysis.analyze(f)["symbols"])["status"].groupBy("status").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, deterministic_vectors, hybrid_hits, hybrid_expansions, hybrid_rerank, context_items, context_tight_budget, answer_sources, retrieval_diagnostics, formatted_context, answers, retrieval_metrics, benchmark_summary,
        answer_metrics, embedding_texts, code_lines, extracted_symbols, extracted_imports, extracted_import_edges, extracted_symbol_edges, analysis_counters, source_chunks, index_status,
    )
}

_BYTE = "('0x' || substr(h, 2 * (i % 32) + 1, 2))::int"
_VEC = latest_sql("vectors", ["chunk_id", "snapshot_id", "symbol_id"], {"vector": "vector"}, "chunk_id")
_CH = latest_sql("chunks", ["id", "symbol_id"], {
    "code": "code", "relative_path": "relative_path", "language": "language", "qualified_name": STRIP.format("qualified_name"), "symbol_kind": "symbol_kind", "start_line": "start_line", "end_line": "end_line", "part_index": "part_index",
})
_Q = f"""idx as (select snapshot_id, row_number() over (order by snapshot_id) n from ({INDEXED})),
q as (select item_id::varchar question_id, 'How does this work? ' || item_text question, snapshot_id from eval_items join idx on n = item_id % (select max(n) from idx) + 1),
qv as (select question_id, question, snapshot_id, list_transform(range(64), lambda i: ('0x' || substr(sha256(question), 2 * (i % 32) + 1, 2))::int / 255.0::double * 2 - 1) qvec from q),
vec as (select * from ({_VEC}) where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0),
sims as (select question_id, chunk_id, round(case when norm = 0 then 0 else dot / norm end, 12) score from (select question_id, chunk_id, list_dot_product(qvec, v) dot, sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(v, v)) norm
  from (select question_id, qvec, chunk_id, vector::double[] v from qv join vec using (snapshot_id)))),
top as (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) hit_rank from sims) where hit_rank <= {_K})"""
_H = f"""{_Q}, syms as ({SYMBOLS}), edges as ({EDGES}), files as ({FILES}),
h0 as (select t.question_id, v.symbol_id, min(struct_pack(r := t.hit_rank, s := t.score)) b from top t join vec v using (chunk_id) where v.symbol_id in (select id from syms) group by 1, 2),
hits as (select question_id, symbol_id, b.s score, row_number() over (partition by question_id order by b.r) rank from h0),
nb as (select distinct * from (select source_symbol_id symbol_id, kind relation, target_symbol_id other from edges where kind in ('CALLS', 'CONTAINS') union all select target_symbol_id, 'CALLED_BY', source_symbol_id from edges where kind = 'CALLS') where other in (select id from syms)),
exp as (select h.question_id, h.symbol_id source_id, n.relation, n.other target_id, h.score, h.rank from hits h join nb n using (symbol_id))"""
_R = f"""{_H}, e1 as (select e.question_id, e.target_id symbol_id, struct_pack(r := e.rank, o := case relation when 'CALLS' then 0 when 'CALLED_BY' then 1 else 2 end, n := e.target_id) seq, e.source_id,
  case relation when 'CALLS' then 'CALLED_BY' when 'CALLED_BY' then 'CALLS' else 'CONTAINED_BY' end || ':' || s.qualified_name as label, case relation when 'CONTAINS' then 0.08 + 0.10 * score else 0.15 + 0.20 * score end bonus from exp e join syms s on s.id = e.source_id),
e2 as (select *, case when row_number() over (partition by question_id, symbol_id, label order by seq) = 1 then 1 else 0 end fresh from e1),
e3 as (select *, sum(fresh) over (partition by question_id, symbol_id order by seq rows unbounded preceding) n from e2),
g as (select question_id, symbol_id, sum(bonus::double + 0.05 * (n - 1))::double add_, array_to_string(list(label order by seq) filter (fresh = 1), ', ') relations, min(seq) first_ from e3 group by 1, 2),
j as (select coalesce(h.question_id, g.question_id) question_id, coalesce(h.symbol_id, g.symbol_id) symbol_id, h.score semantic_score, h.rank semantic_rank, coalesce(g.relations, '') relations, coalesce(h.score, 0) + coalesce(g.add_, 0) base, g.first_ from hits h full join g using (question_id, symbol_id)),
ranked0 as (select j.question_id, j.symbol_id, semantic_score, semantic_rank, relations, first_, base - case when {test_path_sql('f.relative_path')} and not {asks_sql('q.question', T.TEST_WORDS)} then 0.12 else 0 end
  + case when s.kind in ('FUNCTION', 'METHOD') and {asks_sql('q.question', T.BEHAVIOUR_WORDS)} then 0.05 else 0 end final_score from j join syms s on s.id = j.symbol_id left join files f on f.id = s.source_file_id join q using (question_id)),
ranked as (select *, row_number() over (partition by question_id order by round(final_score, 12) desc, coalesce(semantic_rank, 2147483647), first_) as position from ranked0)"""


def _ctx(items: int, chars: int) -> str:
    return f"""{_R.replace("idx as", "recursive_ as (select 1), idx as", 1)}, ch as ({_CH}), fc as (select symbol_id, v.* from (select symbol_id, min(struct_pack(p := part_index, id := id, code := code, relative_path := relative_path, language := language, qualified_name := qualified_name, symbol_kind := symbol_kind, start_line := start_line, end_line := end_line)) v from ch where symbol_id is not null group by 1)),
cand as (select r.*, fc.id chunk_id, fc.code, fc.relative_path, fc.language, fc.qualified_name, fc.symbol_kind, fc.start_line, fc.end_line, row_number() over (partition by r.question_id order by r.position) k from ranked r join fc on fc.symbol_id = r.symbol_id join q using (question_id)
  where round(r.final_score, 12) >= 0.2 and ({asks_sql('q.question', T.TEST_WORDS_CONTEXT)} or not {test_path_sql('fc.relative_path')})),
fold(question_id, k, used, n, took) as (select question_id, 0, 0, 0, false from q union all select f.question_id, c.k, case when f.n < {items} and f.used + length(c.code) <= {chars} then f.used + length(c.code) else f.used end,
  case when f.n < {items} and f.used + length(c.code) <= {chars} then f.n + 1 else f.n end, f.n < {items} and f.used + length(c.code) <= {chars} from fold f join cand c on c.question_id = f.question_id and c.k = f.k + 1),
ctx as (select c.*, f.n item, case when semantic_rank is not null and relations <> '' then 'BOTH' when relations <> '' then 'GRAPH' else 'SEMANTIC' end retrieval_origin from cand c join fold f on f.question_id = c.question_id and f.k = c.k where f.took)"""


_CTX = "with recursive " + _ctx(retrieval.MAX_ITEMS, retrieval.MAX_CHARS)
_TIGHT = "with recursive " + _ctx(4, 700)
_ITEM = "select question_id, item, chunk_id, qualified_name, retrieval_origin, round(final_score, 6) final_score from ctx"
_SECTION = """'[' || item || '] ' || qualified_name || chr(10) || 'File: ' || relative_path || chr(10) || 'Language: ' || coalesce(language, 'None') || chr(10) || 'Kind: ' || symbol_kind || case when semantic_rank is not null then chr(10) || 'Semantic rank: ' || semantic_rank else '' end
 || case when semantic_score is not null then chr(10) || 'Semantic score: ' || printf('%.4f', semantic_score) else '' end || case when relations <> '' then chr(10) || 'Graph relations: ' || relations else '' end || chr(10) || chr(10) || 'Code:' || chr(10) || code"""
_FMT = f"select q.question_id, coalesce(t, '{retrieval.NO_CONTEXT}') t from q left join (select question_id, '=== CODE CONTEXT ===' || chr(10) || chr(10) || array_to_string(list({_SECTION} order by item), chr(10) || chr(10)) t from ctx group by 1) using (question_id)"
_MET = f"""with {_R}, ex as (select question_id, list(symbol_id) e from hits group by 1), got as (select question_id, symbol_id, position from ranked where position <= 4),
m as (select ex.question_id, len(ex.e) ne, (select count(*) from got where got.question_id = ex.question_id) ng, (select count(*) from got where got.question_id = ex.question_id and list_contains(ex.e, got.symbol_id)) nb,
  (select min(position) from got where got.question_id = ex.question_id and list_contains(ex.e, got.symbol_id)) f, (select sum(1.0::double / log2(position + 1)) from got where got.question_id = ex.question_id and list_contains(ex.e, got.symbol_id)) dcg from ex),
met as (select question_id, round(nb / ne, 6) recall, round(case when ng > 0 then nb / ng else 0 end, 6)::double as precision, (case when nb > 0 then 1 else 0 end)::double hit_rate, round(coalesce(1.0::double / f, 0), 6) mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(ne, ng) + 1), lambda r: 1.0::double / log2(r + 1))), 0), 6) ndcg, ne expected_count, ng retrieved_count, nb relevant_retrieved_count from m)"""

SQL = {
    "vector_topk": f"with {_Q} select question_id, chunk_id, round(score, 6) score, hit_rank from top",
    "deterministic_vectors": f"select doc_id, round(list_sum(list_transform(range(40), lambda i: ({_BYTE} / 255.0::double * 2 - 1) * (i + 1))), 6) weighted, round(('0x' || substr(h, 3, 2))::int / 255.0::double * 2 - 1, 9) x33 from (select doc_id, sha256(coalesce(text, '')) h from documents)",
    "hybrid_hits": f"with {_H} select question_id, symbol_id, round(score, 6) score, rank from hits",
    "hybrid_expansions": f"with {_H} select question_id, source_id, relation, target_id, round(score, 6) score from exp",
    "hybrid_rerank": f"with {_R} select question_id, symbol_id, round(semantic_score, 6) semantic_score, semantic_rank, relations, round(final_score, 6) final_score, position from ranked",
    "context_items": f"{_CTX} {_ITEM}",
    "context_tight_budget": f"{_TIGHT} {_ITEM}",
    "answer_sources": f"{_CTX} select question_id, item, relative_path, qualified_name, symbol_kind, language, start_line, end_line, semantic_rank, retrieval_origin from ctx",
    "retrieval_diagnostics": f"{_CTX} select q.question_id, count(*) filter (retrieval_origin = 'SEMANTIC') semantic_sources, count(*) filter (retrieval_origin = 'GRAPH') graph_sources, count(*) filter (retrieval_origin = 'BOTH') both_sources, count(item) final_context_items from q left join ctx using (question_id) group by 1",
    "formatted_context": f"{_CTX} select question_id, length(t) chars, len(string_split(t, chr(10))) as lines from ({_FMT})",
    "answers": f"{_CTX} select q.question_id, coalesce('Relevant code: ' || list, '{retrieval.NO_CONTEXT}') answer from q left join (select question_id, array_to_string(list(qualified_name order by item), ', ') list from ctx group by 1) using (question_id)",
    "retrieval_metrics": f"{_MET} select * from met",
    "benchmark_summary": f"{_MET}, p as (select *, recall >= 0.5 and precision >= 0.5 and mrr >= 0.5 and ndcg >= 0.5 ok from met) select count(*) cases, count(*) filter (not ok) failed, round(avg(ok::int), 6) pass_rate, round(avg(recall), 6) mean_recall, round(avg(precision), 6) mean_precision, round(avg(hit_rate), 6) mean_hit_rate, round(avg(mrr), 6) mean_mrr, round(avg(ndcg), 6) mean_ndcg from p",
    "answer_metrics": "select doc_id, round((contains(lower(text), 'reader')::int + contains(lower(text), 'group')::int) / 2, 6) fact_coverage, contains(lower(text), 'see also')::int::double source_coverage from documents",
    "embedding_texts": f"select id, sha256('Language: ' || coalesce(language, '') || chr(10) || 'File: ' || relative_path || chr(10) || 'Symbol: ' || coalesce(qualified_name, '') || chr(10) || 'Kind: ' || symbol_kind || chr(10) || chr(10) || 'Code:' || chr(10) || code) text_hash from ({_CH})",
    "code_lines": f"select id, len(l) - case when l[-1] = '' then 1 else 0 end as lines, length(regexp_extract(coalesce(l[1], ''), '^\\s*')) indent from (select id, regexp_split_to_array(code, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') l from ({_CH}))",
}
