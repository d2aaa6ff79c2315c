"""Answering questions over a snapshot: vector search, one step of graph, reranking, context within a budget.

All operators take any number of questions: (question_id, question, snapshot_id) is carried through, so one plan serves them all.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.text import BEHAVIOUR_WORDS, TEST_WORDS, TEST_WORDS_CONTEXT, asks, is_test_path
from treeloom.functions.vectors import deterministic_embedding
from treeloom.operators.graph import symbol_neighbours
from treeloom.session import broadcast_if_small

#: Defaults of a question.
QUESTION_BLOCK = 20_000  # questions that are searched in one pass over the vectors
TOP_K, MAX_ITEMS, MAX_CHARS, MIN_SCORE, TEST_PENALTY, BEHAVIOUR_BOOST = 3, 6, 12_000, 0.20, 0.12, 0.05


def top_k(questions: DataFrame, vectors: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """(question_id, chunk_id, score, hit_rank): the k vectors of the question's snapshot most similar by cosine.

    questions: (question_id, snapshot_id, vector), collected when counted small, so that vectors are read where they lie and
    each task passes on k rows a question; a larger set goes through in blocks of that size. Scores count to 12 decimals, so that
    equal vectors tie whatever the order of summation. A norm of 0 gives 0; ties fall to
    the smaller chunk_id; a null vector takes no part, one of another dimension is an error if ``strict``, else left out.
    """
    if k <= 0:
        raise ValueError("top_k must be positive")
    spark = vectors.sparkSession
    q = questions.select("question_id", "snapshot_id", "vector").where("snapshot_id is not null and vector is not null")
    n = q.count()
    blocks = max(1, -(-n // QUESTION_BLOCK))
    parts = []
    for block in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        by: dict[str, list] = defaultdict(list)
        for r in part.toLocalIterator():
            by[r["snapshot_id"]].append((r["question_id"], r["vector"]))
        if by:
            asked = spark.sparkContext.broadcast({s: ([i for i, _ in x], np.array([v for _, v in x], np.float64)) for s, x in by.items()})
            parts.append(_scan(vectors.where(F.col("snapshot_id").isin(list(by))) if len(by) <= 1000 else vectors, asked, k, strict))
    if not parts:
        return spark.createDataFrame([], "question_id string, chunk_id string, score double, hit_rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k)


def _scan(vectors: DataFrame, asked, k: int, strict: bool) -> DataFrame:
    out = [("question_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())]

    def run(batches):
        best: dict[str, list[tuple[float, str]]] = {}
        table = asked.value
        for b in batches:
            rows: dict[str, list[int]] = defaultdict(list)
            values = b.column(2).to_pylist()
            for i, s in enumerate(b.column(1).to_pylist()):
                if s in table and values[i] is not None:
                    if len(values[i]) == table[s][1].shape[1] and None not in values[i]:
                        rows[s].append(i)
                    elif strict:
                        raise ValueError("vectors of different dimensions")
            names = b.column(0).to_pylist()
            for s, at in rows.items():
                ids, q = table[s]
                x = np.array([values[i] for i in at], np.float64)
                norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                dot = q @ x.T
                score = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
                score = np.where(np.isfinite(score), np.round(score, 12), -2.0)
                for j, question in enumerate(ids):
                    top = range(len(at)) if len(at) <= k else np.flatnonzero(score[j] >= np.partition(score[j], -k)[-k])
                    mine = best.setdefault(question, [])
                    mine += [(-float(score[j][i]), names[at[i]]) for i in top if score[j][i] > -2.0]
                    mine.sort()
                    del mine[k:]
        rows_ = [(q, c, -s) for q, m in best.items() for s, c in m]
        cols = list(zip(*rows_, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, out, strict=True)], [n for n, _ in out])

    return vectors.select("chunk_id", "snapshot_id", "vector").mapInArrow(run, "question_id string, chunk_id string, score double")


def embed_questions(questions: DataFrame, dimension: int = 64, text: str = "question") -> DataFrame:
    """questions with the deterministic vector of their text; a blank question is an error."""
    blank = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.raise_error(F.lit("the question must not be blank"))).otherwise(F.lit(True))
    return questions.where(blank).withColumn("vector", deterministic_embedding(F.col(text), dimension))


def hits(found: DataFrame, vectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(question_id, symbol_id, score, rank) from chunk hits: unknown symbols left out, a symbol's first hit kept, ranks from 1."""
    v = vectors.select(F.col("chunk_id").alias("_c"), "symbol_id")
    ids = symbols.select(F.col("id").alias("_s"))
    j = broadcast_if_small(found).join(v, F.col("chunk_id") == F.col("_c")).join(ids, F.col("symbol_id") == F.col("_s"), "left_semi")
    first = j.groupBy("question_id", "symbol_id").agg(F.min(F.struct("hit_rank", "score")).alias("_b"))
    w = Window.partitionBy("question_id").orderBy("_b.hit_rank")
    return first.select("question_id", "symbol_id", F.col("_b.score").alias("score"), F.row_number().over(w).alias("rank"))


def expand(hit: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(question_id, source_id, relation, target_id, score, seq): the neighbours of every hit, in the order calls, callers, members."""
    n = symbol_neighbours(hit.select("symbol_id"), edges, symbols)
    order = F.when(F.col("relation") == "CALLS", 0).when(F.col("relation") == "CALLED_BY", 1).otherwise(2)
    j = broadcast_if_small(hit.select("question_id", F.col("symbol_id").alias("_h"), "rank", "score")).join(n, F.col("_h") == F.col("symbol_id"))
    return j.select("question_id", F.col("symbol_id").alias("source_id"), "relation", F.col("neighbour_id").alias("target_id"), "score", F.struct(F.col("rank").alias("r"), order.alias("o"), F.col("neighbour_id").alias("n")).alias("seq"))


def graph_bonus(relation: Column, score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(relation.isin("CALLS", "CALLED_BY"), F.lit(0.15) + F.lit(0.20) * s).when(relation == "CONTAINS", F.lit(0.08) + F.lit(0.10) * s).otherwise(F.lit(0.05))


def relation_label(relation: Column, source: Column) -> Column:
    flipped = F.when(relation == "CALLS", "CALLED_BY").when(relation == "CALLED_BY", "CALLS").when(relation == "CONTAINS", "CONTAINED_BY").otherwise(relation)
    return F.concat(flipped, F.lit(":"), source)


def rerank(questions: DataFrame, hit: DataFrame, expanded: DataFrame, symbols: DataFrame, files: DataFrame, test_penalty: float = TEST_PENALTY) -> DataFrame:
    """(question_id, symbol_id, semantic_score, semantic_rank, graph_relations, final_score, position) of hits and their neighbours.

    A hit starts at its score, any other symbol at nothing. Its expansions are added in the order they came, each with the bonus
    of its relation and 0.05 for every distinct label before it: a fold over a sorted array, so sums are those of sequential
    addition. Symbols in test files lose the penalty unless the question is about tests, functions and methods gain where it asks
    for behaviour. Position orders by score; ties keep hits before others, and the order they came in.
    """
    names = symbols.select(F.col("id").alias("_sid"), "qualified_name")
    e = broadcast_if_small(expanded).join(names, F.col("source_id") == F.col("_sid"))
    e = e.select("question_id", F.col("target_id").alias("symbol_id"), F.struct("seq", relation_label(F.col("relation"), F.col("qualified_name")).alias("label"), graph_bonus(F.col("relation"), F.col("score")).alias("bonus")).alias("x"))
    g = e.groupBy("question_id", "symbol_id").agg(F.array_sort(F.collect_list("x")).alias("_x"), F.min("x.seq").alias("_first"))
    h = hit.select("question_id", "symbol_id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
    j = h.join(g, ["question_id", "symbol_id"], "full_outer")

    def step(acc, x):
        labels = F.when(F.array_contains(acc["labels"], x["label"]), acc["labels"]).otherwise(F.array_append(acc["labels"], x["label"]))
        more = F.when(F.size(labels) > 1, F.lit(0.05) * (F.size(labels) - 1)).otherwise(F.lit(0.0))
        return F.struct((acc["score"] + x["bonus"] + more).alias("score"), labels.alias("labels"))

    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce("semantic_score", F.lit(0.0)).alias("score"), none.alias("labels"))
    j = j.withColumn("_f", F.when(F.col("_x").isNull(), start).otherwise(F.aggregate("_x", start, step)))
    s = symbols.select(F.col("id").alias("_sid"), F.col("kind").alias("_kind"), "source_file_id")
    f = files.select(F.col("id").alias("_file"), F.col("relative_path").alias("_path"))
    q = broadcast_if_small(questions.select(F.col("question_id").alias("_q"), asks(F.col("question"), TEST_WORDS).alias("_tests"), asks(F.col("question"), BEHAVIOUR_WORDS).alias("_acts")))
    j = broadcast_if_small(j).join(s, F.col("symbol_id") == F.col("_sid")).join(f, F.col("source_file_id") == F.col("_file"), "left").join(q, F.col("question_id") == F.col("_q"))
    score = F.col("_f.score")
    score = F.when(is_test_path(F.col("_path")) & ~F.col("_tests"), score - F.lit(test_penalty)).otherwise(score)
    score = F.when(F.col("_kind").isin("FUNCTION", "METHOD") & F.col("_acts"), score + F.lit(BEHAVIOUR_BOOST)).otherwise(score)
    j = j.select("question_id", "symbol_id", "semantic_score", "semantic_rank", F.col("_f.labels").alias("graph_relations"), score.alias("final_score"), F.coalesce("semantic_rank", F.lit(2**31 - 1)).alias("_r"), "_first")
    w = Window.partitionBy("question_id").orderBy(F.desc("final_score"), "_r", "_first")
    return j.withColumn("position", F.row_number().over(w)).drop("_r", "_first")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first part of each symbol's chunks; equal parts fall to the smaller id."""
    cols = ["code", "relative_path", "language", "qualified_name", "symbol_kind", "start_line", "end_line"]
    g = chunks.where("symbol_id is not null").groupBy("symbol_id").agg(F.min(F.struct("part_index", "id", *cols)).alias("_c"))
    return g.select("symbol_id", F.col("_c.id").alias("chunk_id"), *[F.col(f"_c.{c}").alias(c) for c in cols])


def build_context(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS, minimum_score: float = MIN_SCORE) -> DataFrame:
    """(question_id, item, ...): what of the ranking goes into the context, numbered from 1.

    Items under the minimum score (compared unrounded) and symbols without chunk are left out, and test files unless the question
    is about tests. Then greedily by rank: at most ``max_items``, passing over an item whose code would exceed ``max_chars``.
    """
    if max_items < 1 or max_chars < 1 or minimum_score < 0:
        raise ValueError("the budget must be positive and the minimum score not negative")
    r = broadcast_if_small(ranked.where(F.col("final_score") >= minimum_score).select("question_id", F.col("symbol_id").alias("_symbol"), "semantic_score", "semantic_rank", "graph_relations", "final_score", "position"))
    mine = chunks.join(r.select("_symbol").distinct(), F.col("symbol_id") == F.col("_symbol"), "left_semi")
    j = r.join(first_chunks(mine), F.col("_symbol") == F.col("symbol_id")).drop("_symbol")
    q = broadcast_if_small(questions.select(F.col("question_id").alias("_q"), asks(F.col("question"), TEST_WORDS_CONTEXT).alias("_tests")))
    j = j.join(q, F.col("question_id") == F.col("_q")).where(F.col("_tests") | ~is_test_path(F.col("relative_path"))).drop("_q", "_tests")
    sizes = j.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", F.length("code").alias("n")))).alias("_all"))

    def step(acc, x):
        fits = (F.size(acc["kept"]) < max_items) & (acc["used"] + x["n"] <= max_chars)
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["kept"], x["position"]).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    kept = sizes.select(F.col("question_id").alias("_q"), F.posexplode(F.aggregate("_all", start, step)["kept"]).alias("_i", "_p"))
    out = j.join(kept, (F.col("question_id") == F.col("_q")) & (F.col("position") == F.col("_p")))
    semantic = F.col("semantic_score").isNotNull() | F.col("semantic_rank").isNotNull()
    graph = F.size("graph_relations") > 0
    origin = F.when(semantic & graph, "BOTH").when(graph, "GRAPH").otherwise("SEMANTIC")
    return out.withColumn("item", F.col("_i") + 1).withColumn("retrieval_origin", origin).drop("_q", "_i", "_p", "position")


NO_CONTEXT = "No relevant code context was found."


def format_context(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(question_id, formatted_context): numbered sections in order; one fixed sentence where there is nothing."""
    c = F.col
    head = F.concat(F.lit("["), c("item").cast("string"), F.lit("] "), c("qualified_name"), F.lit("\nFile: "), c("relative_path"), F.lit("\nLanguage: "), F.coalesce("language", F.lit("None")), F.lit("\nKind: "), c("symbol_kind"))
    rank = F.when(c("semantic_rank").isNotNull(), F.concat(F.lit("\nSemantic rank: "), c("semantic_rank").cast("string"))).otherwise(F.lit(""))
    score = F.when(c("semantic_score").isNotNull(), F.concat(F.lit("\nSemantic score: "), F.format_string("%.4f", c("semantic_score")))).otherwise(F.lit(""))
    graph = F.when(F.size("graph_relations") > 0, F.concat(F.lit("\nGraph relations: "), F.array_join("graph_relations", ", "))).otherwise(F.lit(""))
    body = F.concat(head, rank, score, graph, F.lit("\n\nCode:\n"), c("code"))
    s = context.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("item", body.alias("b")))).alias("_s"))
    s = s.select(F.col("question_id").alias("_q"), F.concat(F.lit("=== CODE CONTEXT ===\n\n"), F.array_join(F.transform("_s", lambda x: x["b"]), "\n\n")).alias("_t"))
    j = questions.select("question_id").join(s, F.col("question_id") == F.col("_q"), "left")
    return j.select("question_id", F.coalesce("_t", F.lit(NO_CONTEXT)).alias("formatted_context"))


def diagnostics(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Sources per question by origin, and in all; zeros where there are none."""
    o = F.col("retrieval_origin")
    d = context.groupBy(F.col("question_id").alias("_q")).agg(F.count_if(o == "SEMANTIC").alias("s"), F.count_if(o == "GRAPH").alias("g"), F.count_if(o == "BOTH").alias("b"), F.count("*").alias("n"))
    j = questions.select("question_id").join(d, F.col("question_id") == F.col("_q"), "left")
    z = F.lit(0).cast("bigint")
    return j.select("question_id", F.coalesce("s", z).alias("semantic_sources"), F.coalesce("g", z).alias("graph_sources"), F.coalesce("b", z).alias("both_sources"), F.coalesce("n", z).alias("final_context_items"))


def sources(context: DataFrame) -> DataFrame:
    return context.select("question_id", "item", "relative_path", "qualified_name", "symbol_kind", "language", "start_line", "end_line", "semantic_score", "semantic_rank", "graph_relations", "retrieval_origin", "final_score")


def retrieve(questions: DataFrame, vectors: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ranking of each question (question_id, question, snapshot_id, vector): search, expansion, reranking."""
    h = hits(top_k(questions, vectors, k), vectors, symbols)
    return rerank(questions, h, expand(h, edges, symbols), symbols, files)


def answer(questions: DataFrame, context: DataFrame, generate=None) -> DataFrame:
    """(question_id, answer, formatted_context); ``generate(question, context)`` is a column function, by default an extract."""
    f = format_context(questions, context).join(questions.select(F.col("question_id").alias("_q"), "question"), F.col("question_id") == F.col("_q"))
    make = generate or (lambda q, c: F.when(c == NO_CONTEXT, c).otherwise(F.concat(F.lit("Relevant code: "), F.array_join(F.regexp_extract_all(c, F.lit(r"(?m)^\[\d+\] (.+)$"), F.lit(1)), ", "))))
    return f.select("question_id", make(F.col("question"), F.col("formatted_context")).alias("answer"), "formatted_context")
