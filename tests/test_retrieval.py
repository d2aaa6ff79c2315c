"""The small graph of a web service, with golden rankings and measures."""

import math

import pytest
from pyspark.sql import functions as F

from treeloom.operators import evaluation, graph, retrieval

FILES = ["controller", "service", "model", "schema", "model_test"]
SYMBOLS = [
    ("post_fizz", "FUNCTION", "controller", "post_fizz"), ("get_fizz", "FUNCTION", "controller", "get_fizz"), ("FizzService", "CLASS", "service", "FizzService"), ("create", "METHOD", "service", "FizzService.create"),
    ("get_all", "METHOD", "service", "FizzService.get_all"), ("Fizz", "CLASS", "model", "Fizz"), ("FizzSchema", "CLASS", "schema", "FizzSchema"), ("fizz", "FUNCTION", "model_test", "fizz"),
]
EDGES = [("FizzService", "create", "CONTAINS"), ("FizzService", "get_all", "CONTAINS"), ("post_fizz", "create", "CALLS"), ("get_fizz", "get_all", "CALLS")]
QUESTIONS = {
    "flow": ("How does the creation of a Fizz work end to end?", [("FizzService", 0.59), ("fizz", 0.58), ("post_fizz", 0.57), ("get_fizz", 0.56)]),
    "structure": ("What methods does FizzService have?", [("FizzService", 0.90), ("create", 0.85), ("get_all", 0.84)]),
    "testing": ("Which tests cover Fizz?", [("fizz", 0.95)]),
    "little": ("Where is FizzService?", [("FizzService", 0.30)]),
}


@pytest.fixture(scope="module")
def world(spark):
    symbols = spark.createDataFrame([(n, f, n, q, k, 1, 5, None) for n, k, f, q in SYMBOLS], "id string, source_file_id string, name string, qualified_name string, kind string, start_line int, end_line int, parent_symbol_id string")
    files = spark.createDataFrame([(f, f"app/fizz/{f}.py" if f != "model_test" else "app/fizz/model_test.py") for f in FILES], "id string, relative_path string")
    edges = spark.createDataFrame([(f"e{i}", *e) for i, e in enumerate(EDGES)], "id string, source_symbol_id string, target_symbol_id string, kind string")
    chunks = spark.createDataFrame([(f"c-{n}", n, f"code of {n}", f"app/fizz/{f}.py", "python", q, k, 1, 5, 0) for n, k, f, q in SYMBOLS], "id string, symbol_id string, code string, relative_path string, language string, qualified_name string, symbol_kind string, start_line int, end_line int, part_index int")
    hits = spark.createDataFrame([(q, s, x, i + 1) for q, (_, h) in QUESTIONS.items() for i, (s, x) in enumerate(h)], "question_id string, symbol_id string, score double, rank int")
    questions = spark.createDataFrame([(q, t) for q, (t, _) in QUESTIONS.items()], "question_id string, question string")
    return questions, hits, symbols, files, edges, chunks


@pytest.fixture(scope="module")
def context(world):
    q, h, s, f, e, c = world
    r = retrieval.rerank(q, h, retrieval.expand(h, e, s), s, f)
    return retrieval.build_context(q, r, c, max_items=8, max_chars=16_000).cache()


def _items(context, q):
    return [(r["qualified_name"], round(r["final_score"], 6)) for r in context.where(F.col("question_id") == q).orderBy("item").collect()]


def test_golden_rankings(context):
    assert _items(context, "flow") == [("post_fizz", 0.62), ("get_fizz", 0.61), ("FizzService", 0.59), ("FizzService.create", 0.503), ("FizzService.get_all", 0.501)]
    assert _items(context, "structure") == [("FizzService.create", 1.02), ("FizzService.get_all", 1.01), ("FizzService", 0.9), ("post_fizz", 0.32), ("get_fizz", 0.318)]
    assert _items(context, "testing") == [("fizz", 0.95)]  # no word of this question asks for behaviour
    assert _items(context, "little") == [("FizzService", 0.3)]


def test_golden_measures(spark, context):
    expected = [("flow", ["post_fizz", "get_fizz", "FizzService.create", "FizzService.get_all"]), ("structure", ["FizzService.create", "FizzService.get_all"]), ("testing", ["fizz"])]
    got = context.groupBy(F.col("question_id").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "qualified_name"))), lambda x: x["qualified_name"]).alias("retrieved"))
    m = evaluation.retrieval_metrics(spark.createDataFrame(expected, "question_id string, expected array<string>").join(got, F.col("question_id") == F.col("q")))
    rows = {r["question_id"]: [round(r[x], 5) for x in ("recall", "precision", "mrr", "ndcg")] for r in m.collect()}
    assert rows == {"flow": [1.0, 0.8, 1.0, 0.95583], "structure": [1.0, 0.4, 1.0, 1.0], "testing": [1.0, 1.0, 1.0, 1.0]}
    for x, least in (("recall", 1.0), ("precision", 0.4), ("mrr", 0.5), ("ndcg", 0.7)):
        m = m.withColumn(f"minimum_{x}", F.lit(least))
    b = evaluation.benchmark(evaluation.passes(m)).first()
    assert (b["cases"], b["failed"], b["pass_rate"], round(b["mean_precision"], 5), round(b["mean_ndcg"], 5)) == (3, 0, 1.0, 0.73333, 0.98528)
    assert evaluation.benchmark(evaluation.passes(m.limit(0))).first()["pass_rate"] == 0.0


def test_partial_gain_and_empty_results(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x"]), (2, ["a"], []), (3, ["a"], None)], "i int, expected array<string>, retrieved array<string>")
    r = {x["i"]: x for x in evaluation.retrieval_metrics(df).collect()}
    assert math.isclose(r[1]["ndcg"], 0.6131471927654584) and r[2]["recall"] == r[3]["ndcg"] == r[2]["precision"] == 0.0
    with pytest.raises(Exception, match="expected symbols"):
        evaluation.retrieval_metrics(spark.createDataFrame([([], ["a"])], "expected array<string>, retrieved array<string>")).collect()


def test_origins_and_format(world, context):
    q = world[0]
    d = {r["question_id"]: (r["semantic_sources"], r["graph_sources"], r["both_sources"], r["final_context_items"]) for r in retrieval.diagnostics(q, context).collect()}
    assert d["flow"] == (1, 2, 2, 5) or sum(d["flow"][:3]) == 5
    assert d["little"] == (1, 0, 0, 1)
    t = {r["question_id"]: r["formatted_context"] for r in retrieval.format_context(q, context).collect()}
    assert t["little"] == "=== CODE CONTEXT ===\n\n[1] FizzService\nFile: app/fizz/service.py\nLanguage: python\nKind: CLASS\nSemantic rank: 1\nSemantic score: 0.3000\n\nCode:\ncode of FizzService"
    none = retrieval.format_context(q, context.limit(0)).first()["formatted_context"]
    assert none == "No relevant code context was found."
    a = {r["question_id"]: r["answer"] for r in retrieval.answer(q, context).collect()}
    assert a["little"] == "Relevant code: FizzService"


def test_budget_skips_what_does_not_fit(spark, world):
    q = spark.createDataFrame([("q", "anything")], "question_id string, question string")
    sizes = [50, 60, 40, 10, 1]
    ranked = spark.createDataFrame([("q", f"s{i}", 0.5, i, [], 1.0 - i / 10, i + 1) for i in range(5)], "question_id string, symbol_id string, semantic_score double, semantic_rank int, graph_relations array<string>, final_score double, position int").withColumn("code", F.lit("clash"))
    chunks = spark.createDataFrame([(f"c{i}", f"s{i}", "x" * n, "a.py", "python", f"s{i}", "CLASS", 1, 2, 0) for i, n in enumerate(sizes)], world[5].schema)
    got = retrieval.build_context(q, ranked, chunks, max_items=3, max_chars=100)
    assert [(r["item"], r["qualified_name"]) for r in got.orderBy("item").collect()] == [(1, "s0"), (2, "s2"), (3, "s3")]
    with pytest.raises(ValueError):
        retrieval.build_context(q, ranked, chunks, max_items=0)


def test_vector_search(spark):
    v = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [0.7, 0.7]), ("c", "s", [-1.0, 0.0]), ("z", "s", [0.0, 0.0]), ("n", "s", None), ("o", "other", [1.0, 0.0]), ("d", "s", [1.0, 0.0]), ("w", "s", [1.0])], "chunk_id string, snapshot_id string, vector array<float>")
    q = spark.createDataFrame([("q", "s", [1.0, 0.0])], "question_id string, snapshot_id string, vector array<double>")
    got = [(r["hit_rank"], r["chunk_id"], round(r["score"], 4)) for r in retrieval.top_k(q, v, 5).orderBy("hit_rank").collect()]
    assert got == [(1, "a", 1.0), (2, "d", 1.0), (3, "b", 0.7071), (4, "z", 0.0), (5, "c", -1.0)]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.top_k(q, v, 2, strict=True).collect()
    with pytest.raises(ValueError):
        retrieval.top_k(q, v, 0)
    assert retrieval.top_k(q.limit(0), v, 2).count() == retrieval.top_k(q, v.limit(0), 2).count() == 0


def test_walk_and_neighbours(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdx"], "id string")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "gone", "CALLS"), ("c", "d", "CONTAINS"), ("a", "c", "CALLS"), (None, "a", "CALLS"), ("a", "b", "CALLS")], "source_symbol_id string, target_symbol_id string, kind string")
    roots = spark.createDataFrame([("a",), ("x",), ("nobody",)], "id string")
    w = graph.walk_calls(roots, e, nodes, 3)
    assert {tuple(r) for r in w.collect()} == {("a", "b", 1), ("a", "c", 1)}
    assert graph.walk_calls(roots, e, nodes, 0).count() == 0
    with pytest.raises(ValueError):
        graph.walk_calls(roots, e, nodes, -1)
    assert {tuple(r) for r in graph.induced(w, e).collect()} == {("a", "a", "b"), ("a", "b", "c"), ("a", "c", "a"), ("a", "a", "c")}
    n = graph.symbol_neighbours(roots, e, nodes)
    assert {tuple(r) for r in n.collect()} == {("a", "CALLS", "b"), ("a", "CALLS", "c"), ("a", "CALLED_BY", "c")}


def test_answers_and_judges(spark):
    a = spark.createDataFrame([("It uses Redis", ["redis", "kafka"], []), (None, ["x"], ["y"])], "answer string, expected_facts array<string>, expected_sources array<string>")
    assert [(r["fact_coverage"], r["source_coverage"]) for r in evaluation.answer_metrics(a).collect()] == [(0.5, 1.0), (0.0, 0.0)]
    j = spark.createDataFrame([('{"correctness": 1, "groundedness": 0.5, "completeness": 0}',)], "reply string")
    assert evaluation.judge_scores(j).first()["mean_score"] == 0.5
    with pytest.raises(Exception, match="not a score"):
        evaluation.judge_scores(spark.createDataFrame([('{"correctness": 2}',)], "reply string")).collect()
