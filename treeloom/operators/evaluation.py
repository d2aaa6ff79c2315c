"""Quality of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r.cast("double") + 1))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """cases (expected, retrieved arrays, the latter in rank order) with recall, precision, hit_rate, mrr, ndcg and counts.

    Sets are compared without repetition; gains count every rank with an expected symbol. An empty expectation is an error, an
    empty or null result gives zeros.
    """
    none = F.array().cast("array<string>")
    e, got = F.array_distinct("expected"), F.coalesce("retrieved", none)
    e = F.when(F.size(F.coalesce("expected", none)) == 0, F.raise_error(F.lit("expected symbols can't be empty"))).otherwise(e)
    both = F.size(F.array_intersect(e, got))
    at = F.transform(F.filter(F.transform(got, lambda x, i: F.struct(x.alias("s"), (i + 1).alias("r"))), lambda x: F.array_contains(e, x["s"])), lambda x: x["r"])
    ideal_n = F.least(F.size(e), F.size(got))
    ideal = F.when(ideal_n > 0, _gain(F.sequence(F.lit(1), F.greatest(ideal_n, F.lit(1)))))
    unique = F.size(F.array_distinct(got))
    return cases.withColumns({
        "recall": both / F.size(e), "precision": F.when(unique > 0, both / F.greatest(unique, F.lit(1))).otherwise(F.lit(0.0)), "hit_rate": F.when(both > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        "mrr": F.when(F.size(at) > 0, F.lit(1.0) / F.try_element_at(at, F.lit(1))).otherwise(F.lit(0.0)), "ndcg": F.coalesce(_gain(at) / ideal, F.lit(0.0)),
        "expected_count": F.size(e), "retrieved_count": unique, "relevant_retrieved_count": both,
    })


def passes(metrics: DataFrame) -> DataFrame:
    """metrics with ``passed``: every measure reaches its minimum (columns minimum_recall, _precision, _mrr, _ndcg)."""
    ok = F.lit(True)
    for m in ("recall", "precision", "mrr", "ndcg"):
        ok = ok & (F.col(m) >= F.col(f"minimum_{m}"))
    return metrics.withColumn("passed", ok)


def benchmark(results: DataFrame, measures: tuple[str, ...] = ("recall", "precision", "hit_rate", "mrr", "ndcg")) -> DataFrame:
    """One row: cases, failed cases, pass rate and the mean of each measure; no cases give zeros."""
    n = F.count("*")
    rate = F.when(n > 0, F.count_if("passed") / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    return results.agg(n.alias("cases"), F.count_if(~F.col("passed")).alias("failed"), rate.alias("pass_rate"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in measures])


def answer_metrics(answers: DataFrame) -> DataFrame:
    """answers (answer, expected_facts, expected_sources) with the shares of facts and sources the answer names, whatever the case.

    Without expected sources their coverage is 1; without expected facts it is an error.
    """
    none = F.array().cast("array<string>")
    text = F.lower(F.coalesce("answer", F.lit("")))
    facts, sources = F.coalesce("expected_facts", none), F.coalesce("expected_sources", none)
    facts = F.when(F.size(facts) == 0, F.raise_error(F.lit("expected facts can't be empty"))).otherwise(facts)
    hit = lambda xs: F.size(F.filter(xs, lambda x: text.contains(F.lower(x))))
    return answers.withColumns({
        "matched_facts": hit(facts), "matched_sources": hit(sources), "fact_coverage": hit(facts) / F.size(facts), "source_coverage": F.when(F.size(sources) > 0, hit(sources) / F.greatest(F.size(sources), F.lit(1))).otherwise(F.lit(1.0)),
    })


def judge_scores(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replies with correctness, groundedness, completeness read from JSON, each within 0..1, and their mean; others are errors."""
    j = F.from_json(column, "correctness double, groundedness double, completeness double")
    names = ("correctness", "groundedness", "completeness")
    checked = {n: F.when(j[n].between(0, 1), j[n]).otherwise(F.raise_error(F.lit(f"{n} is not a score"))) for n in names}
    out = replies.withColumns(checked)
    return out.withColumn("mean_score", (F.col("correctness") + F.col("groundedness") + F.col("completeness")) / 3)
