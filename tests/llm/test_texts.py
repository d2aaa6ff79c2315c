import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeloom.llm import lexicon, packing, subjects


@pytest.mark.parametrize("seed", range(3))
def test_plans_use_all_and_fill_well(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(5.4, 0.8)) + 1) for _ in range(3_000))
    p = packing.plan(dict(counts))
    used = Counter()
    for items, n in p:
        assert sum(items) <= 2048
        for x in items:
            used[x] += n
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    containers = sum(n for _, n in p)
    assert containers <= -(-total // 2048) * 1.01 + 1


def test_plans_of_hot_lengths_stay_short():
    p = packing.plan({700: 10**9, 648: 10**9, 3: 5})
    assert sum(n for _, n in p) >= 10**9 * (700 + 648) // 2048 and len(p) < 20
    assert packing.plan({}) == [] and packing.plan({2048: 7}) == [((2048,), 7)]
    assert packing.plan({1024: 3}) == [((1024, 1024), 1), ((1024,), 1)]


@pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="needs the vocabulary")
def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " word" * rng.randrange(1, 400)) for i in range(400)] + [(1000, None), (1001, ""), (1002, " word" * 5000), (1003, " word" * 4096), (7, " word" * 9), (None, "x")] + [(2000 + i, " word" * 100) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("rest", F.lit("clash"))
    got = packing.pack(df).collect()
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"]] += r["tokens"]
    want = Counter()
    for d, t in rows:
        if d is not None:
            want[d] += (t or "").count("word")
    assert {k: v for k, v in tokens.items()} == {k: want[k] for k in tokens} and set(tokens) == set(want)
    by: dict = {}
    for r in got:
        if r["tokens"]:
            by.setdefault(r["container_id"], []).append((r["start"], r["tokens"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert sorted(by) == list(range(len(by))) and len(by) <= -(-sum(want.values()) // 2048) + 2
    assert sorted((r["piece"], r["tokens"]) for r in got if r["doc_id"] == 1002) == [(0, 2048), (1, 2048), (2, 904)]
    assert [(r["tokens"], r["container_id"]) for r in got if r["doc_id"] == 1000] == [(0, 0)]
    f = packing.fill(packing.pack(df)).first()
    assert f["containers"] == len(by) and f["tokens"] == sum(want.values())
    assert packing.pack(df.limit(0)).count() == 0


def _world(n=400, seed=0):
    rng = random.Random(seed)
    page = ["We answer within {} days, often sooner.", "Please open an issue if `x_{}` looks wrong.", "See also: reader, codec, entry {}.", "It was a marathon to write page {}.", "The demo user is called {}, which means nothing."]
    talk = ["Without a {} nobody can tell which {} came from the {}.", "Sort by {}, then by {} and {}.", "First the {}. Then the {}; the {} can wait."]
    lists = {s: [t.strip() for t in ts.split(",")][:20] for s, ts in lexicon.TERMS.items()}
    docs, truth = [], {}
    for i in range(n):
        about = set(rng.sample(sorted(lists), rng.randrange(3)))
        ps = [" ".join(rng.choice(page[:4]).format(rng.randrange(99)) for _ in range(3)) for _ in range(2)]
        if rng.random() < 0.3:
            ps[0] += " " + page[4].format(rng.choice(lists[rng.choice(sorted(lists))]))
        ps += [" ".join(rng.choice(talk).format(*rng.sample(lists[s], 3)) for _ in range(2)) for s in about]
        ps.append("```\ndef judge(attorney, plaintiff):\n\n    lawsuit.verdict(statute)\n```")
        rng.shuffle(ps)
        docs.append((i, "\n\n".join(ps)))
        truth[i] = about
    return docs, truth


def test_subjects_of_made_documents(spark):
    docs, truth = _world()
    docs += [(900, None), (901, ""), (902, "Sans récolte, le champ bétail reste vide. Chaque tracteur dépend d'un seul engrais."), (902, None), (None, "The judge heard the attorney and the plaintiff.")]
    truth |= {900: set(), 901: set(), 902: {"agriculture"}}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    names = spark.createDataFrame([(s,) for s in lexicon.TERMS] + [("unknown",), (None,)], "subject string")
    got: dict = {i: set() for i in truth}
    for r in subjects.document_subjects(df, names).collect():
        got[r["doc_id"]].add(r["subject"])
    hit = sum(len(got[i] & truth[i]) for i in truth)
    assert hit / sum(map(len, truth.values())) > 0.97 and hit / sum(map(len, got.values())) > 0.97
    assert {r["subject"] for r in subjects.document_subjects(df, names.where("subject = 'law'")).collect()} == {"law"}
    assert subjects.document_subjects(df.limit(0), names).count() == subjects.document_subjects(df, names.limit(0)).count() == 0


def test_paragraphs_leave_code_out():
    t = "# Judge and jury\n\nText one. Text two.\r\n\r\n```\ncode\n\nmore\n```\n\n> x = f(1);\n\n- item `judge` here\n"
    assert [s for _, s, _ in subjects.paragraphs(t)] == [["Text one.", "Text two."], ["- item   here"]] and subjects.paragraphs(t)[0][0] == "Judge and jury"
    assert subjects.paragraphs("") == []


def test_addresses_sections_and_sources_vote(spark):
    lex, model = subjects.Lexicon(), subjects.Model()
    assert subjects.paragraphs("See https://example.org/court/verdict.html or ask a@b.example now.")[0][1:] == (["See   or ask   now."], ["https://example.org/court/verdict.html", "a@b.example"])
    assert subjects.votes("See https://example.org/court-verdict/x now.", lex, model)[0]["law"] == 8
    assert subjects.votes("# The verdict\n\nA judge came.", lex, model)[0]["law"] == 4
    law, other = "The {} heard the attorney and the plaintiff near the statute.", "Nothing of note happened on day {}."
    docs = [(i, law.format("judge"), "courts/a") for i in range(40)] + [(100 + i, other.format(i), "mixed/b") for i in range(60)]
    docs += [(i, law.format("judge"), "mixed/b") for i in range(200, 203)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    names = spark.createDataFrame([("law",), ("music",)], "subject string")
    labels = spark.createDataFrame([(0, "law"), (1, "law"), (100, "music"), (None, "law"), (5, None)], "doc_id long, subject string")
    got = {r["doc_id"]: r["posterior"] for r in subjects.document_subjects(df, names, labels).collect()}
    assert set(got) == {*range(40), 200, 201, 202}
    assert {r["doc_id"] for r in subjects.document_subjects(df.drop("source"), names, labels.limit(0)).collect()} == set(got)


def test_accuracies_are_learned_not_given():
    n = subjects.Counter({0: 10_000, 3: 800, 1: 150, 2: 50, 4: 40})
    got = subjects.accuracies(n)
    assert got[0] < 0.05 and got[3] > 0.95 and got[1] < got[3] and subjects.accuracies(subjects.Counter())[3] > 0.9
    assert subjects.accuracies(n, [0.2, 0.0005, 0.01, 0.01, 0.01])[1] < subjects.accuracies(n, [0.0005, 0.2, 0.01, 0.01, 0.01])[1]
