import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import intervals, leaks, neighbours, rolling, spans, winners


def _shared(records, length):
    seen = defaultdict(set)
    for k, t in records:
        for a in range(len(t or "") - length + 1):
            seen[t[a : a + length]].add(k)
    out = defaultdict(set)
    for k, t in records:
        for a in range(len(t or "") - length + 1):
            if len(seen[t[a : a + length]]) > 1:
                out[k] |= set(range(a, a + length))
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ñ🚚"])
def test_shared_spans_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = text(90)
    rows = [(f"k{i}", text(rng.randrange(60)) + (common[rng.randrange(40) : 50 + rng.randrange(40)] if i % 3 else "") + text(rng.randrange(60))) for i in range(60)]
    rows += [("twin1", common), ("twin2", common), ("twin2", common), ("periodic", "ab" * 80), ("other", "x" + "ab" * 70), ("empty", ""), ("null", None), ("long", common + text(30_000))]
    df = spark.createDataFrame(rows, "key string, text string").withColumns({"gram": F.lit("clash"), "cid": F.lit(1)})
    got = {r["key"]: r["shared_chars"] for r in (spans.shared_spans(df, 30, 8).groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).cast("int").alias("shared_chars"))).collect()}
    assert got == _shared(rows, 30)


def test_shared_spans_of_little(spark):
    df = spark.createDataFrame([("a", "x" * 50), ("a", "x" * 50)], "key string, text string")
    assert spans.shared_chars(df, 40).count() == 0
    assert spans.shared_chars(df.limit(0), 200).count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, 10, 20)


def test_rolling_helpers():
    x = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert rolling.sliding_min(x, 3).tolist() == [3, 1, 1, 1]
    points, row, starts = rolling.code_points(["ab", "", "🚚c"])
    assert row.tolist() == [0, 0, 2, 2] and starts.tolist() == [0, 2, 2, 4]
    h = rolling.Hasher(np.frombuffer("abcabc".encode("utf-32-le"), np.uint32), wide=True)
    assert h.at(np.array([0]), np.array([3])) == h.at(np.array([3]), np.array([6])) != h.at(np.array([1]), np.array([4]))


def test_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("a", 11, 12), ("b", 1, 2), ("a", 0, 5)], "k string, start int, stop int")
    assert sorted(tuple(r) for r in intervals.merge(df, ["k"]).collect()) == [("a", 0, 9), ("a", 11, 12), ("b", 1, 2)]


def test_holding_rows(spark):
    u = "0a0bbd54-d675-51f6-a55c-e543e5e1e309"
    df = spark.createDataFrame([(u, 1, 1), (u.upper(), 2, 2), ("b", 3, None), ("b", 4, 1), (None, 5, 1)], "id string, v int, t int").withColumn("recorded_at", F.timestamp_seconds("t"))
    assert {(r["_key"], r["v"]) for r in winners.holding_rows(df, "id").collect()} == {(u, 2), ("b", 4)}


def test_equal_halves_of_hashes_share_nothing(spark):
    rows = [(1, 1, 10), (1, 2, 11), (2, 1, 12), (3, 3, 13), (3, 3, 14), (4, 4, 15), (4, 4, 15)]
    df = spark.createDataFrame(rows, "h long, h2 int, cid long")
    assert {tuple(r) for r in spans.in_several(df, ["h", "h2"]).collect()} == {(3, 3)}
    points, _, _ = rolling.code_points(["abcdefgh" * 50, "abcdefgh" * 49 + "abcdefgx"])
    a, b = rolling.Hasher(points, wide=True).pair(np.array([0, 400, 8, 1]), np.array([200, 600, 208, 201]))
    assert a[0] == a[1] == a[2] != a[3] and b[0] == b[1] == b[2] != b[3] and (a != b).all()


def _nearest(rows, k):
    out = set()
    good = [(g, i, np.array(v, float)) for g, i, v in {r[:2]: r for r in rows}.values() if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for g, i, v in good:
        sims = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), j) for h, j, w in good if h == g and j != i)
        out |= {(i, j) for _, j in sims[:k]}
    return out


def _rows(n, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, 8))
    rows = [("g1" if i % 4 else "g2", f"v{i:04}", [float(np.float32(x)) for x in centre[i % len(centre)] + 0.4 * rng.normal(size=8)]) for i in range(n)]
    return rows


def test_neighbours_equal_brute_force(spark):
    rows = _rows(300) + [("g1", "null", None), ("g1", "zero", [0.0] * 8), ("g1", "short", [1.0]), ("g1", "nan", [float("nan")] * 8), ("g1", "inf", [float("inf")] + [1.0] * 7), ("g1", "hole", [None] + [1.0] * 7), ("g3", "alone", [1.0] * 8), ("g1", "twice", [2.0] * 8), ("g1", "twice", [2.0] * 8)]
    rows += [("g2", f"copy{i:02}", [1.0, 2.0] * 4) for i in range(40)] + [("g2", "scaled", [2.0, 4.0] * 4)]
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>").withColumn("region", F.lit("clash"))
    got = {(r["id"], r["near_id"]) for r in neighbours.nearest(df, 5, 8).collect()}
    assert got == _nearest(rows, 5)
    assert neighbours.pairs(neighbours.nearest(df.limit(0), 5, 8)).count() == 0
    assert neighbours.nearest(df.where("grp = 'g3'"), 5, 8).count() == 0


def test_neighbours_over_regions_keep_recall(spark):
    rows = _rows(2_400, seed=4)
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>")
    got = {(r["id"], r["near_id"]) for r in neighbours.nearest(df, 5, 8, region_rows=400).collect()}
    want = _nearest(rows, 5)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_one_dense_region_is_cut_into_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [("g", f"d{i:04}", [1.0 + 0.01 * float(x) for x in rng.normal(size=8)]) for i in range(700)] + [("g", f"s{i:03}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>")
    got = {(r["id"], r["near_id"]) for r in neighbours.nearest(df, 5, 8, region_rows=50, probes=40).collect()}
    rows = [(r["grp"], r["id"], r["v"]) for r in df.collect()]
    assert len(got & _nearest(rows, 5)) / len(got) > 0.99 and len(got) == 5 * len(rows)


def test_levels_of_cells_in_64_dimensions(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 64))
    rows = [("g", f"d{i:04}", [float(x) for x in middle[i % 40] + 0.6 * rng.normal(size=64)]) for i in range(2000)]
    rows += [("h", f"e{i:02}", [float(x) for x in rng.normal(size=64)]) for i in range(30)] + [("g", "gap", [1.0] * 63 + [None])]
    df = spark.createDataFrame(rows, "grp string, id string, v array<float>").withColumn("part", F.lit("clash"))
    got = {(r["id"], r["near_id"]) for r in neighbours.nearest(df, 5, 64, region_rows=50, fan=8).collect()}  # 80 regions in two levels
    want = set()
    for g in "gh":
        ids, x = zip(*[(i, v) for h, i, v in rows if h == g and i != "gap"], strict=True)
        x = np.array(x, np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        sims = np.round(x @ x.T - 9 * np.eye(len(x)), 12)
        want |= {(ids[i], ids[j]) for i in range(len(x)) for j in np.argsort(-sims[i], kind="stable")[:5]}
    assert len(got & want) / len(want) > 0.9 and len(got) == len(want)


def test_centres_are_fitted_in_blocks():
    x = np.random.default_rng(1).normal(size=(9_000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = neighbours.fit_centres(x, 30)
    near = neighbours._nearest_centre(x, c, 3)
    assert (near[:, 0] == (x @ c.T).argmax(1)).all() and near.shape == (9_000, 3) and neighbours._nearest_centre(x, c[:2], 5).shape == (9_000, 2)


def test_anisotropic_codes_keep_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    err = []
    for weight in (1.0, 4.0):
        books = neighbours.fit_codebooks(x, weight=weight)
        y = neighbours.decode(neighbours.encode(x, books, weight), books)
        err.append(np.abs(np.einsum("ij,ij->i", x - y, x)).mean())
    assert err[1] < err[0]


def _words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf").lower()
    import re

    return re.findall(r"[^\W_]+", t)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen."), (2, "zero One two three four five six seven eight nine ten eleven twelve end"), (3, "too short"), (4, None)]
DOCS = [
    (1, "x one_two three-four\nFIVE six seven  eight nine ten eleven twelve y"), (2, "one two three four five six seven eight nine ten eleven"), (3, "Ｏｎｅ ｔｗｏ three four fi\u00adve six seven eight nine ten eleven twelve thirteen"),
    (4, None), (5, ""), (6, "unknown words " * 4000 + ITEMS[0][1] * 3), (1, "x one two three four five six seven eight nine ten eleven twelve y"),
]


def test_words_of_items_are_counted_as_they_are_indexed(spark):
    items = spark.createDataFrame([("a.b.c(d) e_f",), ("",)], "item_text string")
    assert leaks._counted_words(items).agg(F.sum("n")).first()[0] == 6


@pytest.mark.parametrize("limit", [500_000, 0])
def test_leaks(spark, limit, monkeypatch):
    monkeypatch.setattr(leaks, "MAX_WINDOWS", limit)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, item_text string")
    windows = lambda t: {tuple(w[a : a + 12]) for w in [_words(t)] for a in range(len(w) - 11)}
    grams = {i: windows(t) for i, t in ITEMS if t}
    want = {(d, i) for d, t in DOCS if t for w in [windows(t)] for i, g in grams.items() if w & g}
    s = leaks.leaked_spans(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in s.collect()} == want
    six = s.where("doc_id = 6 and item_id = 1").collect()
    norm = leaks.normal(DOCS[5][1])
    assert all(_words(norm[r["start"] : r["stop"]])[:12] == _words(ITEMS[0][1])[:12] for r in six) and len(six) == 3
    clean = {r["doc_id"]: r["text"] for r in leaks.without_leaks(docs.drop("item_id").where("doc_id in (2, 3, 4)"), s).collect()}
    assert clean[2] == DOCS[1][1] and clean[4] is None and clean[3].strip() == ""
    assert leaks.leaked_spans(docs, items.limit(0)).count() == leaks.leaked_spans(docs.limit(0), items).count() == 0
