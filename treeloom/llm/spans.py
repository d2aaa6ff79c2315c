"""Long exact spans shared between records, by compact windows.

Every window of ``length`` code points is represented by the k-gram of least hash in it; runs of windows with one such gram are
compact windows. Equal windows have equal least grams, so a window shared by two records lies in compact windows of one gram
hash: the collision is certain and a single hash function suffices. From there
1. grams that occur in one record only are dropped (most of the corpus), by a count that is combined before the shuffle;
2. where all compact windows of a gram are the same stretch of text, all of them are shared as they stand;
3. elsewhere every window inside them is hashed and counted over records.
Texts are told apart by 96 bits of two independent hashes: among 10^13 different windows any two are alike with a chance of one in
a thousand. Two records of one stretch are told apart by 64 bits, which fails for one pair in 10^19; whose a stretch is, by 96. A
gram's 64 bits only gather candidates. All steps are linear in the text and never pair the records of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.intervals import merge
from treeloom.llm.rolling import Hasher, code_points, compact_windows, slices
from treeloom.session import materialize

LENGTH, GRAM = 200, 32


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _low(x: np.ndarray) -> np.ndarray:
    """The low halves of 64-bit words."""
    return x.astype(np.uint32).view(np.int32)


def compact_rows(records: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(key, gram, span, span2, lo, hi) for every compact window of ``records`` (key, text); lo and hi are first and last window start."""
    shape = [("key", pa.string()), ("gram", pa.int64()), ("span", pa.int64()), ("span2", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]

    def run(batches):
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            texts = [t or "" for t in texts]
            for a, z in slices(texts):
                points, row, starts = code_points(texts[a:z])
                lo, hi, _, gram, hasher = compact_windows(points, row, length, k)
                if len(lo):
                    span, span2 = Hasher(points, wide=True).pair(lo, hi + length)
                    off = starts[row[lo]]
                    yield _batch(shape, [keys.take(pa.array(a + row[lo])), gram.view(np.int64), span.view(np.int64), _low(span2), (lo - off).astype(np.int32), (hi - off).astype(np.int32)])

    return records.select("key", "text").mapInArrow(run, "key string, gram long, span long, span2 int, lo int, hi int")


def _windows(mixed: DataFrame, length: int) -> DataFrame:
    """(h, h2, cid, cid2, start) of every window of rows (cid, cid2, text, ranges)."""
    shape = [("h", pa.int64()), ("h2", pa.int32()), ("cid", pa.int64()), ("cid2", pa.int32()), ("start", pa.int32())]

    def run(batches):
        for b in batches:
            cid, cid2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts, ranges = b.column(2).to_pylist(), b.column(3)
            flat, offsets = ranges.flatten(), ranges.offsets.to_numpy()
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            offsets = offsets - offsets[0]
            for a, z in slices(texts):
                points, _, starts = code_points(texts[a:z])
                part = slice(offsets[a], offsets[z])
                rows = np.repeat(np.arange(a, z), np.diff(offsets[a : z + 1]))
                first, n = lo[part].astype(np.int64), (hi[part] - lo[part] + 1).astype(np.int64)
                row = np.repeat(rows, n)
                start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                at = start + starts[row - a]
                h, h2 = Hasher(points, wide=True).pair(at, at + length)
                yield _batch(shape, [h.view(np.int64), _low(h2), cid[row], cid2[row], start.astype(np.int32)])

    return mixed.select("cid", "cid2", "text", "ranges").mapInArrow(run, "h long, h2 int, cid long, cid2 int, start int")


def in_several(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The values of ``by`` that rows of two records (cid) or more have; with further aggregates ``more``."""
    g = rows.groupBy(*by).agg(F.min("cid").alias("_a"), F.max("cid").alias("_b"), *more)
    return g.where("_a <> _b").drop("_a", "_b")


def shared_spans(records: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(key, start, stop): the maximal stretches of each record made of windows of ``length`` code points that also stand,
    character for character, in a record of another key; disjoint, offsets in code points.

    Null and short texts have none; rows of one key never match each other, and their stretches are united. Records of equal
    text are shared whole. Whole texts are read; a window of any frequency is found.
    """
    if k > length:
        raise ValueError("the gram can't be longer than the window")
    cid, cid2 = F.xxhash64("key"), F.hash("key")
    rows = materialize(compact_rows(records, length, k).withColumns({"cid": cid, "cid2": cid2}), "spans")
    ends = [f(c).alias(f"{n}_{c}") for c in ("span", "span2") for n, f in (("low", F.min), ("high", F.max))]
    s = in_several(rows, ["gram"], *ends)
    s = s.select("gram", ((F.col("low_span") == F.col("high_span")) & (F.col("low_span2") == F.col("high_span2"))).alias("uniform"))
    cand = materialize(rows.join(s, "gram").select("key", "cid", "cid2", "lo", "hi", "uniform").distinct(), "spans-candidates")
    whole = cand.where("uniform").select("key", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    mixed = cand.where("not uniform")
    ranges = mixed.groupBy("key", "cid", "cid2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    text = records.select(F.col("key").alias("_key"), "text")
    win = _windows(ranges.join(text, F.col("key") == F.col("_key")).where("text is not null"), length)
    win = materialize(win, "spans-windows")
    found = win.join(in_several(win, ["h", "h2"]), ["h", "h2"], "left_semi").select("cid", "cid2", F.col("start"), (F.col("start") + length).alias("stop"))
    found = merge(found, ["cid", "cid2"]).join(mixed.select("cid", "cid2", "key").distinct(), ["cid", "cid2"]).select("key", "start", "stop")
    return merge(whole.unionByName(found), ["key"])


def shared_chars(records: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, shared_chars) of each record with a shared span."""
    return shared_spans(records, length).groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).cast("int").alias("shared_chars"))
