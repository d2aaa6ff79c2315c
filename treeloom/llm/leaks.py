"""Evaluation texts leaking into training text: n-word windows of the held-out items looked up in every window of the corpus.

The item side is a table of distinct window hashes. While it is small (counted), it is broadcast to the scan, which is then
one pass without a shuffle: only words that occur in items can be part of a hit, so a text is cut into runs of known words
and only windows inside such runs are hashed. Beyond the bound the corpus windows are joined with it by hash. Hits are verified
word by word against the item's words, in either way, so hash collisions can't add a pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
#: Windows of items up to which the item side is broadcast (about 100 bytes each).
MAX_WINDOWS = 500_000

_WORD = re.compile(r"[^\W_]+")
_SPANS = "doc_id long, item_id long, start int, stop int"


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, stop) of normalised text: NFKC, no format characters, lower case; offsets are those of the normalised text."""
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(normal(text))]


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return text.lower()


def _index(items: list[tuple[int, str]], n: int):
    grams = defaultdict(set)
    vocab: dict[str, int] = {}
    for item, text in items:
        w = [vocab.setdefault(x, len(vocab) + 1) for x in _WORD.findall(normal(text or ""))]
        for i in range(len(w) - n + 1):
            grams[tuple(w[i : i + n])].add(item)
    return vocab, dict(grams)


def _hits(text: str, vocab: dict, grams: dict, n: int):
    """(item, first word, last word + 1) for each union of overlapping windows of one item."""
    low = normal(text)
    ids = [*map(vocab.get, _WORD.findall(low))]
    out: dict[int, list[list[int]]] = {}
    i, end = 0, len(ids)
    while i + n <= end:
        for back in range(n - 1, -1, -1):  # the last unknown word of the window is where the next can begin
            if ids[i + back] is None:
                i += back + 1
                break
        else:
            j = i + n
            while j <= end:
                for item in grams.get(tuple(ids[j - n : j]), ()):
                    spans = out.setdefault(item, [])
                    if spans and spans[-1][1] > j - n:
                        spans[-1][1] = j
                    else:
                        spans.append([j - n, j])
                if j == end or ids[j] is None:
                    break
                j += 1
            i = j + 1
    return low, out


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, start, stop): each stretch of a document made of ``n``-word windows that stand in the item; overlapping ones are one.

    start and stop are offsets in the normalised text. Null or empty texts and items of fewer than n words have no hits; items
    that share a passage each get their rows; repeated rows give repeated hits. Whole texts are scanned.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null and item_text is not null").select("item_id", "item_text")
    if (_counted_words(items).agg(F.sum("n")).first()[0] or 0) > MAX_WINDOWS:
        return _joined(docs, items, n)
    tables = spark.sparkContext.broadcast(_index([tuple(r) for r in items.toLocalIterator()], n))

    def scan(batches):
        vocab, grams = tables.value
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and d is not None:
                    low, found = _hits(t, vocab, grams, n)
                    if found:
                        at = [m.span() for m in _WORD.finditer(low)]
                        out += [(d, item, at[a][0], at[z - 1][1]) for item, spans in found.items() for a, z in spans]
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(scan, _SPANS)


def _counted_words(items: DataFrame) -> DataFrame:
    """Words of the items, counted as the index takes them; an item has no more windows than words."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(_WORD.findall(normal(t.as_py()))) for t in b.column(0))], pa.int64())], ["n"])

    return items.select("item_text").mapInArrow(run, "n long")


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "start", "stop"])


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same for an item side of any size: windows meet by hash in a shuffled join and are compared as text."""

    def windows(batches):
        for b in batches:
            ids, grams, starts, stops = [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(t) if t and d is not None else []
                for i in range(len(w) - n + 1):
                    ids.append(d)
                    grams.append(" ".join(x[0] for x in w[i : i + n]))
                    starts.append(w[i][1])
                    stops.append(w[i + n - 1][2])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["id", "gram", "start", "stop"])

    shape = "id long, gram string, start int, stop int"
    left = docs.select("doc_id", "text").mapInArrow(windows, shape).withColumn("h", F.xxhash64("gram"))
    right = items.mapInArrow(windows, shape).select(F.col("id").alias("item_id"), F.col("gram").alias("g"), F.xxhash64("gram").alias("k")).distinct()
    hit = left.join(right, (F.col("h") == F.col("k")) & (F.col("gram") == F.col("g"))).select(F.col("id").alias("doc_id"), "item_id", "start", "stop")
    from treeloom.llm.intervals import merge

    return merge(hit, ["doc_id", "item_id"])


def without_leaks(docs: DataFrame, spans: DataFrame, marker: str = " ") -> DataFrame:
    """The documents with their leaked stretches cut out, in normalised form where something was cut; all columns stay."""
    cuts = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("start", "stop")).alias("_cuts"))

    @F.pandas_udf("string")
    def remove(text, cuts_):
        import pandas as pd

        def one(t, cs):
            if t is None or cs is None or len(cs) == 0:
                return t
            t, out, at = normal(t), [], 0
            for c in sorted(cs, key=lambda c: c["start"]):
                if c["start"] >= at:
                    out.append(t[at : c["start"]])
                at = max(at, c["stop"])
            return marker.join([*out, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(text, cuts_, strict=True)])

    return docs.join(cuts, F.col("doc_id") == F.col("_doc"), "left").withColumn("text", remove("text", "_cuts")).drop("_doc", "_cuts")
