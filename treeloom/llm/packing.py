"""Filling containers of fixed capacity with documents, by exact complements over counts of lengths.

What has to be decided depends on how many items of each length there are and not on which they are: at most ``capacity``
counts. The plan is made on these counts on the driver: the largest length left opens a container, whose gap is
filled exactly by one, two or three lengths where such a combination is in stock, else best-fit; a pattern is used as often
as its stock allows at once, so a plan has a few thousand patterns for any number of documents. Documents find their place by
their rank among documents of their length: ranks come from counts per task and length, so no task sees all of a length.
"""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.session import materialize

CAPACITY = 2_048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Stock:
    """Counts by length, with the lengths in stock as bits of one number and, mirrored, of another: sums are found by shifts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.top = capacity
        self.n = [0] * (capacity + 1)
        self.bits = self.mirror = 0
        for length, c in counts.items():
            self.add(length, c)

    def add(self, length: int, c: int) -> None:
        before = self.n[length]
        self.n[length] = before + c
        if (before == 0) != (before + c == 0):
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.top - length)

    def longest(self, limit: int) -> int:
        """The longest length in stock up to ``limit``, 0 if there is none."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (limit + 1)) - 1) else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths in stock that sum to ``gap``, the longest first."""
        both = self.bits & (self.mirror >> (self.top - gap)) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a < gap:
                return None
            if 2 * a > gap or self.n[a] > 1:
                return a, gap - a
            both ^= 1 << a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that sum to ``gap``, the longest first; None if there are none."""
        if self.n[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        a = self.longest(gap - 1)
        if 3 * a < gap:
            return None
        while 3 * a >= gap and a:
            self.add(a, -1)
            two = self.pair(gap - a)
            self.add(a, 1)
            if two:
                return a, *two
            a = self.longest(a - 1)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a container, number of such containers)] that uses up ``counts`` (length -> number, 1..capacity)."""
    stock = _Stock(counts, capacity)
    out = []
    while first := stock.longest(capacity):
        items, gap = [first], capacity - first
        stock.add(first, -1)
        while gap:
            take = stock.exact(gap)
            if take is None:
                best = stock.longest(gap)
                if not best:
                    break
                take = (best,)
            for x in take:
                stock.add(x, -1)
                gap -= x
            items += take
        uses = Counter(items)
        more = min(stock.n[x] // m for x, m in uses.items())
        if more:
            for x, m in uses.items():
                stock.add(x, -m * more)
        out.append((tuple(sorted(items, reverse=True)), more + 1))
    return out


def _sizes(docs: DataFrame, capacity: int, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, full, rest, task, rank): containers filled whole, tokens left over, and the rank of that length in its task."""
    shape = [("doc_id", pa.int64()), ("full", pa.int64()), ("rest", pa.int32()), ("task", pa.int32()), ("rank", pa.int64()), ("before", pa.int64())]

    def run(batches):
        enc = encoder(vocabulary, pattern)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        filled = 0
        for b in batches:
            ids, full, rest, rank, before = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(enc.encode_ordinary(t)) if t else 0
                k = (n - 1) // capacity if n else 0
                r = n - k * capacity
                ids.append(d)
                full.append(k)
                rest.append(r)
                rank.append(int(seen[r]))
                before.append(filled)
                seen[r] += 1
                filled += k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((ids, full, rest, [task] * len(ids), rank, before), shape, strict=True)], [n for n, _ in shape])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, full long, rest int, task int, rank long, before long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, piece, tokens, container_id, start): where each document, or each piece of one longer than ``capacity``, lies.

    A document of more tokens than a container fills as many whole containers as it can; what is left is an item like any other.
    Documents are never cut otherwise. Null and empty texts have one piece of 0 tokens, in container 0. Repeated rows are items
    of their own. Containers are numbered from 0 without gaps; start counts the tokens before the piece in its container.
    """
    spark = docs.sparkSession
    # The written table fixes each task's ranks: a task that is run again writes its own rows again.
    sizes = materialize(_sizes(docs, capacity, vocabulary, pattern), "token-sizes")
    per = sizes.groupBy("task", "rest").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in per.groupBy("rest").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
    whole = sizes.groupBy("task").agg(F.sum("full").alias("full"))
    empty = counts.pop(0, 0)
    patterns = plan(counts, capacity)
    keys, firsts, uses, bases, offsets = [], [], [], [], []
    taken: dict[int, int] = {}
    base = 0
    for items, times in patterns:
        start = 0
        for length in sorted(set(items), reverse=True):
            m = items.count(length)
            keys.append(length)
            firsts.append(taken.get(length, 0))
            uses.append(m)
            bases.append(base)
            offsets.append(start)
            taken[length] = firsts[-1] + m * times
            start += m * length
        base += times
    total = max(base, 1 if empty else 0)
    order = np.lexsort((np.array(firsts, np.int64), np.array(keys, np.int64)))
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, firsts, uses, bases, offsets)))
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift = per.select("task", "rest", F.coalesce(before, F.lit(0)).alias("_shift"))
    filled = F.sum("full").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shift_full = whole.select("task", F.coalesce(filled, F.lit(0)).alias("_full"))
    placed = sizes.join(shift, ["task", "rest"]).join(shift_full, "task")
    placed = placed.select("doc_id", "full", "rest", (F.col("rank") + F.col("_shift")).alias("rank"), (F.col("before") + F.col("_full") + total).alias("first_full"))
    out = [("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32()), ("container_id", pa.int64()), ("start", pa.int32())]

    def find(batches):
        key, first, use, base_, offset = table.value
        code = key * (1 << 44) + first
        for b in batches:
            doc, full, rest, rank, first_full = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            rest = rest.astype(np.int64)
            at = np.maximum(np.searchsorted(code, rest * (1 << 44) + rank, side="right") - 1, 0)
            if len(code):
                turn = rank - first[at]
                container = np.where(rest > 0, base_[at] + turn // use[at], 0)
                start = np.where(rest > 0, offset[at] + turn % use[at] * rest, 0)
            else:
                container = start = np.zeros(len(doc), np.int64)
            many = np.repeat(np.arange(len(doc)), full)
            step = np.arange(len(many)) - np.repeat(np.cumsum(full) - full, full)
            cols = (
                np.concatenate([doc, doc[many]]), np.concatenate([full, step]), np.concatenate([rest, np.full(len(many), capacity)]),
                np.concatenate([container, first_full[many] + step]), np.concatenate([start, np.zeros(len(many), np.int64)]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(cols, out, strict=True)], [n for n, _ in out])

    return placed.mapInArrow(find, "doc_id long, piece int, tokens int, container_id long, start int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least number that could do, tokens, and the share of room left unused."""
    c = packed.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    need = F.ceil(F.col("tokens") / capacity)
    return c.select("containers", need.cast("long").alias("least_containers"), "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"))
