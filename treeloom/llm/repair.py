"""Re-Pair grammars over the statements of a file."""

from __future__ import annotations

import heapq
import re
from collections import Counter

_WORD = re.compile(r"\w+")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_KEY_OR_WORD = re.compile(r'("(?:[^"\\\n]|\\.)*")(\s*:)?|\w+')
_CUT = re.compile(r"[\r\n]+")
_CUT_LONG = re.compile(r"(?<=[;{}])|(?<=,)(?=[\"'\[{])")


def statements(text: str) -> list[str]:
    """Lines without outer white space, over-long ones cut behind statement ends; the terminals of the grammar."""
    out = []
    for line in _CUT.split(text):
        line = line.strip()
        if len(line) > 160:
            out += [s.strip() for s in _CUT_LONG.split(line) if s.strip()]
        elif line:
            out.append(line)
    return out


def shape(statement: str, keys: bool = False) -> str:
    """A statement with strings and words (names, numbers, hex) blanked; ``keys`` keeps strings before a colon, as in JSON."""
    if keys:
        return _KEY_OR_WORD.sub(lambda m: m[0] if m[2] else "s" if m[1] else "w", statement)
    return _WORD.sub("w", _STRING.sub("s", statement))


def grammar(symbols: list[int], least: int = 2) -> tuple[list[int], dict[int, tuple[int, int]], Counter]:
    """(sequence, rules, uses): the most frequent pair becomes a new symbol until none stands ``least`` times without overlap.

    Pairs are counted without overlaps (``a a a`` holds ``a a`` once). The places of each pair are kept, so a replacement looks at
    its own places and their neighbours only, and the work is near the length of the sequence; ties fall to the pair met first.
    Places inside runs of one symbol may be lost on the way, so passes follow until one finds nothing.
    """
    seq, rules, uses = list(symbols), {}, Counter()
    new = max(seq, default=0) + 1
    while True:
        first = new
        seq, new = _pass(seq, new, least, rules, uses)
        if new == first:
            return seq, rules, uses


def _pass(seq: list[int], new: int, least: int, rules: dict[int, tuple[int, int]], uses: Counter) -> tuple[list[int], int]:
    n = len(seq)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    met: dict[tuple[int, int], int] = {}
    for i in range(n - 1):
        pair = seq[i], seq[i + 1]
        at = places.get(pair)
        if at is None:
            places[pair] = {i}
            met[pair] = len(met)
        elif pair[0] != pair[1] or i - 1 not in at:
            at.add(i)
    queue = [(-len(at), met[pair], pair) for pair, at in places.items() if len(at) >= least]
    heapq.heapify(queue)

    def add(pair: tuple[int, int], i: int) -> None:
        at = places.setdefault(pair, set())
        at.add(i)
        if len(at) >= least:
            heapq.heappush(queue, (-len(at), met.setdefault(pair, len(met)), pair))

    while queue:
        count, order, pair = heapq.heappop(queue)
        at = places.get(pair, ())
        if len(at) != -count:  # counted up or down since
            if least <= len(at) < -count:
                heapq.heappush(queue, (-len(at), order, pair))
            continue
        a, b = pair
        hits, free = [], -1
        for i in sorted(at):
            if i > free and seq[i] == a and after[i] < n and seq[after[i]] == b:
                hits.append(i)
                free = after[i]
        del places[pair]
        if len(hits) < least:
            continue
        rules[new], uses[new] = pair, len(hits)
        for i in hits:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0 and (seq[left], a) in places:
                places[seq[left], a].discard(left)
            if right < n and (b, seq[right]) in places:
                places[b, seq[right]].discard(j)
            seq[i], seq[j] = new, -1
            after[i] = right
            if right < n:
                before[right] = i
                add((new, seq[right]), i)
            if left >= 0 and not (seq[left] == new and before[left] in places.get((new, new), ())):
                add((seq[left], new), left)
        new += 1
    return [x for x in seq if x >= 0], new


def reuse(shapes: list[str]) -> float:
    """Share of a sequence that its Re-Pair grammar saves: 1 - (sequence + rules) / statements; 0 for under 8 statements."""
    if len(shapes) < 8:
        return 0.0
    ids: dict[str, int] = {}
    seq, rules, _ = grammar([ids.setdefault(s, len(ids)) for s in shapes])
    return max(0.0, 1 - (len(seq) + len(rules)) / len(shapes))


_COUNT = re.compile(r"^(\D*)(\d{1,9})(\D*)$")


def counters(statements_: list[str], shapes: list[str]) -> float:
    """Share of statements that count: of the shape of the one of that shape before, with a number, also inside a word, one higher."""
    if len(statements_) < 6:
        return 0.0
    hits = 0
    last: dict[str, list[str]] = {}
    for s, k in zip(statements_, shapes, strict=True):
        words = _WORD.findall(s)
        prev = last.get(k)
        if prev is not None and len(prev) == len(words):
            for a, b in zip(prev, words, strict=True):
                if a != b and (x := _COUNT.match(a)) and (y := _COUNT.match(b)) and x[1] == y[1] and x[3] == y[3] and int(y[2]) == int(x[2]) + 1:
                    hits += 1
                    break
        last[k] = words
    return hits / len(statements_)


_LITERAL = re.compile(r"[\[\](){},;\s]*(?:(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?(?:0[xX][\da-fA-F]+|\d[\d_.eE+-]*)|true|false|null|None|True|False)[\[\](){},;\s]*)+")


def literal(statement: str) -> bool:
    """Whether a statement holds only literal values, brackets and commas."""
    return _LITERAL.fullmatch(statement) is not None


_ITEM = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\[\](){},;\"']+")


def values(statements_: list[str]) -> list[str]:
    """The single values of literal statements, in order: the terminals of a grammar over data."""
    return [v for s in statements_ for v in _ITEM.findall(s)]
