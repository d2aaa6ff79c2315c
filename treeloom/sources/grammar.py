"""Predictive table parsing: grammars as text, compiled to a table of productions by next token."""

from __future__ import annotations

import re

END = "$end"


def compile_grammar(text: str, start: str) -> dict:
    """The start symbol's row of the LL(1) table.

    A rule is ``Name = a b | c |``: words with a rule of their own are symbols, all others token kinds; an empty
    alternative stands for nothing. Where two alternatives begin alike, the earlier wins; a token that begins no alternative
    takes the one that can be empty, so that errors show at the next token that must match.
    """
    rules: dict[str, list[list[str]]] = {}
    for line in text.strip().splitlines():
        if line.strip():
            name, _, body = line.partition(" = ")
            body = body.strip()
            alts = [[], []] if body == "|" else [alt.split() for alt in re.split(r" \|(?: |$)", f"{body} " if body.endswith("|") else body)]
            rules[name.strip()] = alts
    first: dict[str, set] = {n: set() for n in rules}
    empty: set[str] = set()
    grown = True
    while grown:
        grown = False
        for n, alts in rules.items():
            for alt in alts:
                size = len(first[n]), len(empty)
                for s in alt:
                    first[n] |= first[s] if s in rules else {s}
                    if s not in empty:
                        break
                else:
                    empty.add(n)
                grown |= size != (len(first[n]), len(empty))
    rows: dict[str, dict] = {n: {} for n in rules}
    for n, alts in rules.items():
        for alt in alts:
            heads: set[str] = set()
            for s in alt:
                heads |= first[s] if s in rules else {s}
                if s not in empty:
                    break
            else:
                rows[n].setdefault(0, tuple(rows.get(s, s) for s in reversed(alt)))
            for h in heads:
                rows[n].setdefault(h, tuple(rows.get(s, s) for s in reversed(alt)))
    for row in rows.values():
        if "SEMI" in row:
            row.setdefault(";", row["SEMI"])
            row.setdefault(0, row["SEMI"])
    return rows[start]


def first_error(start: dict, kinds: list[str], fresh: list[bool] | None = None) -> int:
    """Index of the first token that fits no continuation, -1 if the sequence is a sentence.

    ``SEMI`` matches ``;``, or nothing before ``}``, at the end, or before a token that begins a line (``fresh``).
    """
    stack: list = [END, start]
    pop, extend = stack.pop, stack.extend
    for i, tok in enumerate([*kinds, END]):
        while True:
            top = pop()
            if top.__class__ is str:
                if top == tok:
                    break
                if top == "SEMI":
                    if tok == ";":
                        break
                    if tok == "}" or tok == END or (fresh is not None and fresh[i]):
                        continue
                return i
            rhs = top.get(tok)
            if rhs is None:
                rhs = top.get(0)
                if rhs is None:
                    return i
            if rhs:
                extend(rhs)
    return -1
