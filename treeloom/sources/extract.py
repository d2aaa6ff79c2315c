"""Symbols, imports and calls of source text, one pass per file.

Python is read by the interpreter's own parser; JavaScript, TypeScript and TSX by a scanner over tokens that follows brackets and
the few constructs that matter. A file that can't be read gives a row with its error instead of aborting, unless ``strict``.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.sources.languages import first_problem

LANGUAGES = ("python", "javascript", "typescript", "tsx")
_SYMBOL = pa.struct([("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent_name", pa.string())])
_IMPORT = pa.struct([("module", pa.string()), ("imported_name", pa.string()), ("alias", pa.string()), ("line", pa.int32())])
_CALL = pa.struct([("caller_name", pa.string()), ("callee_name", pa.string()), ("owner_name", pa.string()), ("line", pa.int32())])
SCHEMA = (
    "source_file_id string, symbols array<struct<ordinal:int,name:string,kind:string,start_line:int,end_line:int,parent_name:string>>, imports array<struct<module:string,imported_name:string,alias:string,line:int>>, "
    "calls array<struct<caller_name:string,callee_name:string,owner_name:string,line:int>>, error string, has_errors boolean"
)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_symbols(tree: ast.Module) -> list[tuple]:
    """(name, kind, first line, last line, parent) in source order, from bodies of modules, classes and functions only."""
    out: list[tuple] = []
    work = [(n, None, False) for n in reversed(tree.body)]
    while work:
        n, cls, in_class = work.pop()
        if isinstance(n, ast.ClassDef):
            out.append((n.name, "CLASS", n.lineno, n.end_lineno, cls))
            work += [(c, n.name, True) for c in reversed(n.body)]
        elif isinstance(n, _DEFS):
            out.append((n.name, "METHOD" if in_class else "FUNCTION", n.lineno, n.end_lineno, cls if in_class else None))
            work += [(c, cls, False) for c in reversed(n.body)]
    return out


def python_imports(tree: ast.Module) -> list[tuple]:
    """(module, name, alias, line) of imports anywhere, by line, module and name."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [(a.name, None, a.asname, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [("." * n.level + (n.module or ""), a.name, a.asname, n.lineno) for a in n.names]
    return sorted(out, key=lambda x: (x[3], x[0], x[1] or ""))


def _chain(n: ast.expr) -> str | None:
    """A dotted chain of plain names, else None."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join(reversed([*parts, n.id])) if isinstance(n, ast.Name) else None


def python_calls(tree: ast.Module) -> list[tuple]:
    """(caller, callee, owner, line): every call below every function; a nested function's calls count for each one around it."""
    out: list[tuple] = []

    def callee(f: ast.expr) -> tuple | None:
        if isinstance(f, ast.Name):
            return f.id, None
        return (f.attr, _chain(f.value)) if isinstance(f, ast.Attribute) else None

    work: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while work:
        n, around = work.pop()
        if isinstance(n, _DEFS):
            around = (*around, n.name)
        elif isinstance(n, ast.Call) and around and (c := callee(n.func)):
            out += [(a, *c, n.lineno) for a in around]
        work += [(c, around) for c in ast.iter_child_nodes(n)]
    return out


_TOKEN = re.compile(
    r"""(?P<NL>[\r\n]+)|[ \t\f\v]+|(?P<CO>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<ID>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<STR>"(?:[^"\\\r\n]|\\[\s\S])*"|'(?:[^'\\\r\n]|\\[\s\S])*')
    |(?P<TPL>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`)|(?P<NUM>\d[\w.]*)|(?P<OP>=>|\?\.|\.\.\.|[{}()\[\];,.:=<>?*]|.)""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*")
_NOT_CALLED = frozenset("if for while switch catch function return typeof new super import await async yield void delete in of instanceof do else case throw constructor".split()) - {"constructor"}
_EXPRESSION_BEFORE = frozenset(("=", "(", ",", ":", "?", "=>", "[", "return", "&", "|", "+", "new", "extends", "typeof", "!", "yield", "await", "throw", "in", "of"))


class _Script:
    """Tokens (text, kind, line, begins a line) with the partner of every bracket."""

    def __init__(self, text: str):
        self.t: list[tuple[str, str, int, bool]] = []
        self.pair: dict[int, int] = {}
        line, pos, fresh, stack = 1, 0, True, []
        size = len(text)
        while pos < size:
            m = _TOKEN.match(text, pos)
            kind = m.lastgroup
            word = m.group()
            if word[0] == "/" and kind == "OP":
                prev = self.t[-1] if self.t else ("", "", 0, True)
                if not (prev[1] in ("ID", "NUM", "STR", "TPL") and prev[0] not in _NOT_CALLED or prev[0] in (")", "]", "}")) and (r := _REGEX.match(text, pos)):
                    word, kind, m = r.group(), "STR", r
            pos = m.end()
            if kind == "NL":
                line += len(re.findall(r"\r\n|\r|\n", word))
                fresh = True
                continue
            if kind and kind != "CO":
                i = len(self.t)
                if kind == "OP" and word in "([{":
                    stack.append(i)
                elif kind == "OP" and word in ")]}" and stack:
                    a = stack.pop()
                    self.pair[a] = i
                    self.pair[i] = a
                self.t.append((word, kind, line, fresh))
                fresh = False
            if kind in ("CO", "TPL", "STR"):
                line += len(re.findall(r"\r\n|\r|\n", word))

    def word(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[min(i, len(self.t) - 1)][2] if self.t else 1

    def close(self, i: int) -> int:
        return self.pair.get(i, len(self.t) - 1)

    def angle(self, i: int) -> int:
        """Past type parameters that begin at i."""
        depth = 0
        while i < len(self.t):
            depth += (self.word(i) == "<") - (self.word(i) == ">")
            i += 1
            if depth == 0:
                break
        return i

    def body_after(self, i: int, stop: int) -> int:
        """The brace of a body after a parameter list, past a type; -1 if a statement ends first."""
        while i < stop:
            w = self.word(i)
            if w == "{":
                before = self.word(i - 1)
                if before in (":", "|", "&", "<", ","):
                    i = self.close(i) + 1
                    continue
                return i
            if w in (";", "}") or (w == "=" and self.word(i + 1) != ">"):
                return -1
            i = self.close(i) + 1 if w in ("(", "[") else i + 1
        return -1

    def arrow(self, i: int) -> int:
        """Position of the arrow of an arrow function that begins at i, else -1."""
        if self.word(i) == "async":
            i += 1
        if self.word(i) == "<":
            i = self.angle(i)
        if self.kind(i) == "ID":
            return i + 1 if self.word(i + 1) == "=>" else -1
        if self.word(i) != "(" or i not in self.pair:
            return -1
        i = self.close(i) + 1
        if self.word(i) == ":":
            i += 1
            while i < len(self.t) and self.word(i) not in ("=>", ";", "=", ")", "}"):
                i = self.close(i) + 1 if self.word(i) in ("(", "[", "{") else i + 1
        return i if self.word(i) == "=>" else -1

    def expression_end(self, i: int, stop: int) -> int:
        """Last token of an expression that begins at i."""
        last = i
        while i < stop:
            w, _, _, fresh = self.t[i]
            if w in (";", ",", ")", "]", "}") or (fresh and i > last and self.word(i - 1) not in ("=>", "=", "+", "-", "?", ":", "(", "|", "&", ".") and w not in (".", "?", ":", "?.", "+", "-", "&", "|", "*")):
                break
            last = self.close(i) if w in ("(", "[", "{") else i
            i = last + 1
        return last


def script(text: str, typed: bool) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(symbols, imports, calls) of a script; interfaces only at the top level of typed ones."""
    s = _Script(text.removeprefix("﻿"))
    symbols: list[tuple] = []
    imports: list[tuple] = []
    calls: list[tuple] = []
    # (from, to, class around, function around, whether inside a class body or object, whether at the top)
    work = [(0, len(s.t), None, None, "top")]
    while work:
        i, stop, cls, caller, where = work.pop()
        in_var = False
        while i < stop:
            w, k, line, fresh = s.t[i]
            before = s.word(i - 1) if i else ""
            if where == "class" and k in ("ID", "STR", "NUM", "OP") and w not in (";", "}"):
                first = i
                while w.startswith("@") and len(w) > 1:
                    i = s.close(i + 1) + 1 if s.word(i + 1) == "(" else i + 1
                    w = s.word(i)
                name = i
                while name < stop and (s.kind(name) == "ID" or s.word(name) == "*") and (s.kind(name + 1) in ("ID", "STR", "NUM") or s.word(name + 1) in ("*", "[")) and not s.t[min(name + 1, len(s.t) - 1)][3]:
                    name += 1
                after = s.close(name) + 1 if s.word(name) == "[" else name + 1
                if s.word(after) in ("?", "!"):
                    after += 1
                params = s.angle(after) if s.word(after) == "<" else after
                if s.word(params) == "(" and s.word(name) != "{":
                    end = s.close(params)
                    body = s.body_after(end + 1, stop)
                    if body >= 0:
                        symbols.append((s.word(name), "METHOD", s.line(first), s.line(s.close(body)), cls))
                        work.append((body + 1, s.close(body), cls, caller, "body"))
                        work.append((params + 1, end, cls, caller, "body"))
                        i = s.close(body) + 1
                        continue
                    i = end + 1
                    continue
                if s.word(name) == "{":
                    work.append((name + 1, s.close(name), cls, caller, "body"))
                    i = s.close(name) + 1
                    continue
                end = after
                while end < stop and s.word(end) not in (";", "=") and not s.t[end][3]:
                    end = s.close(end) + 1 if s.word(end) in ("(", "[", "{") else end + 1
                if s.word(end) == "=" and end < stop:
                    last = s.expression_end(end + 1, stop)
                    work.append((end + 1, last + 1, cls, caller, "body"))
                    end = last + 1
                i = max(end, i + 1)
                continue
            if k != "ID":
                if w in (";", "}") or (w == "{" and before != "="):
                    in_var = False
                if w == "," and in_var and s.kind(i + 1) == "ID" and s.word(i + 2) in ("=", ":"):
                    i += 1
                    w, k, line, fresh = s.t[i]
                    before = "var"
                else:
                    i += 1
                    continue
            dotted = before in (".", "?.")
            if w == "import" and where == "top" and not dotted and s.word(i + 1) not in ("(", "."):
                i = _import(s, i, imports)
                continue
            if w == "class" and not dotted:
                named = s.kind(i + 1) == "ID" and s.word(i + 1) not in ("extends", "implements")
                declared = named and before not in _EXPRESSION_BEFORE
                j = i + 1
                while j < len(s.t) and s.word(j) != "{":
                    j = s.close(j) + 1 if s.word(j) in ("(", "[") else j + 1
                if declared:
                    symbols.append((s.word(i + 1), "CLASS", line, s.line(s.close(j)), None))
                work.append((j + 1, s.close(j), s.word(i + 1) if declared else cls, caller, "class"))
                i = s.close(j) + 1
                continue
            if w == "interface" and typed and where == "top" and before != "export" and s.kind(i + 1) == "ID":
                j = i + 1
                while j < len(s.t) and s.word(j) != "{":
                    j += 1
                symbols.append((s.word(i + 1), "INTERFACE", line, s.line(s.close(j)), None))
                i = s.close(j) + 1
                continue
            if w == "function" and not dotted:
                start = i - 1 if before == "async" else i
                named = s.kind(i + 1) == "ID"
                declared = named and s.word(start - 1 if start else -1) not in _EXPRESSION_BEFORE
                j = i + 1
                while j < len(s.t) and s.word(j) != "(":
                    j += 1
                body = s.body_after(s.close(j) + 1, len(s.t))
                if body < 0:
                    i = s.close(j) + 1
                    continue
                inner = s.word(i + 1) if declared else caller
                if declared:
                    symbols.append((inner, "FUNCTION", s.line(start), s.line(s.close(body)), None))
                work.append((j + 1, s.close(j), cls, inner, "body"))
                work.append((body + 1, s.close(body), cls, inner, "body"))
                i = s.close(body) + 1
                continue
            if w in ("const", "let", "var") and not dotted:
                in_var = True
            elif before in ("const", "let", "var") or (before == "var" and in_var):
                eq = i + 1
                if s.word(eq) == ":":
                    eq += 1
                    while eq < stop and s.word(eq) not in ("=", ";", ","):
                        eq = s.close(eq) + 1 if s.word(eq) in ("(", "[", "{") else (eq + 2 if s.word(eq) == "=>" else eq + 1)
                at = s.arrow(eq + 1) if s.word(eq) == "=" else -1
                if at >= 0:
                    last = s.close(at + 1) if s.word(at + 1) == "{" else s.expression_end(at + 1, stop)
                    symbols.append((w, "FUNCTION", line, s.line(last), None))
                    work.append((eq + 1, last + 1, cls, w, "body"))
                    i = last + 1
                    continue
            elif w not in _NOT_CALLED and s.word(i + 1) in ("(", "?.") and (s.word(i + 1) == "(" or s.word(i + 2) == "(") and before not in ("function", "new", "get", "set"):
                body = s.close(i + 1) + 1 if s.word(i + 1) == "(" else i
                if s.word(body) == "{" and before in ("{", ",", "async"):
                    symbols.append((w, "METHOD", line, s.line(s.close(body)), cls))
                elif caller:
                    root = i
                    while s.word(root - 1) in (".", "?.") and root >= 2:
                        root -= 2
                        while s.word(root) in (")", "]") and root in s.pair:
                            root = s.pair[root] - 1
                    if s.word(root - 1) != "new":
                        calls.append((caller, w, None, s.line(root)))
            i += 1
    symbols.sort(key=lambda x: (x[2], x[3], x[0]))
    return symbols, imports, sorted(calls, key=lambda c: c[3])


def _import(s: _Script, i: int, out: list[tuple]) -> int:
    """Read an import statement at i, add its rows, and give the position after it."""
    line, j = s.line(i), i + 1
    names: list[tuple] = []
    if s.word(j) == "type" and s.word(j + 1) not in ("from", ",", "="):
        j += 1
    while j < len(s.t) and s.kind(j) != "STR" and s.word(j) != ";":
        w = s.word(j)
        if w == "*":
            names.append(("*", s.word(j + 2)))
            j += 3
        elif w == "{":
            end = s.close(j)
            k = j + 1
            while k < end:
                if s.word(k) == "type" and s.kind(k + 1) == "ID" and s.word(k + 1) != "as":
                    k += 1
                alias = s.word(k + 2) if s.word(k + 1) == "as" else None
                names.append((s.word(k).strip("\"'"), alias))
                k += 3 if alias else 1
                k += s.word(k) == ","
            j = end + 1
        elif s.kind(j) == "ID" and w != "from":
            names.append(("default", w))
            j += 1
        else:
            j += 1
    if s.kind(j) == "STR":
        module = s.word(j).strip("\"'")
        out += [(module, n, a, line) for n, a in names or [(None, None)]]
        j += 1
    return j


def read(text: str, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(symbols, imports, calls) of a text in one of ``LANGUAGES``; a Python text that doesn't parse raises SyntaxError."""
    if language == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
        return python_symbols(tree), python_imports(tree), python_calls(tree)
    return script(text, language != "javascript")


def extract(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row per file (source_file_id, symbols, imports, calls, error, has_errors) from (source_file_id, language, content).

    has_errors says that the language's grammar rejects the text; what can be made out of a script is given all the same.

    Files of other languages give no row. Null content, bytes that are no UTF-8 and Python that doesn't parse give an error and
    empty lists, or raise when ``strict``. Files are independent rows, so any number of them spreads over the tasks.
    """

    def run(batches):
        for b in batches:
            rows = []
            for lang, content in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    data = content.as_py()
                    if data is None:
                        raise ValueError("no content")
                    text = data.decode("utf-8")
                    rows.append((*read(text, lang), None, lang != "python" and first_problem(lang, text.removeprefix("\ufeff")) is not None))
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    if strict:
                        raise
                    rows.append(([], [], [], f"{type(e).__name__}: {e}"[:200], isinstance(e, SyntaxError)))
            names = [[f.name for f in t] for t in (_SYMBOL, _IMPORT, _CALL)]
            syms = [[dict(zip(names[0], (i, *x), strict=True)) for i, x in enumerate(r[0])] for r in rows]
            imps = [[dict(zip(names[1], x, strict=True)) for x in r[1]] for r in rows]
            calls = [[dict(zip(names[2], x, strict=True)) for x in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(syms, pa.list_(_SYMBOL)), pa.array(imps, pa.list_(_IMPORT)), pa.array(calls, pa.list_(_CALL)), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.bool_())],
                ["source_file_id", "symbols", "imports", "calls", "error", "has_errors"],
            )

    return files.where(F.col("language").isin(*LANGUAGES)).select("source_file_id", "language", "content").mapInArrow(run, SCHEMA)


def rows_of(extracted: DataFrame, what: str) -> DataFrame:
    """The rows of one of the lists, with the file's id."""
    return extracted.select("source_file_id", F.explode(what).alias("_r")).select("source_file_id", "_r.*")
