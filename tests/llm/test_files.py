import random

import pytest
from pyspark.sql import functions as F

from treeloom.llm import handwritten, repair, syntax
from treeloom.sources import grammar
from treeloom.sources.languages import first_problem

JS_OK = [
    "", "﻿// only a comment\n", "import a, { b as c } from './x';\nexport default class A extends B { #p = 1; static async *m(x = {}, ...r) { return await x?.y ?? r[0]; } get v() { return this.#p } }",
    "const f = async (a, { b }, [c]) => ({ ...a, b, c() { return 1 }, ['k']: `t${a}` })\nlet x = a\n  .b(c)\nx++\nfor (const k of xs) if (k) continue; else break\n", "if (a) { l() }function w(x){return x.y(1)}var q=a?b:c;/*! c */\n//# map",
    "x.replace(/[({]a\\d{3}/g, y).z();\nlabel: for (;;) { break label }\nswitch (a) { case 1: f(); default: g() }\ntry { a } catch { b } finally { c }\nnew Foo(a).b`x`\ndo x(); while (y)\nreturn_ = a / b / c",
    "/*\n<<<<<<< HEAD\n=======\n>>>>>>> x\n*/\nvar s = '<<<<<<<';\n",
]
JS_BAD = ["function (", "var x = ;", "class A { m( { } }", "a b", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "function f(a: number) {}", "interface A { x: string }", "package a.b;\npublic class C { void m() {} }", "import os\ndef f(): pass", "var s = 'open", "<!DOCTYPE html>", ".a { b: c }", "x = `open", "if (a) {"]
TS_OK = [
    "interface A<T> extends B<T> { x: number; y?: string; f(a: T): void; readonly [k: string]: any }\ntype U = 'a' | 1 | (x: number) => Map<string, Array<number>>;\nenum E { A = 1, B }\ndeclare const z: typeof x;",
    "class C<T> implements A<T> { private x: number = 3; constructor(public a: string, b?: T) { super() } abstract m(): void; get v(): T { return <T>this.x as T } }",
    "function f<T extends object>(a: Array<T>, ...r: string[]): Promise<T | null> { return g<T>(a)!; }\nconst h = (a: number, b = 2): number => a < b ? a : b;\nexport type { Q } from './q';\nnew Map<string, number>();\nlet v: { a: number }[] = [];",
]
JAVA_OK = ["package a.b;\nimport static x.Y.*;\n@A(b = 1) public final class C<T extends D> extends E<T> implements F, G {\n private static final int[] X = {1, 2}, Y = new int[3];\n C(int a) { this.x = a; }\n public <T> List<Map<String, T>> m(final int a, String... r) throws Z { for (int i = 0; i < a; i++) { o.f(i); } for (String s : r) s.length(); List<String> l = new ArrayList<>(); return (a > 1) ? l : null; }\n enum K { A(1), B; int v; }\n interface I { default void q() {} }\n}\n"]
GO_OK = ["package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\ntype I interface {\n\tF(x int) (string, error)\n}\n\nfunc (t *T) F(x int) (s string, err error) {\n\tif v, ok := m[x]; ok && v > 1 {\n\t\treturn fmt.Sprint(v), nil\n\t} else if x == 2 {\n\t}\n\tfor _, q := range xs.Y(1) {\n\t\tgo func() { c <- q }()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tswitch x {\n\tcase 1, 2:\n\t\tbreak\n\tdefault:\n\t}\n\ta := []int{1, 2}\n\tb := map[string]T{\"a\": {A: 1}}\n\tdefer f(a[1:], b)\n\treturn\n}\n"]
CSS_OK = ["@charset \"x\";\n@media (min-width: 3px) { .a:hover > b, #c[d=\"e\"] { color: #fff; margin: 0 auto } }\n.x{margin:0px}/* c */a{}\n:root { --v: 1px; width: calc(1px + var(--v)) !important; background: url(x.png) }"]
BAD = {
    "java": ["class A { void m() { }", "public class { }", "package a\nfunc F() {}", "class A { int x = ; }", "<html></html>"], "go": ["package a\nfunc F( {\n}\n", "import os\n", "package a\nfunc F() {\n<<<<<<< HEAD\n}\n", "package a\nfunc F() {\n\tx := \n}\n", "package a\nfunc F() {\n"],
    "css": [".a { color: red", ".a color: red; }", "<<<<<<< HEAD\n.a { b: c }", "import x from 'y';\nvar z = 1;", "def f():\n  pass\n"], "json": ["{\"a\": 1,}", "[1, 2", "{'a': 1}", "NaN", "// c\n{}"], "python": ["def f(:\n  pass", "x = '", "<<<<<<< HEAD\n", "print 1", "if x:\ny"],
}


@pytest.mark.parametrize(("language", "texts"), [("javascript", JS_OK), ("typescript", JS_OK + TS_OK), ("tsx", TS_OK), ("java", JAVA_OK), ("go", GO_OK), ("css", CSS_OK), ("json", ["{\"a\": [1, null]}", "1"]), ("python", ["x = 1\r\ndef f():\r\n\treturn x\r", "﻿y = '№'  # ["])])
def test_valid_texts_parse(language, texts):
    for t in texts:
        assert first_problem(language, t) is None, t


@pytest.mark.parametrize(("language", "texts"), [("javascript", JS_BAD), ("typescript", [b for b in JS_BAD if "interface" not in b and "number" not in b]), *BAD.items()])
def test_broken_texts_do_not(language, texts):
    for t in texts:
        assert first_problem(language, t) is not None, t


JSX = "export const A = ({ xs }) => (\n  <div className='a' {...p} on={() => { f('}') }}>\n    text, it's {xs.map((x) => <B.C key={x} v=\"1\" />)} {/* c */}\n    <>{a ? <b/> : null}</>\n  </div>\n);\n"


def test_elements():
    for language in ("javascript", "tsx"):
        assert first_problem(language, JSX) is None
        for broken in (JSX.replace("</div>", ""), JSX.replace("</div>", "</span>"), JSX.replace("key={x}", "key={x"), JSX.replace("{xs.map", "{xs.map(((")):
            assert first_problem(language, broken) is not None
    assert first_problem("typescript", JSX) is not None


def test_grammar_tables():
    g = compile_ = grammar.compile_grammar("S = A b | c SEMI\nA = a A |\n", "S")
    assert grammar.first_error(g, ["a", "a", "b"]) == -1 and grammar.first_error(g, ["a", "c"]) == 1 and grammar.first_error(compile_, ["c"]) == -1
    assert grammar.first_error(g, ["b", "b"]) == 1


def test_deep_and_long_texts():
    deep = "\n".join(" " * i + f"class C{i}:" for i in range(130)) + "\n" + " " * 130 + "x = 1\n"
    assert first_problem("python", deep) is None
    assert first_problem("javascript", "(" * 5000 + "1" + ")" * 5000) is None
    assert first_problem("javascript", "var x = 1;\n" * 20_000) is None


def test_parse_operator(spark):
    rows = [("a", "python", b"x = (\n"), ("b", "python", None), ("c", "markdown", b"("), ("d", None, b"("), ("e", "json", b"\xef\xbb\xbf{}"), ("f", "go", b"  \n"), ("g", "javascript", b"\xff\xfe"), ("a", "python", b"x = (\n"), (None, "json", b"{")]
    df = spark.createDataFrame(rows, "source_file_id string, language string, content binary").withColumn("error", F.lit("clash"))
    p = syntax.parse_files(df)
    assert {r["source_file_id"] for r in p.where("error is not null").collect()} == {"a", "g"} and p.count() == 6
    r = {x["language"]: (x["files"], x["failed"], x["rate"]) for x in syntax.rates(p, spark.createDataFrame([("a", "r"), ("b", "r")], "source_file_id string, repository_id string")).collect() if x["repository_id"]}
    assert r == {"python": (3, 2, 0.666667)}
    assert syntax.parse_files(df.limit(0)).count() == 0


def _code(rng, n=40):
    w = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    out = []
    for _ in range(n):
        out.append(rng.choice([f"    {w()} = {w()}.{w()}({rng.randrange(9999)}, {w()})", f"    if {w()}.{w()} > {rng.randrange(9999)}:", f"        {w()}.append({w()})", f"    # {w()} {w()} {w()}"]))
    return f"def {w()}({w()}):\n" + "\n".join(out) + "\n"


def test_judge():
    rng = random.Random(1)
    hand = _code(rng)
    assert handwritten.judge(hand, "python") is None
    assert handwritten.judge("# Do not edit the templates: they write 'Code generated' banners\n" + hand, "python") is None
    assert handwritten.judge("# Code generated by tool 1.2. DO NOT EDIT.\n" + "".join(f"F_{i:04} = field(name='x{rng.random()}')\n" for i in range(40)), "python") == "generated"
    assert handwritten.judge("".join(f"export function d{i}(r) {{ return r.f(1, 0x{rng.randrange(65536):x}); }}\n" for i in range(40)), "javascript") == "generated"
    assert handwritten.judge("".join(f"var a=b{i}?c:d({rng.randrange(99)});if(x&&y.z>{rng.randrange(99)}){{q()}}" for i in range(60)), "javascript") == "minified"
    assert handwritten.judge("T = [\n" + "".join(f"  {rng.randrange(65536)}, {rng.randrange(65536)},\n" for _ in range(80)) + "]\n", "python") == "data"
    assert handwritten.judge("// lib v1.2.3\n// (c) 2020 authors. Released under the MIT license.\nvar a = 1;\n", "javascript") == "vendored"
    assert handwritten.judge(".a {\n  margin: 3px;\n}\n.b {\n  margin: 17px;\n}\n" * 10, "css") is None
    assert handwritten.judge('x = "' + "word " * 120 + '"\n' + hand, "python") is None
    lock = '{\n "packages": {\n' + ",\n".join(f'  "p-{rng.random()}": {{\n   "version": "1.{i * 7 % 31}",\n   "hash": "sha-{rng.getrandbits(160):x}"\n  }}' for i in range(30)) + "\n }\n}\n"
    assert handwritten.judge(lock, "json") == "generated"
    licence = "/*\n" + "".join(f" * clause {i} of a long licence text that goes on and on in words of its own {rng.random()}\n" for i in range(90)) + " */\n"
    assert handwritten.judge(licence + "// Code generated by tool. DO NOT EDIT.\n" + "".join(f"var f_{rng.random():.9f} = field('{rng.random()}')\n" for i in range(40)), "javascript") == "generated"
    assert handwritten.judge("T = [\n" + "  1, 2, 3, 4,\n" * 200 + "]\n", "python") is None
    assert handwritten.judge("", "python") is None and handwritten.judge(" \n", None) is None


def test_machine_made(spark):
    rng = random.Random(2)
    lib, passage = _code(rng, 60), _code(rng, 12)
    patched = lib.replace("append", "extend", 2)
    rows = [("lib1", "python", "r1", lib), ("lib2", "python", "r2", patched), ("same1", "python", "r1", passage + _code(rng, 60)), ("same2", "python", "r2", passage + _code(rng, 60)), ("part", "python", "r3", passage)]
    rows += [(f"own{i}", "python", f"r{i % 3}", _code(rng)) for i in range(6)] + [("fork", "python", "r4", _code(rng))] * 2 + [("e", "go", "r1", ""), ("n", None, None, None), (None, "python", "r1", lib)]
    df = spark.createDataFrame([(a, b, c, d.encode() if d is not None else None) for a, b, c, d in rows], "source_file_id string, language string, repository_id string, content binary").withColumn("kind", F.lit("clash"))
    assert {tuple(r) for r in handwritten.machine_made(df).collect()} == {("lib1", "vendored"), ("lib2", "vendored")}
    assert handwritten.machine_made(df.limit(0)).count() == 0


def test_repair_grammar():
    seq, rules, uses = repair.grammar([1, 2, 1, 2, 3, 1, 2])

    def expand(x):
        return [y for s in rules[x] for y in expand(s)] if x in rules else [x]

    assert [y for s in seq for y in expand(s)] == [1, 2, 1, 2, 3, 1, 2] and uses
    assert repair.reuse(["a"] * 64) > 0.8 and repair.reuse([str(i) for i in range(64)]) == 0.0 and repair.reuse(["a"]) == 0.0
    assert repair.shape("x1 = 'a' + 0xff") == repair.shape("y2 = 'b' + 3") and repair.literal('[1, "a", -2.5],') and not repair.literal("x, 1")


@pytest.mark.parametrize("seed", range(60))
def test_repair_replaces_all_and_loses_nothing(seed):
    rng = random.Random(seed)
    symbols = [1] * rng.randrange(5) + [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(120))]
    seq, rules, uses = repair.grammar(symbols)
    out, todo = [], list(reversed(seq))
    while todo:
        x = todo.pop()
        if x in rules:
            todo += reversed(rules[x])
        else:
            out.append(x)
    assert out == symbols and all(n >= 2 for n in uses.values())
    at: dict = {}
    for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
        if pair[0] != pair[1] or at.get(pair, [-2])[-1] < i - 1:
            at.setdefault(pair, []).append(i)
    assert all(len(x) == 1 for x in at.values())


def test_repair_goes_on_after_overlaps():
    assert list(repair.grammar([1, 1, 1, 9, 2, 3, 8, 2, 3])[1].values()) == [(2, 3)]
    assert repair.shape('"a": "b", "c": [1, "d"]', True) == '"a": s, "c": [w, s]' and repair.values(['[1, "a b", -2.5],']) == ["1", '"a b"', "-2.5"]
