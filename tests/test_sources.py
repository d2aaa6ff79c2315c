import subprocess

import pytest
from pyspark.sql import functions as F

from treeloom.functions import ids
from treeloom.functions import text as T
from treeloom.functions.vectors import cosine, deterministic_embedding
from treeloom.operators import analysis, chunking, jobs, projects, relations, snapshots, store, validate
from treeloom.sources import aliases, discovery, extract, git
from treeloom.sources.catalog import Catalog

PY = b"""import os as o
from .models import User as U, thing
class A:
    class B:
        def m(self):
            self.z()
    def k(self):
        def inner():
            a.b.c(1)
        return inner()
if 1:
    def hidden(): pass
"""
TS = """interface User { id: number; }
export interface Out { x: string }
class UserService<T> {
    private n: number = 1;
    findUser(id: number): User | null { return load<T>(id); }
}
function createUser(name: string): User { return { id: 1, name }; }
const validateUser = (user: User): boolean => { return check(user); };
"""
JS = """import d, { a as b } from './m';
import * as ns from "./ns";
import './side';
class S { go() { return 1; } }
function f() { new X(1); obj.run(/[)]/); }
const g = async (x) => `${x}`;
"""


def test_python_extraction():
    s, i, c = extract.read(PY.decode(), "python")
    assert s == [("A", "CLASS", 3, 10, None), ("B", "CLASS", 4, 6, "A"), ("m", "METHOD", 5, 6, "B"), ("k", "METHOD", 7, 10, "A"), ("inner", "FUNCTION", 8, 9, None)]
    assert i == [("os", None, "o", 1), (".models", "User", "U", 2), (".models", "thing", None, 2)]
    assert sorted(c) == sorted([("m", "z", "self", 6), ("k", "c", "a.b", 9), ("inner", "c", "a.b", 9), ("k", "inner", None, 10)])


def test_script_extraction():
    s, _, c = extract.read(TS, "typescript")
    assert [(x[0], x[1], x[4]) for x in s] == [("User", "INTERFACE", None), ("UserService", "CLASS", None), ("findUser", "METHOD", "UserService"), ("createUser", "FUNCTION", None), ("validateUser", "FUNCTION", None)]
    assert [x[:2] for x in c] == [("validateUser", "check")]
    s, i, c = extract.read(JS, "javascript")
    assert [x[0] for x in s] == ["S", "go", "f", "g"] and [x[:2] for x in c] == [("f", "run")]
    assert i == [("./m", "default", "d", 1), ("./m", "a", "b", 1), ("./ns", "*", "ns", 2), ("./side", None, None, 3)]
    for broken in ("", "class", "function (", "const a = ", "import {", "`${", "class A { b("):
        extract.read(broken, "typescript")


@pytest.fixture(scope="module")
def checkout(spark):
    rows = [
        ("f1", "s", "app/main.py", "python", b"from .lib import helper as h\nfrom .pkg import thing\ndef run():\n    helper()\n    h()\n    run()\n    lone()\ndef lone(): pass\n"), ("f2", "s", "app/lib.py", "python", b"def helper():\n    pass\n"),
        ("f3", "s", "app/pkg/__init__.py", "python", b"from . import thing\n"), ("f4", "s", "bad.py", "python", b"def (\n"), ("f5", "s", "web/a.ts", "typescript", b"import { z } from '@lib/b';\nimport q from '../x/./c';\n"), ("f6", "s", "web/lib/b.tsx", "tsx", b"export const z = () => 1;\n"),
        ("f7", "s", "x/c/index.js", "javascript", b""), ("f8", "s", "r.md", "markdown", b"# t"), ("f9", "s", "latin.py", "python", b"x = '\xe9'\n"), ("f10", "s", "none.py", "python", None),
    ]
    return spark.createDataFrame(rows, "id string, snapshot_id string, relative_path string, language string, content binary")


def test_analysis_of_a_checkout(spark, checkout):
    pats = aliases.patterns(spark, {"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["web/lib/*"], "bad": "no list"}}})
    a = analysis.analyze(checkout, pats)
    assert {(r["source_file_id"], r["target_file_id"]) for r in a["source_file_relations"].collect()} == {("f1", "f2"), ("f1", "f3"), ("f5", "f6"), ("f5", "f7")}
    names = {r["id"]: r["qualified_name"] for r in a["symbols"].collect()}
    assert {(names[r["source_symbol_id"]], names[r["target_symbol_id"]], r["kind"]) for r in a["symbol_relations"].collect()} == {("run", "helper", "CALLS"), ("run", "lone", "CALLS")}
    assert {r["source_file_id"] for r in a["errors"].collect()} == {"f4", "f9", "f10"}
    c = analysis.counters(checkout, a).first()
    assert (c["total_files"], c["analyzed_files"], c["skipped_files"], c["error_files"], c["files_with_parse_errors"], c["symbols"]) == (10, 6, 1, 3, 0, 4)
    for bad, error in (("f4", "SyntaxError"), ("f9", "UnicodeDecodeError"), ("f10", "ValueError")):
        with pytest.raises(Exception, match=error):
            extract.extract(checkout.where(F.col("id") == bad).withColumnRenamed("id", "source_file_id"), strict=True).collect()
    x = analysis.index(checkout, a["symbols"])
    assert {r["source_file_id"]: r["status"] for r in x["status"].collect()}["f1"] == "indexed" and x["vectors"].count() == x["chunks"].count() == 4


def test_incremental_copies_what_did_not_change(spark, checkout):
    old = checkout.withColumn("content_hash", F.sha2("content", 256))
    a = analysis.analyze(old)
    prev = a | {k: v for k, v in analysis.index(old, a["symbols"]).items() if k != "status"}
    new = old.where("id in ('f1', 'f2', 'f6')").withColumns({"id": F.concat(F.lit("n-"), "id"), "snapshot_id": F.lit("t")})
    new = new.withColumn("content", F.when(F.col("id") == "n-f6", F.encode(F.lit("export const y = () => 2;\n"), "UTF-8")).otherwise(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    out = analysis.incremental(prev, old, new)
    assert {r["action"]: r["count"] for r in out["changes"].groupBy("action").count().collect()} == {"REUSE": 2, "ANALYZE": 1, "DELETE": 7}
    counted = out["counters"].first().asDict()
    assert tuple(counted) == analysis.COUNTERS
    full = analysis.analyze(new)
    made = analysis.index(new.where("id <> 'n-f6'"), full["symbols"])
    assert counted == {
        "reused_files": 2, "analyzed_files": 1, "skipped_files": 0, "deleted_files": 7, "reused_symbols": 3, "reused_symbol_relations": 2, "reused_source_file_relations": 1,
        "reused_chunks": made["chunks"].count(), "reused_vectors": made["vectors"].count(), "indexed_chunks": 1,
    }
    key = lambda df: {r["id"] for r in df.select("id").collect()}
    assert key(out["symbols"]) == key(full["symbols"])
    assert key(out["symbol_relations"]) == key(full["symbol_relations"]) and key(out["source_file_relations"]) == key(full["source_file_relations"])
    made = analysis.index(new, full["symbols"])
    assert key(out["chunks"]) == key(made["chunks"]) and out["vectors"].count() == made["vectors"].count()


def test_scripts_that_do_not_parse_are_flagged_and_read(spark):
    rows = [("a", "typescript", b"export const f = () => 1;\nfunction g( {\n"), ("b", "javascript", b"function h() { return 1; }\n"), ("c", "python", b"def (\n"), ("d", "tsx", b"")]
    df = spark.createDataFrame(rows, "source_file_id string, language string, content binary")
    got = {r["source_file_id"]: r for r in extract.extract(df).collect()}
    assert {k: r["has_errors"] for k, r in got.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert got["a"]["error"] is None and [x["name"] for x in got["a"]["symbols"]][:1] == ["f"]


def test_the_pipeline_goes_by_the_snapshot_before(spark, checkout):
    snaps = spark.createDataFrame([("s", "r", "READY", 1), ("t", "r", "PENDING", 2), ("u", "q", "PENDING", 3), ("x", "r", "FAILED", 0)], "id string, repository_id string, status string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    assert {(r["id"], r["previous_id"], r["mode"]) for r in analysis.route(snaps).collect()} == {("s", None, "FULL"), ("t", "s", "INCREMENTAL"), ("u", None, "FULL"), ("x", None, "FULL")}
    old = checkout.where("id in ('f1', 'f2')").withColumn("content_hash", F.sha2("content", 256))
    files = lambda s: old.withColumns({"snapshot_id": F.lit(s), "id": F.concat(F.lit(f"{s}-"), "id")})
    mode, first = analysis.process(snaps, "s", files, lambda s: {})
    assert mode == "FULL" and first["symbols"].count() == 3
    mode, second = analysis.process(snaps, "t", files, lambda s: {"s": first}[s])
    assert mode == "INCREMENTAL" and second["symbols"].count() == 3 and second["counters"].first()["reused_files"] == 2
    with pytest.raises(LookupError):
        analysis.process(snaps, "none", files, lambda s: {})


def test_aliases_of_several_projects(spark):
    schema = aliases.SCHEMA + ", snapshot_id string"
    pats = spark.createDataFrame([(0, "@lib/*", 0, "web/lib/*", ".", "s"), (0, "@lib/*", 0, "other/*", ".", "t")], schema)
    files = spark.createDataFrame([("f1", "s", "web/lib/b.ts"), ("f2", "s", "other/b.ts"), ("f3", "t", "other/b.ts"), ("f4", "t", "web/lib/b.ts"), ("f5", "u", "other/b.ts")], "id string, snapshot_id string, relative_path string")
    imports = spark.createDataFrame([("i1", "s", "@lib/b"), ("i2", "t", "@lib/b"), ("i3", "u", "@lib/b"), ("i4", "s", None)], "import_id string, snapshot_id string, module string")
    got = {r["import_id"]: r["target_file_id"] for r in relations.resolve_alias(imports, files, pats).collect()}
    assert got == {"i1": "f1", "i2": "f3", "i3": None, "i4": None}
    assert {r["target_file_id"] for r in relations.resolve_alias(imports, files, pats.drop("snapshot_id").limit(0)).collect()} == {None}


def test_nested_chunks(spark):
    code = "class A:\n    x = 1\n    def f(self):\n        def g():\n            return 2\n        return g\n    y = 3\n"
    s = spark.createDataFrame([("A", "f", "A", "CLASS", 1, 7), ("A.f", "f", "A.f", "METHOD", 3, 6), ("g", "f", "g", "FUNCTION", 4, 5)], "id string, source_file_id string, qualified_name string, kind string, start_line int, end_line int").withColumn("code", F.lit("clash"))
    f = spark.createDataFrame([("f", "s", "a.py", "python")], "id string, snapshot_id string, relative_path string, language string")
    t = spark.createDataFrame([("f", code)], "source_file_id string, text string")
    got = {r["symbol_id"]: r for r in chunking.chunk(s, f, t).collect()}
    assert got["A"]["code"] == "class A:\n    x = 1\n    [nested symbol: A.f]\n    y = 3"
    assert got["A.f"]["code"] == "    def f(self):\n        [nested symbol: g]\n        return g"
    assert got["g"]["text"] == "Language: python\nFile: a.py\nSymbol: g\nKind: FUNCTION\n\nCode:\n        def g():\n            return 2"


def test_ids_and_vectors(spark):
    import hashlib
    import uuid

    name = "s:ä/b.py"
    r = spark.range(1).select(ids.uuid5("3c52e96d-65cf-4bb8-92c0-d16f90b8f91f", F.lit(name)).alias("u"), deterministic_embedding(F.lit("x"), 40).alias("v"), cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    assert r["u"] == str(uuid.uuid5(uuid.UUID("3c52e96d-65cf-4bb8-92c0-d16f90b8f91f"), name)) and r["z"] == 0.0
    b = hashlib.sha256(b"x").digest()
    assert r["v"] == [b[i % 32] / 255 * 2 - 1 for i in range(40)]


def test_paths_and_lines(spark):
    col = lambda *xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i")
    assert [r[0] for r in col(".a", "a.", ".a.py", "..a", "d.x/f", "a.tar.gz").select(T.suffix(F.col("x"))).collect()] == ["", "", ".py", ".a", "", ".gz"]
    assert [r[0] for r in col("a/./b/../c", "../../x", "").select(T.normal_path(F.col("x"))).collect()] == ["a/c", "x", ""]
    assert [r[0] for r in col("a\r\nb\rc\x0bd\n", "", "\n").select(T.split_lines(F.col("x"))).collect()] == [["a", "b", "c", "d"], [], [""]]
    assert [r[0] for r in col("Dockerfile", "a.PY", "x/LICENSE", "q.zzz", "README").select(T.language(F.col("x"))).collect()] == ["dockerfile", "python", "unknown", "unknown", "markdown"]
    assert [r[0] for r in col("a/Tests/b.py", "test_x.py", "x_test.py", "a.spec.ts", "contest.py", "a\\test\\b", None).select(T.is_test_path(F.col("x"))).collect()] == [True] * 4 + [False, True, False]
    assert [r[0] for r in col("How are mocks used?", "nothing", None).select(T.asks(F.col("x"), T.TEST_WORDS)).collect()] == [True, False, False]


def test_scan_and_git(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "node_modules").mkdir(parents=True)
    (repo / "node_modules" / "x.js").write_text("1")
    (repo / "src").mkdir()
    (repo / "src" / "a.py").write_text("x = 1\n")
    (repo / "big.txt").write_text("x" * 50)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", ".")
    run("commit", "-m", "one")
    run("remote", "add", "origin", "https://github.com/o/n")
    info = git.inspect(str(repo))
    assert len(info["commit_sha"]) == 40 and info["branch"] == "main" and info["remote_url"] == "https://github.com/o/n"
    with pytest.raises(git.GitError):
        git.clone(str(tmp_path / "nowhere"), str(tmp_path / "to"))
    d = discovery.describe(discovery.scan(spark, str(repo), "snap", max_bytes=40))
    assert [(r["relative_path"], r["language"], r["size_bytes"]) for r in d.collect()] == [("src/a.py", "python", 6)]
    assert discovery.ignored_count(str(repo), 40) >= 3
    with pytest.raises(NotADirectoryError):
        discovery.scan(spark, str(repo / "no"), "snap")
    (repo / "tsconfig.json").write_text("{ not json")
    assert aliases.load(str(repo)) is None


def test_catalog_and_projects(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    c.create()
    p = projects.create_project(c, " P ", " ")
    assert projects.get_project(c, p["id"]) == {"id": p["id"], "name": "P", "description": None, "status": "ACTIVE"}
    r = projects.register_repository(c, p["id"], "https://github.com/o/n.git/")
    assert (r["owner"], r["name"]) == ("o", "n")
    with pytest.raises(projects.ConflictError):
        projects.register_repository(c, p["id"], "https://github.com/o/n")
    s = projects.create_snapshot(c, r["id"], "A" * 40, r["remote_url"])
    with pytest.raises(projects.ConflictError):
        projects.create_snapshot(c, r["id"], "a" * 40, r["remote_url"])
    with pytest.raises(projects.NotFoundError):
        projects.create_snapshot(c, "nobody", "b" * 40, "u")
    job = projects.start_job(c, s["id"])
    with pytest.raises(projects.ConflictError):
        projects.start_job(c, s["id"])

    def fail(_):
        raise RuntimeError("no disk")

    saved = []
    assert jobs.run(job, lambda _: None, fail, saved.append)["progress"] == 30
    assert [x["status"] for x in saved] == ["DISCOVERING", "PROCESSING", "FAILED"] and saved[-1]["error_message"] == "no disk"
    c.upsert("analysis_jobs", spark.createDataFrame([saved[-1]], c.read("analysis_jobs").schema))
    assert projects.start_job(c, s["id"])["status"] == "QUEUED"
    f = spark.createDataFrame([("f1", s["id"], "a.py", "python", 1, "h"), ("f2", "other", "b.py", "python", 1, "h")], c.read("source_files").schema)
    c.upsert("source_files", f)
    assert c.purge(s["id"])["source_files"] == 1 and c.read("source_files").count() == 1 and c.read("snapshots").count() == 0
    assert c.delete("source_files", F.col("snapshot_id") == "other") == 1


def test_store_operations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    w = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3), (None, 6, 4)], "id string, v int, seq int")
    assert sorted(tuple(r) for r in store.upsert(old, store.last_write(w, "id", "seq").drop("seq")).collect()) == [("a", 1), ("b", 4), ("c", 5)]
    e = spark.createDataFrame([("e1", "a", "b"), ("e2", "c", "a"), ("e3", "c", "d")], "id string, s string, t string")
    kept, gone = store.delete_touching(e, "s", "t", spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [r["id"] for r in kept.collect()] == ["e3"] and gone.first()["deleted"] == 2
    kept, gone = store.delete_in(e, "s", spark.createDataFrame([], "id string"))
    assert kept.count() == 3 and gone.first()["deleted"] == 0
    assert [r["id"] for r in store.listed(e, ["t"]).collect()] == ["e2", "e1", "e3"]
    assert store.first_positions(w.where("id is not null"), ["id"], "seq").count() == 2


def test_rules(spark):
    s = spark.createDataFrame([("x", 0, 5, " ", "q", "CLASS"), ("y", 3, 2, "n", "q", "WHAT"), ("z", 1, 1, "n", "q", "CLASS")], "id string, start_line int, end_line int, name string, qualified_name string, kind string")
    v = {r["id"]: r["violations"] for r in validate.violations(s, "symbols").collect()}
    assert v == {"x": ["name is blank", "start_line isn't positive"], "y": ["end_line is before start_line", "kind is unknown"]}
    u = spark.createDataFrame([("https://github.com/a/b/",), ("http://github.com/a/b",), ("https://github.com/a/b/c",), (None,)], "u string")
    assert [r[0] and tuple(r[0]) for r in u.select(validate.repository_parts(F.col("u"))).collect()] == [("a", "b"), None, None, None]


def test_jobs_audit_and_previous(spark):
    log = spark.createDataFrame([(1, "j", 1, "QUEUED", 0, None), (2, "j", 2, "PROCESSING", 30, None), (3, "j", 3, "PROCESSING", 20, None), (4, "j", 4, "READY", 100, None), (5, "j", 5, "FAILED", 100, "m")], "id int, job_id string, created_at int, status string, progress int, error_message string")
    assert [r["problem"] for r in jobs.audit(log).orderBy("id").collect()] == [None, None, "progress fell", None, "ready job failed"]
    s = spark.createDataFrame([("1", "r", "READY", 1), ("2", "r", "FAILED", 2), ("3", "r", "READY", 3), ("4", "r", "READY", 3), ("5", "r", "PENDING", 4), ("6", "q", "READY", 9)], "id string, repository_id string, status string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    assert {r["id"]: r["previous_id"] for r in snapshots.previous_ready(s).collect()} == {"1": None, "2": "1", "3": "1", "4": "1", "5": "4", "6": None}


def test_import_listing(spark):
    i = spark.createDataFrame([("i1", "f", ".lib"), ("i2", "f", "os"), ("i3", "f", ".none")], "id string, source_file_id string, module string")
    f = spark.createDataFrame([("t1", "a/lib.py"), ("t2", "a/b.py")], "id string, relative_path string")
    e = spark.createDataFrame([("f", "t2"), ("f", "t1")], "source_file_id string, target_file_id string")
    assert {r["id"]: r["resolved_path"] for r in relations.list_imports(i, f, e).collect()} == {"i1": "a/lib.py", "i2": None, "i3": None}
