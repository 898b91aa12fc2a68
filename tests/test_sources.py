"""Parsers, readers, streams, questions and conversation rules on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from strandwork.operators import ask, conversation
from strandwork.sources import code
from strandwork.sources.parsers import hunks, language_of, parse
from strandwork.streaming import streams


def found(path, text):
    entities, edges = parse(path, text, "r")
    return {(e["kind"], e["name"]) for e in entities}, {(e["rel"], e["dst"].split(":")[-1]) for e in edges}


@pytest.mark.parametrize(
    "path, text, kinds, edges",
    [
        ("a.py", "import os\nclass A(B):\n    def m(self):\n        return g()\ndef g():\n    pass\n", {("Class", "A"), ("Method", "m"), ("Function", "g")}, {("calls", "g"), ("inherits", "B")}),
        ("a.rs", "use std::fmt;\npub struct P { x: u8 }\nimpl Show for P {\n    fn go(&self) { help(1); }\n}\nfn help(n: u8) {}\n", {("Struct", "P"), ("Method", "go"), ("Function", "help")}, {("calls", "help"), ("implements", "Show")}),
        ("a.ts", "export class A extends B {\n  run(x: number): void {\n    go(x);\n  }\n}\nexport const go = (x: number) => {\n  return x;\n};\n", {("Class", "A"), ("Method", "run"), ("Function", "go")}, {("calls", "go"), ("inherits", "B")}),
        ("A.java", "class A implements B {\n    public int f(int x) {\n        return g(x);\n    }\n}\n", {("Class", "A"), ("Method", "f")}, {("calls", "g"), ("implements", "B")}),
        ("a.go", "type T struct {\n}\nfunc (t *T) Run(x int) int {\n    return Help(x)\n}\nfunc Help(x int) int {\n    return x\n}\n", {("Struct", "T"), ("Method", "Run"), ("Function", "Help")}, {("calls", "Help")}),
        ("k.cu", "__global__ void kern(int *a) {\n  a[0] = 1;\n}\nint main() {\n  kern<<<1, 2>>>(p);\n  return 0;\n}\n", {("Function", "kern"), ("Function", "main")}, {("calls", "kern")}),
        ("c.json", '{"a": {"b": 1}, "l": [1, 2]}', {("ConfigSection", "a"), ("ConfigKey", "a.b"), ("ConfigKey", "l")}, set()),
        ("c.toml", "[a]\nb = 1\n", {("ConfigSection", "a"), ("ConfigKey", "a.b")}, set()),
        ("c.yaml", "a:\n  b: 1\n  c:\n    d: x\n", {("ConfigSection", "a"), ("ConfigKey", "a.b"), ("ConfigKey", "a.c.d")}, set()),
        ("n.md", "---\nname: N\ntype: moc\n---\n# T\nsee [[other|x]] and [l](u)\n```py\nx\n```\n", {("SkillMOC", "N"), ("DocSection", "T"), ("DocLink", "l"), ("DocCodeBlock", "py")}, {("links_to", "other")}),
        ("Dockerfile", "FROM a AS b\nRUN x\n", {("DockerStage", "a.b"), ("DockerInstruction", "RUN")}, set()),
        ("s.sql", "CREATE TABLE IF NOT EXISTS t (a int);\ncreate unique index i on t(a);\ncreate view v as select 1;", {("DbTable", "t"), ("DbIndex", "i"), ("DbView", "v")}, set()),
        ("m.tf", 'resource "a" "b" {}\nvariable "c" {}', {("TerraformResource", "a.b"), ("TerraformVariable", "c")}, set()),
        ("package.json", '{"name": "p", "dependencies": {"d": "1"}, "scripts": {"s": "x"}}', {("Package", "p"), ("Dependency", "d"), ("Script", "s")}, {("depends_on_package", "d"), ("runs_script", "s")}),
        ("o.json", '{"openapi": "3", "paths": {"/a": {"get": {}}}, "components": {"schemas": {"S": {"properties": {"f": {}}}}}}', {("ApiEndpoint", "GET /a"), ("ApiSchema", "S"), ("ApiField", "f")}, set()),
        ("m.proto", "message M {}\nservice S { \n rpc R(M) returns (M);\n}", {("ProtoMessage", "M"), ("ProtoService", "S"), ("ProtoRpc", "R")}, set()),
        ("h.js", "async function f() {\n  await axios.post('https://x.y/api/z');\n  fetch('/q');\n}\n", {("HttpClientCall", "POST /api/z"), ("HttpClientCall", "GET /q")}, {("calls_endpoint", "/api/z")}),
        ("bad.py", "def (:", {("File", "bad.py")}, set()),
        ("bad.json", "{", {("File", "bad.json")}, set()),
    ],
)
def test_parse(path, text, kinds, edges):
    k, e = found(path, text)
    assert kinds <= k and edges <= e
    assert found(path, text.replace("\n", "\r\n")) == (k, e)


def test_language_of():
    assert [language_of(p) for p in ("a/Dockerfile", "x.cu.inc", "b.tsx", "noext", "package.json")] == ["dockerfile", "cuda", "typescript", None, "package"]


def test_parsed_frame_skips_and_tags(spark):
    files = spark.createDataFrame([("src/a.py", "def f():\n    g()\n", "r"), ("node_modules/x.js", "function x() {}", "r"), (None, "x", "r"), ("b.py", None, "r"), ("e.py", "", None)], "path string, content string, repo string")
    rows = code.parsed(files)
    assert {r["name"] for r in code.entities(rows).collect()} == {"a.py", "f", "e.py"}
    assert [r["raw_callee"] for r in code.edges(rows).where("rel = 'calls'").collect()] == ["g"]
    assert code.parsed(files.limit(0)).count() == 0


def test_diff_hunks(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ fn\n+a\n@@ -9 +12 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert list(hunks(diff)) == [("x", 3, 4), ("x", 12, 1)]
    rows = code.diff_hunks(spark.createDataFrame([("d", diff), ("e", None)], "diff_id string, diff string")).collect()
    assert [(r["path"], r["first"], r["last"]) for r in rows] == [("x", 3, 6), ("x", 12, 12)]


def test_git_log(spark):
    log = "\x1eh1\x1fann\x1f100\x1ffix\n\nM\tsrc/a.py\nR100\told\tnew\n\x1eh2\x1fbob\x1f200\x1fadd\nA\tb\n"
    commits, changes = code.git_log(spark.createDataFrame([("r", log)], "repo string, log string"))
    assert {(r["commit"], r["author"], r["ts"]) for r in commits.collect()} == {("h1", "ann", 100), ("h2", "bob", 200)}
    assert {(r["commit"], r["path"], r["change_type"]) for r in changes.collect()} == {("h1", "src/a.py", "Modified"), ("h1", "new", "Renamed"), ("h2", "b", "Added")}


def test_conversation_lines_and_segments(spark):
    said = [("user", "I get an error: it failed to compile and the build is broken, please look into this one."), ("assistant", "The problem is the missing import in the schema file."), ("assistant", "Fixed by adding the import, all tests pass."), ("assistant", "I decided to keep the old name because it is shorter. Fine.")]
    lines = [("s.jsonl", i, json.dumps({"type": r, "message": {"role": r, "content": [{"type": "text", "text": t}]}, "timestamp": f"2024-01-01T10:0{i}:00Z", "sessionId": "test-abc-123"})) for i, (r, t) in enumerate(said)]
    lines += [("s.jsonl", 9, "not json"), ("s.jsonl", 10, json.dumps({"type": "system", "message": {"role": "user", "content": "x"}})), ("t.jsonl", 0, json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "is_error": True, "content": "Traceback: bad thing happened"}]}}))]
    turns = code.conversations(spark.createDataFrame(lines, "file string, line int, value string"))
    segs = conversation.segments(turns)
    rows = segs.orderBy("conv_id", "line").collect()
    assert [(r["conv_id"], r["kind"]) for r in rows] == [("t", "problem"), *(("test-abc-123", k) for k in ("problem", "problem", "solution", "decision"))]
    assert rows[-1]["rationale"] == "because it is shorter" and rows[0]["confidence"] == 0.9
    assert [(r["line"], r["problem_line"]) for r in conversation.preceding_problem(segs).collect()] == [(2, 1)]


def test_score_of_one_hit(spark):
    df = spark.createDataFrame([("root cause",), ("is missing",), ("fine",), (None,)], "t string")
    assert [r["s"] for r in df.select(conversation.score(F.col("t"), conversation.PROBLEM).alias("s")).collect()] == [0.85, 0.65, 0.0, 0.0]


def test_compress():
    assert conversation.compress("short", 10) == "short"
    text = "Well so basically okay. The function in src/a.rs must use `x` instead of y. " * 5
    assert "must use" in conversation.compress(text, 120) and len(conversation.compress(text, 120).encode()) <= 120


@pytest.mark.parametrize("q, kind", [("who calls parse_file?", "callers"), ("what does main call?", "callees"), ("how many classes are there", "count"), ("largest functions", "largest"), ("show imports", "imports"), ("functions in src/a.rs", "in_file"), ("list all functions", "list"), ("parse json", "search"), ("kaç fonksiyon var", "count")])
def test_questions(q, kind):
    assert ask.parse(q).kind == kind


def test_word_at():
    assert ask.word_at("let 😀foo = bar", 0, 7) == "foo" and ask.word_at("x", 3, 0) == ""


def test_output_shorteners(spark):
    lines = spark.createDataFrame([("d", i, f"a.rs:{i}: hit") for i in range(100)] + [("e", i, f"l{i}") for i in range(46)], "doc string, n int, line string")
    assert ask.short_grep(lines.where("doc = 'd'")).collect()[0]["line"] == "a.rs:0: hit (+99 more)"
    assert ask.head_tail(lines.where("doc = 'e'")).count() == 46 and ask.head_tail(lines.where("doc = 'd'")).count() == 46


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 1700, "r", "k", "s" if i % 3 else None, None) for i in range(60)]
    events = spark.createDataFrame(rows, streams.EVENTS)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    streams.run_to_memory(streams.hourly_counts(streams.event_stream(spark, str(tmp_path / "in"))), "hours_test", str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.table("hours_test").collect())) == sorted(map(tuple, streams.hourly_counts(events).collect()))


def test_incremental_index_skips_equal_hashes(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "path string, repo string, hash string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    folder, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    for name, rows in (("1", [("a", "r", "1"), ("b", "r", "1")]), ("2", [("a", "r", "1"), ("b", "r", "2")])):
        put(name, rows)
        scans = streams.event_stream(spark, str(tmp_path / "in" / "*"), "path string, repo string, hash string")
        streams.index_changes(scans, folder, cp).awaitTermination()
    log = streams.read_log(spark, folder)
    assert log.count() == 3
    assert {tuple(r) for r in streams.latest_scans(log).collect()} == {("r", "a", "1"), ("r", "b", "2")}


@pytest.mark.parametrize(
    "path, text, kinds, edges",
    [
        ("a.cpp", "class A : public B, private ns::C<int> {\n  int f(int x) {\n    return g(x);\n  }\n};\nenum E : int { X };\n", {("Class", "A"), ("Method", "f"), ("Enum", "E")}, {("inherits", "B"), ("inherits", "C"), ("calls", "g")}),
        ("a.cs", "public class A : Base, IThing<int>\n{\n}\npublic interface IMore : IThing\n{\n}\n", {("Class", "A"), ("Interface", "IMore")}, {("inherits", "Base"), ("implements", "IThing"), ("inherits", "IThing")}),
        ("a.kt", "class A(val x: Int) : B(x), C {\n  fun f(): Int {\n    return g()\n  }\n}\n", {("Class", "A"), ("Method", "f")}, {("inherits", "B"), ("implements", "C"), ("calls", "g")}),
        ("a.swift", "class A: B, P {\n  func f() {\n    g()\n  }\n}\n", {("Class", "A"), ("Method", "f")}, {("inherits", "B"), ("implements", "P")}),
        ("a.scala", "class A extends B with C {\n  def f(x: Int) = { g(x) }\n}\n", {("Class", "A"), ("Method", "f")}, {("inherits", "B"), ("inherits", "C")}),
        ("a.dart", "class A extends B<int> with M implements I {\n}\n", {("Class", "A")}, {("inherits", "B"), ("inherits", "M"), ("implements", "I")}),
        ("a.java", "class A\n    extends B\n    implements C, D<E> {\n}\n", {("Class", "A")}, {("inherits", "B"), ("implements", "C"), ("implements", "D")}),
        ("a.rs", "pub trait T: Base + Send {\n}\n", {("Trait", "T")}, {("inherits", "Base"), ("inherits", "Send")}),
        ("a.rb", "class A < M::B\n  def f\n    1\n  end\nend\n", {("Class", "A"), ("Method", "f")}, {("inherits", "B")}),
        ("a.ts", "class A<T> extends B<T> implements C {\n}\n", {("Class", "A")}, {("inherits", "B"), ("implements", "C")}),
        ("a.cs", 'class A {\n  void F() {\n    _httpClient.GetStringAsync("https://h/x/1");\n    restClient.ExecuteAsync("/any");\n    x.Get("/no");\n  }\n}\n', {("HttpClientCall", "GET /x/1"), ("HttpClientCall", "UNKNOWN /any")}, {("calls_endpoint", "/x/1")}),
        ("a.lua", "local x = require('m')\nlocal function f(a)\n  return g(a)\nend\nfunction g(a)\n  return a\nend\n", {("Function", "f"), ("Function", "g"), ("Import", "local x = require('m')")}, {("calls", "g")}),
        ("a.zig", "const P = struct {\n    fn go(x: u8) u8 {\n        return help(x);\n    }\n};\nfn help(x: u8) u8 {\n    return x;\n}\n", {("Struct", "P"), ("Method", "go"), ("Function", "help")}, {("calls", "help")}),
        ("a.ex", "defmodule A do\n  import B\n  def f(x) do\n    g(x)\n  end\n  defp g(x) do\n    x\n  end\nend\n", {("Class", "A"), ("Method", "f"), ("Method", "g")}, {("calls", "g")}),
        ("a.hs", "import Data.Map\ndata T = T Int\nf :: Int -> Int\nf 0 = 1\nf x = x\ng :: Int\ng = 1\n", {("Class", "T"), ("Function", "f"), ("Function", "g"), ("Import", "import Data.Map")}, set()),
        ("a.jl", "struct P\nend\nfunction f(x)\n  g(x)\nend\nfunction g(x)\n  x\nend\n", {("Class", "P"), ("Function", "f")}, {("calls", "g")}),
        ("a.sh", "source ./lib.sh\nbuild() {\n  echo x\n}\nfunction run() {\n  build\n}\n", {("Function", "build"), ("Function", "run"), ("Import", "source ./lib.sh")}, set()),
        ("a.R", "library(x)\nf <- function(a) {\n  g(a)\n}\ng = function(a) {\n  a\n}\n", {("Function", "f"), ("Function", "g"), ("Import", "library(x)")}, {("calls", "g")}),
        ("a.erl", "-include(\"x.hrl\").\nf(X) -> g(X).\ng(X) -> X.\n", {("Function", "f"), ("Function", "g")}, {("calls", "g")}),
        ("a.sol", "import './b.sol';\ncontract A {\n  function f() public {\n    g();\n  }\n  function g() public {\n  }\n}\n", {("Class", "A"), ("Method", "f"), ("Method", "g")}, {("calls", "g")}),
        ("a.f90", "module m\ncontains\nsubroutine s(x)\n  call t(x)\nend subroutine\nsubroutine t(x)\nend subroutine\nend module\n", {("Method", "s"), ("Method", "t"), ("Class", "m")}, {("calls", "t")}),
        ("a.scm", "(define (f x) (g x))\n(define (g x) x)\n", {("Function", "f"), ("Function", "g")}, {("calls", "g")}),
        ("a.lisp", "(defun f (x) (g x))\n(defun g (x) x)\n(defclass c () ())\n", {("Function", "f"), ("Class", "c")}, {("calls", "g")}),
        ("Makefile", "include x.mk\nall: a\n\tgo\na:\n\tx\n", {("Function", "all"), ("Function", "a"), ("Import", "include x.mk")}, set()),
        ("CMakeLists.txt", "find_package(X)\nfunction(f a)\n  g()\nendfunction()\n", {("Function", "f"), ("Import", "find_package(X)")}, set()),
        ("q.graphql", "type T {\n  f: Int\n}\nquery Q {\n  f\n}\n", {("Class", "T"), ("Function", "Q")}, set()),
        ("a.gd", "class_name P\nfunc f():\n\tg()\nfunc g():\n\tpass\n", {("Function", "f"), ("Function", "g")}, {("calls", "g")}),
        ("a.pas", "uses x;\nprocedure f(a: integer);\nbegin\n  g(a);\nend;\nprocedure g(a: integer);\nbegin\nend;\n", {("Function", "f"), ("Function", "g")}, {("calls", "g")}),
    ],
)
def test_more_languages(path, text, kinds, edges):
    k, e = found(path, text)
    assert kinds <= k and edges <= e, (kinds - k, edges - e, k, e)
    assert ("HttpClientCall", "GET /no") not in k


def test_yaml_values():
    text = "a: &x {b: 1, c: {d: 'e, f'}}\nl:\n  - 1\n  - k: v\n    w: z\n  - 3\nm: [1, 2]\nt: |\n  one: not a key\n  two\nn: *x # end\n'q r': s\no:\n- 1\n- 2\np:\n  - name: x\nz: 9\nurl: http://h:1/x\n"
    entities, _ = parse("c.yaml", text, "r")
    got = {e["name"]: (e["kind"], e.get("body")) for e in entities if e["kind"] != "File"}
    assert got == {
        "a": ("ConfigSection", None), "a.b": ("ConfigKey", "1"), "a.c": ("ConfigSection", None), "a.c.d": ("ConfigKey", "e, f"), "l": ("ConfigKey", "[3 items]"), "m": ("ConfigKey", "[2 items]"), "t": ("ConfigKey", "one: not a key\ntwo"),
        "n": ("ConfigKey", "*x"), "q r": ("ConfigKey", "s"), "o": ("ConfigKey", "[2 items]"), "p": ("ConfigKey", "[1 items]"), "z": ("ConfigKey", "9"), "url": ("ConfigKey", "http://h:1/x"),
    }


def test_short_installs_and_builds(spark):
    said = ["npm warn deprecated a@1", "added 3 packages", "  npm notice new", "2 packages are looking for funding", "npm fund", "warning x", "npm sill y", "found 0 vulnerabilities"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(said)], "doc string, n int, line string")
    assert [r["line"] for r in ask.short_install(lines).orderBy("n").collect()] == ["added 3 packages", "found 0 vulnerabilities", "... 2 deprecation warnings ...", "... 2 funding lines ..."]
    said = ["Step 1/2 : FROM a", " ---> abc", "#5 x", "downloading", "layer CACHED", "--- DONE", "ERROR no", "Successfully built a"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(said)], "doc string, n int, line string")
    assert [r["line"] for r in ask.short_image_build(lines).orderBy("n").collect()] == ["Step 1/2 : FROM a", "#5 x", "layer CACHED", "ERROR no", "Successfully built a", "... 3 layer lines ..."]
    assert ask.short_install(lines.limit(0)).count() == 0
