"""Operators on a graph of four functions and two types, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strandwork.operators import census, graph, history, knowledge, search, store, vectors
from strandwork.functions import ids

ENTITY = "id string, node_table string, kind string, name string, qualified_name string, file_path string, repo string, start_line int, end_line int, signature string, body string, body_hash string, language string"
EDGE = "rel string, src string, dst string, line int, context string, method string"


@pytest.fixture(scope="module")
def entities(spark):
    fn = lambda n, p: (f"function:{n}", "function", "Function", n, f"test::{n}", p, "test", 1, 10, f"fn {n}()", None, None, "rust")
    cls = lambda n, p: (f"class:{n}", "class", "Struct", n, f"test::{n}", p, "test", 1, 5, None, None, None, "rust")
    return spark.createDataFrame([fn("parse_file", "src/parser.rs"), fn("read_input", "src/parser.rs"), fn("write_output", "src/writer.rs"), fn("main", "src/main.rs"), cls("Parser", "src/parser.rs"), cls("Writer", "src/writer.rs")], ENTITY)


@pytest.fixture(scope="module")
def functions(entities):
    return entities.where("node_table = 'function'")


@pytest.fixture(scope="module")
def edges(spark):
    call = lambda a, b: ("calls", f"function:{a}", f"function:{b}", 1, None, None)
    return spark.createDataFrame([call("main", "parse_file")] * 3 + [call("main", "write_output"), call("parse_file", "read_input"), ("inherits", "class:Parser", "class:Writer", 1, None, None)], EDGE)


def names(df, col="name"):
    return sorted(r[col] for r in df.collect())


def only(spark, name):
    return spark.range(1).select(F.lit(name).alias("name"))


def test_search(functions):
    assert names(search.search_functions(functions, "PARSE")) == ["parse_file"]
    assert names(search.find_function(functions, "parse_file")) == ["parse_file"]
    assert names(search.find_function(functions, "parse")) == []
    assert names(search.ask_terms(functions, ["parse", "write"])) == ["parse_file", "write_output"]


def test_file_entities(entities):
    assert search.file_entities(entities, "src/parser.rs").count() == 3
    assert search.file_entities(entities, "nowhere").count() == 0


def test_callers_and_callees_count_repeated_edges_once(spark, functions, edges):
    calls = edges.where("rel = 'calls'")
    assert names(graph.callers(functions, calls, only(spark, "parse_file"))) == ["main"]
    assert names(graph.callers(functions, calls, only(spark, "main"))) == []
    assert names(graph.callees(functions, calls, only(spark, "main"))) == ["parse_file", "write_output"]
    assert names(graph.callees(functions, calls, only(spark, "read_input"))) == []


def test_explore(spark, entities, edges):
    rows = {(r["section"], r["name"]) for r in graph.explore(entities, edges, only(spark, "main")).collect()}
    assert {n for s, n in rows if s == "calls_to"} == {"parse_file", "write_output"}


def test_traversals(spark, functions, edges):
    calls = edges.where("rel = 'calls'")
    start = spark.range(1).select(F.lit("function:read_input").alias("node"))
    assert {(r["node"], r["hop"]) for r in graph.impact(functions, calls, start).collect()} == {("function:parse_file", 1), ("function:main", 2)}
    assert [(r["hop"], r["n"]) for r in graph.hops(calls, start.select(F.col("node").alias("id"))).orderBy("hop").collect()] == [(1, 1), (2, 1), (3, 0)]
    assert {(r["id"], r["direction"], r["relative"], r["level"]) for r in graph.type_hierarchy(edges).collect()} == {("class:Parser", "up", "class:Writer", 1), ("class:Writer", "down", "class:Parser", 1)}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "src string, dst string")
    assert [(r["a"], r["b"]) for r in graph.two_cycles(pairs).collect()] == [("a", "b")]


def test_census(functions, edges):
    calls = edges.where("rel = 'calls'")
    central = census.central(functions, calls).orderBy(F.desc("in_degree"), F.desc("id")).collect()
    assert len(central) == 4 and central[-1]["name"] == "main"
    assert names(census.dead_code(functions, calls)) == []
    top = max(census.clusters(functions, calls).collect(), key=lambda r: r["total"])
    assert top["total"] > 0 and top["file_path"] in ("src/parser.rs", "src/main.rs")
    assert search.api_changelog(functions, "test").count() == 4 and search.api_changelog(functions, "none").count() == 0


def test_unused(spark, functions, edges):
    orphan = spark.createDataFrame([("function:orphan_helper", "function", "Function", "orphan_helper", "q", "src/dead.rs", "test", 1, 10, None, None, None, "rust")], ENTITY)
    calls = edges.where("rel = 'calls'")
    both = functions.unionByName(orphan)
    assert names(census.dead_code(both, calls)) == ["orphan_helper"]
    assert names(census.unused_symbols(both, calls)) == ["orphan_helper"]


def test_hotspots(spark, functions):
    changes = spark.createDataFrame([("c1", "src/parser.rs"), ("c2", "src/parser.rs"), ("c2", "src/parser.rs")], "commit string, path string")
    rows = history.hotspots(functions.withColumnRenamed("file_path", "path"), changes).collect()
    assert len(rows) == 4 and rows[0]["churn"] == 2 and rows[0]["risk"] == 18


def test_overlaps(spark):
    hunks = spark.createDataFrame([(1, "a", 60, 200), (2, "a", 1, 1), (3, "b", 1, 500)], "hunk int, path string, first int, last int")
    symbols = spark.createDataFrame([("x", "a", 100, 400), ("y", "a", 201, 210), ("z", "a", 1, 60)], "id string, path string, start_line int, end_line int")
    assert {(r["hunk"], r["id"]) for r in history.overlaps(hunks, symbols).collect()} == {(1, "x"), (1, "z"), (2, "z")}


def test_bits(spark):
    v = spark.createDataFrame([(0, [0.5, -1.0, 0.0, 2.0]), (1, [0.5, -1.0, 0.0, 2.0]), (2, [-0.5, 1.0, 1.0, -2.0]), (3, [0.0] * 4)], "vec_id long, embedding array<float>")
    assert [r["b"] for r in v.orderBy("vec_id").select(vectors.bit_string(F.col("embedding")).alias("b")).collect()] == ["1001", "1001", "0110", "0000"]
    d = {(r["vec_id"]): r["distance"] for r in vectors.hamming_topk(v, v.where("vec_id = 0")).collect()}
    assert d == {1: 0, 2: 4, 3: 2}
    c = {(r["vec_id"]): r["score"] for r in vectors.cosine_topk(v, v.where("vec_id = 0")).collect()}
    assert c[1] == 1.0 and c[3] == 0.0


def test_scopes(spark):
    table = {"crates/alpha/src/store/table.rs": "alpha", "crates/web-app/src/routes.rs": "web-app", "src/main.rs": "src", "README.md": "root", "docs/api.md": "docs", "lib/foo/bar/baz.rs": "foo"}
    df = spark.createDataFrame(list(table.items()), "p string, want string")
    assert df.where(ids.file_scope(F.col("p")) != F.col("want")).count() == 0
    imports = {"from foo.bar import baz": "foo/bar", "import { X } from 'shared/utils'": "shared/utils", "use crate::graph::builder;": "crate/graph/builder", "import X from './helpers'": "helpers"}
    df = spark.createDataFrame(list(imports.items()), "b string, want string")
    assert df.where(ids.module_of_import(F.col("b")) != F.col("want")).count() == 0


KNOW = "id string, title string, content string, kind string, repo string, confidence string, tags array<string>, created_at string, updated_at string"


def test_knowledge_scopes(spark):
    k = spark.createDataFrame([("l", "Local Decision", "x decision", "decision", "repo_a", "medium", [], "1", "1"), ("g", "Global Decision", "y decision", "decision", "_global", "high", ["status:done"], "1", "2")], KNOW)
    assert knowledge.search(k, "decision", "repo_b", "project").count() == 0
    assert knowledge.search(k, "decision", "repo_b", "global").count() == 1
    assert knowledge.search(k, "decision", "repo_a", "both").count() == 2
    assert knowledge.arcs(k).count() == 0  # a state is no topic
    assert store.save_knowledge(k, k.where("id = 'l'").withColumn("updated_at", F.lit("9"))).count() == 2


def test_similarity_matches_all_pairs(spark):
    import random

    rng = random.Random(4)
    pool = [f"word{i}" for i in range(40)]
    base = [rng.sample(pool, rng.randrange(3, 14)) for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base[:20]] + [" ".join(base[0])] * 4 + ["", None]
    k = spark.createDataFrame([(i, "", t, "note", "r", None, None, None, None) for i, t in enumerate(texts)], KNOW.replace("id string", "id long"))
    bags = [set((t or "").split()) for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {}
    for i, b in enumerate(bags):
        if b:
            first = next((j for j in range(i) if bags[j] and jac(b, bags[j]) >= 0.7), None)
            links = {frozenset(x) for j, x in enumerate(bags) if x and x != b and jac(b, x) >= 0.7}
            want[i] = (first, len(links))
    got = {r["id"]: (r["duplicate_of"], r["n_links"]) for r in knowledge.duplicate_of(k).collect()}
    assert got == want


def test_upsert_and_delta(spark):
    old = spark.createDataFrame([("a", 1, "x", "e1"), ("b", 1, "y", None)], "id string, seq int, v string, emb string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("c", 2, "q")], "id string, seq int, v string")
    got = {(r["id"], r["v"], r["emb"]) for r in store.upsert(old, new, "id", "seq", ("emb",)).collect()}
    assert got == {("a", "z", "e1"), ("b", "y", None), ("c", "q", None)}
    d = store.delta(spark.createDataFrame([("f", "1\n2"), ("g", "1")], "key string, text string"), spark.createDataFrame([("f", "1\n3"), ("g", "1")], "key string, text string"))
    assert {tuple(r) for r in d.collect()} == {("f", "removed", "2"), ("f", "added", "3"), ("g", "unchanged", None)}
    with pytest.raises(ValueError):
        store.relate(spark, "a", "likes", "b")
