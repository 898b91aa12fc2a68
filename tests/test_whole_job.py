"""Whole results where a part was left out: against brute force, by hand, and against SQL of the full definition."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandwork import catalog
from strandwork.functions import ids
from strandwork.operators import blocks, conversation, knowledge, resolve, vectors

from .compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


def pairs_of(mentions):
    of = {}
    for s, n in set(mentions):
        if s is not None and n is not None:
            of.setdefault(s, set()).add(n)
    return {(a, b): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2) if of[a] & of[b]}


def links_of(spark, mentions, schema):
    """The pairs of sessions that classes and links of classes stand for."""
    df = spark.createDataFrame(mentions, schema)
    classes = {}
    for r in conversation.discussion_classes(df).collect():
        classes.setdefault(r["cls"], []).append(r["session"])
    out = {}
    for r in conversation.co_discussed(df).collect():
        assert (len(classes[r["a"]]), len(classes[r["b"]])) == (r["n_a"], r["n_b"])
        for x in classes[r["a"]]:
            for y in classes[r["b"]]:
                if x != y:
                    out[min(x, y), max(x, y)] = r["n"]
    return out


@pytest.mark.parametrize("part", [1_000, 2])
def test_a_name_in_many_sessions_links_them_all(spark, monkeypatch, part):
    monkeypatch.setattr(conversation, "PART", part)
    mentions = [(s, "everywhere") for s in range(14)] + [(s, f"n{s % 5}") for s in range(14)] * 2 + [(3, "alone"), (None, "everywhere"), (4, None)]
    for kind, of in (("long", lambda s: s), ("string", lambda s: None if s is None else f"s{s}")):
        own = [(of(s), n) for s, n in mentions]
        found = links_of(spark, own, f"session {kind}, name string")
        assert found == pairs_of(own) and len(found) == 14 * 13 // 2
    assert conversation.co_discussed(spark.createDataFrame([], "session long, name string")).count() == 0


def test_co_discussed_is_the_uncapped_definition(spark):
    # the definition before the cap on names
    m = catalog.ORACLE["entity_links"].replace("SELECT doc_id AS text_id, name FROM t JOIN n USING (w)", ", m AS (SELECT DISTINCT doc_id AS session, name FROM t JOIN n USING (w))")
    sql = m + " SELECT a.session AS a, b.session AS b, count(*) AS n FROM m a JOIN m b ON a.name = b.name AND a.session < b.session GROUP BY 1, 2"
    want = connect(FOLDER).execute(sql).fetchdf()
    classes = catalog.QUERIES["co_discussed_classes"](spark, FOLDER).toPandas()
    links = catalog.QUERIES["co_discussed"](spark, FOLDER).toPandas()
    both = links.merge(classes.rename(columns={"session": "x", "cls": "a"})[["x", "a"]], on="a").merge(classes.rename(columns={"session": "y", "cls": "b"})[["y", "b"]], on="b")
    # a class's own pairs come both ways round, as do no others
    both = both[(both.a != both.b) | (both.x < both.y)]
    got = both.assign(a=both[["x", "y"]].min(axis=1), b=both[["x", "y"]].max(axis=1))[["a", "b", "n"]]
    assert len(want) and rows(got) == rows(want)


def test_module_of_use_is_the_whole_path(spark):
    want = {"use graph/snapshot": "graph/snapshot", "use graph/snapshot;": "graph/snapshot", "pub use a::b/c-d::e;": "a/b/c-d/e", "use std::io::Read; // x": "std/io/Read", "use plain": "plain", "useless": ""}
    df = spark.createDataFrame(list(want.items()), "b string, want string")
    assert {r["b"]: r["m"] for r in df.select("b", ids.module_of_import(F.col("b")).alias("m")).collect()} == want


def linked(spark, imports, files, k=5):
    entities = spark.createDataFrame([(i, "import_decl", repo, body) for i, (repo, body) in enumerate(imports)], "id long, node_table string, repo string, body string")
    got = resolve.link_repos(entities, spark.createDataFrame(files, "repo string, path string"), k).collect()
    return sorted((r["import_id"], r["repo"], r["path"]) for r in got)


def links_by_hand(imports, files, k=5):
    out = []
    for i, (repo, body) in enumerate(imports):
        module = body.removeprefix("use ").rstrip(";").replace("::", "/")
        out += [(i, *f) for f in sorted({f for f in files if None not in f and f[0] != repo and module in f[1]})[:k]]
    return sorted(out)


def test_links_by_whole_modules(spark):
    imports = [("r", "use graph/snapshot"), ("s", "use graph::snapshot;"), ("r", "use graph"), ("r", "use no/where")]
    files = [("s", "src/graph/snapshot.rs"), ("s", "src/graph/other.rs"), ("r", "lib/graph/snapshot.rs"), ("t", "graph/snapshot/x.rs"), ("t", None)]
    assert linked(spark, imports, files) == links_by_hand(imports, files)


def test_links_where_the_module_stands_inside_segments(spark):
    imports = [("r", b) for b in ("use graph/snapshot", "use aph/snap", "use ap", "use x", "use very/long/module/name/of/parts", "use src/graph/snapshot_ab12.rs", "use graph/snapshots")] + [("s", "use graph/snapshot"), ("r", "use graph/snapshot")]
    files = [("s", "src/graph/snapshot_ab12.rs"), ("t", "src/subgraph/snapshot.v2.rs"), ("t", "a/very/long/module/name/of/parts_1.rs"), ("s", "b/very/long/module/name/off/parts.rs"), ("r", "src/graph/snapshot.rs"), ("t", "x")] + [("u", f"graph/snapshot{i}.rs") for i in range(9)]
    assert linked(spark, imports, files) == links_by_hand(imports, files)
    assert linked(spark, imports, files, 50) == links_by_hand(imports, files, 50)


def test_links_leave_out_the_own_repo_only(spark):
    # the first repos have more files than are asked for, and each repo imports the module
    imports = [(repo, "use core/graph") for repo in "abcdez"] + [(None, "use core/graph")]
    files = [(repo, f"{p}/core/graph{i}.rs") for p, repo, n in (("x", "a", 9), ("y", "b", 2), ("w", "c", 9), ("x", "d", 1), ("v", "e", 9)) for i in range(n)] + [(None, "a/core/graph.rs"), ("b", "a/core/graph.rs")]
    for k in (1, 2, 5, 12):
        want = [x for x in links_by_hand([(r or "none", b) for r, b in imports], files, k) if imports[x[0]][0]]
        assert linked(spark, imports, files, k) == want


def test_parts_of_paths_are_never_broadcast(spark):
    entities = spark.createDataFrame([(i, "import_decl", "r", f"use {'part/' * (i % 3)}m{i}") for i in range(60)], "id long, node_table string, repo string, body string")
    files = spark.createDataFrame([("s", f"src/part/m{i}.rs") for i in range(300)], "repo string, path string")
    sent = []
    cut = resolve.Cutter.cut if hasattr(resolve, "Cutter") else None

    def seen(df):
        df.collect()
        lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                sent.append("\n".join(lines[i:end]))

    with pytest.MonkeyPatch.context() as m:
        if cut:
            m.setattr(resolve.Cutter, "cut", lambda self, df: (seen(df), cut(self, df))[1])
        seen(resolve.link_repos(entities, files))
    assert sent and not any("Generate" in x for x in sent)


CALL = "src string, dst string, repo string, line int, raw_callee string"
FN = "id string, node_table string, name string, repo string"


def test_lost_calls_stay_in_their_repo(spark):
    entities = spark.createDataFrame([("f:a1", "function", "load", "a"), ("f:b1", "function", "load", "b"), ("f:b2", "function", "load", "b"), ("f:b3", "function", "only_b", "b"), ("c:a", "class", "Kind", "a")], FN)
    calls = spark.createDataFrame([("s1", "x_load", "b", 1, "load"), ("s2", "x_load", "a", 2, "load"), ("s3", "x_only_b", "a", 3, "only_b"), ("s4", "b_x_load", "b", 4, ""), ("s5", "b_x_load", "b", 5, None), ("s6", "f:a1", "a", 6, "load"), ("s7", "x_Kind", "a", 7, "Kind"), ("s8", "x_load", None, 8, "load")], CALL)
    got = {r["src"]: (r["old_dst"], r["line"], r["dst"], r["resolved"]) for r in resolve.resolve_calls(entities, calls).collect()}
    assert got == {"s1": ("x_load", 1, "f:b1", True), "s2": ("x_load", 2, "f:a1", True), "s3": ("x_only_b", 3, "x_only_b", False), "s4": ("b_x_load", 4, "f:b1", True), "s5": ("b_x_load", 5, "f:b1", True), "s7": ("x_Kind", 7, "x_Kind", False), "s8": ("x_load", 8, "x_load", False)}


def test_proposals_are_all_pairs_of_a_repo(spark):
    w = lambda *n: " ".join(f"word{i}" for i in n)
    texts = [("r", "problem", w(*range(10))), ("s", "solution", w(*range(10))), ("s", "problem", w(*range(8), 20)), ("s", "decision", w(*range(5), 21, 22)), ("r", "solution", w(*range(6), 23)), ("t", "solution", w(*range(10))), ("t", "claim", w(*range(4), 24)), ("t", "decision", w(*range(5), 25)), ("t", "problem", w(30, 31)), ("r", "note", "")]
    e = spark.createDataFrame([(i, "", t, kind, repo) for i, (repo, kind, t) in enumerate(texts)], "id long, title string, content string, kind string, repo string")
    bag = [set(t.split()) for _, _, t in texts]
    score = lambda i, j: len(bag[i] & bag[j]) / len(bag[i] | bag[j])
    kept = [j for j, (repo, _, _) in enumerate(texts) if bag[j] and not any(texts[i][0] == repo and bag[i] and score(i, j) >= 0.7 for i in range(j))]
    fixed = {("solution", "problem"): "solves_for", ("decision", "problem"): "decided_about", ("decision", "claim"): "decided_about"}
    want = set()
    for i in kept:
        for j in kept:
            x, y = texts[i][1], texts[j][1]
            if x != y and texts[i][0] == texts[j][0] and score(i, j) >= 0.3 and (y, x) not in fixed and (x, y) != ("problem", "solution"):
                if relation := fixed.get((x, y)) or ("related_to" if score(i, j) >= 0.4 else None):
                    want.add((i, j, relation, round(score(i, j), 6)))
    assert len(kept) == 8 and want
    assert {tuple(r) for r in knowledge.proposals(e).collect()} == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_two_stage_recall(spark, folder):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.cosine_topk(v, vectors.queries_of(v)).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in catalog.QUERIES["semantic_two_stage"](spark, f"/root/testdata/{folder}").collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_overrides_reach_the_first_of_their_name(spark):
    f = spark.createDataFrame([("f:a", "run", "q", "@Override run()", None), ("f:b", "run", "q", "run()", None), ("f:c", "run", "q", None, "@Override\npublic void run() {}"), ("f:d", "go", "q", "override go()", None), ("f:e", None, "q", "override", None)], "id string, name string, qualified_name string, signature string, body string")
    assert {tuple(r) for r in resolve.virtual_dispatch(f).collect()} == {("f:a", "f:b"), ("f:a", "f:c"), ("f:c", "f:a"), ("f:c", "f:b")}
    assert {tuple(r) for r in resolve.virtual_dispatch(f, 1).collect()} == {("f:a", "f:b"), ("f:c", "f:a")}


def test_a_solution_takes_the_last_problem_before_it(spark):
    turns = [("user", "The problem is that the build is still failing here."), ("assistant", "I've updated the flag and the fix is in place now."), ("assistant", "The solution was to raise the limit of the queue."), ("user", "root cause: the cache is stale, error: not found"), ("assistant", "Fixed by clearing the cache before each run."), ("assistant", "We looked around and saw nothing.")]
    t = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)] + [(2, 0, "assistant", "The fix is a new flag for the parser.")], "conv_id int, line int, role string, text string")
    got = {(r["conv_id"], r["line"]): r["problem_line"] for r in conversation.preceding_problem(conversation.segments(t)).collect()}
    assert got == {(1, 1): 0, (1, 2): 0, (1, 4): 3, (2, 0): None}


@pytest.mark.parametrize("width", [100_000, 3])
def test_the_last_row_before_over_slices(spark, monkeypatch, width):
    from strandwork.operators import history

    monkeypatch.setattr(history, "SLICE", width)
    rows = [(k, i, (i * 7 + k) % 3 == 0, (i * 5 + k) % 11 == 0) for k in range(3) for i in range(60)]
    want = {(k, i): max((j for q, j, _, r in rows if q == k and r and j < i), default=None) for k, i, left, _ in rows if left}
    df = spark.createDataFrame(rows, "key int, at int, l boolean, r boolean")
    assert {(r["key"], r["at"]): r["before"] for r in history.last_before(df, "key", "at", "l", "r").collect()} == want


def shuffled(spark):
    """Bytes written to shuffles so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("block, n", [(2_000, 600), (7, 60)])
def test_pairs_of_common_names_are_not_shuffled(spark, monkeypatch, block, n):
    monkeypatch.setattr(conversation, "BLOCK", block, raising=False)
    # 70 common names fill more than one long; the others are in few sessions
    mentions = [(s, f"all{k}") for s in range(n) for k in range(70) if (s * s + k * 13) % 97 < 25] + [(s, f"own{s // 2}") for s in range(n)] + [(s, f"more{s % 50}") for s in range(0, n, 3)] + [(n, "own7"), (n + 1, "own7")]
    df = spark.createDataFrame(mentions, "session long, name string")
    before, got = shuffled(spark), len(conversation.co_discussed(df).collect())
    assert n < 600 or shuffled(spark) - before < 5 * got, (shuffled(spark) - before, got)
    assert n > 60 or links_of(spark, mentions, "session long, name string") == pairs_of(mentions)


def test_copies_of_classes_do_not_grow_with_the_classes(spark, monkeypatch):
    monkeypatch.setattr(conversation, "BLOCK", 16)
    moved = []
    for n in (320, 640):
        df = spark.createDataFrame([(s, f"all{k}") for s in range(n) for k in range(12) if (s + 1) >> k & 1], "session long, name string")
        before, got = shuffled(spark), conversation.co_discussed(df).count()
        moved.append(shuffled(spark) - before)
        assert got == sum(x & y != 0 for x, y in combinations(range(1, n + 1), 2))
    assert moved[1] < 2.5 * moved[0], moved


def test_links_are_made_where_entries_meet_and_not_shuffled(spark):
    import random

    own = random.Random(3)
    kinds = ("solution", "problem", "decision", "claim", None)
    # every two entries share about half of their words, some with words that are no bits of their own
    bag = [{f"word{k}" for k in own.sample(range(45), 30)} | {f"rare{i % 70}", f"one{i}"} for i in range(400)]
    e = spark.createDataFrame([(i, "", " ".join(sorted(b)), kinds[i % 5], "r") for i, b in enumerate(bag)], "id long, title string, content string, kind string, repo string")
    score = lambda i, j: len(bag[i] & bag[j]) / len(bag[i] | bag[j])
    kept = [j for j in range(400) if not any(score(i, j) >= 0.7 for i in range(j))]
    said = {(0, 1): "solves_for", (2, 1): "decided_about", (2, 3): "decided_about"}
    want = {(i, j, said.get((i % 5, j % 5), "related_to"), round(score(i, j), 6)) for i in kept for j in kept if i % 5 != j % 5 and (j % 5, i % 5) not in said and score(i, j) >= (0.3 if (i % 5, j % 5) in said else 0.4)}
    before = shuffled(spark)
    got = [tuple(r) for r in knowledge.proposals(e).collect()]
    moved = shuffled(spark) - before
    assert len(got) == len(want) > 50_000 and set(got) == want
    assert moved < 8 * len(got), moved


def test_ends_of_links_are_those_of_the_links(spark):
    kinds = ("solution", "problem", "decision", "claim", None)
    e = spark.createDataFrame([(i, "", " ".join(f"word{(i * k * k + k) % 31}" for k in range(1, 12)), kinds[i % 5], f"r{i % 3}") for i in range(60)], "id long, title string, content string, kind string, repo string")
    links = [tuple(r)[:3] for r in knowledge.proposals(e).collect()]
    want = {(a, r, True) for a, _, r in links} | {(b, r, False) for _, b, r in links}
    got = [tuple(r) for r in knowledge.linked(e).collect()]
    assert len(got) == len(want) > 0 and set(got) == want


@pytest.mark.parametrize("least, most", [(1, 12), (20, 60), (60, 140), (150, 300)])
def test_signatures_leave_all_similar_pairs(monkeypatch, least, most):
    import random

    import numpy as np

    own = random.Random(most)
    monkeypatch.setattr(blocks, "STRIP", (8, 32))
    bags = [frozenset(own.sample(range(3_000), own.randint(least, most))) for _ in range(200)]
    # copies that lose some words and gain others
    bags += [frozenset([w for w in b if own.random() < 0.9] + own.sample(range(3_000), len(b) // 12)) or b for b in bags for _ in range(2)]
    bits = np.zeros((len(bags), blocks.PARITY), bool)
    for i, b in enumerate(bags):
        for w in b:
            bits[i, w * 7919 % 10_007 % blocks.PARITY] ^= True
    sign = np.packbits(bits, axis=1).view(np.uint64)
    n, total = np.array([len(b) for b in bags], np.int32), np.array([sum(w % 3 - 1 for w in b) for b in bags], np.int32)
    side = lambda lo, hi, strip: blocks.Signed(sign[lo:hi], n[lo:hi], total[lo:hi], strip)
    similar = {(i, j) for i, j in combinations(range(len(bags)), 2) if len(bags[i] & bags[j]) >= 0.7 * len(bags[i] | bags[j])}
    got = [(min(x), max(x)) for p, q in blocks.near(side(0, 600, 8), None, 0.7) for x in zip(p.tolist(), q.tolist(), strict=True)]
    assert len(similar) > 100 and similar <= set(got) and len(got) == len(set(got))
    two = [(x, y + 250) for p, q in blocks.near(side(0, 250, 8), side(250, 600, 32), 0.7) for x, y in zip(p.tolist(), q.tolist(), strict=True)]
    assert set(two) == {(i, j) for i, j in got if i < 250 <= j} and len(two) == len(set(two))


def test_bags_are_made_once_and_empty_ones_left_out(spark):
    texts = ["", None, "the and", "alpha beta gamma delta", "delta gamma beta ALPHA", "alpha beta gamma epsilon delta", "zeta"]
    e = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id long, title string, content string")
    plan = knowledge.numbered(knowledge.bags(e), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted(tuple(r) for r in knowledge.duplicate_of(e).collect()) == [(3, None, 1), (4, 3, 1), (5, 3, 1), (6, None, 0)]
