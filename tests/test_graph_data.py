"""Hierarchies, sessions and orphan references against plain Python, and on awkward tables."""

import random
from collections import Counter
from datetime import datetime, timedelta

from strandwork.operators import hierarchy as h
from strandwork.operators import orphans as o
from strandwork.operators import sessions as s

LINK = "parent string, child string"


def _walk(parent: dict[str, str], node: str):
    seen, at = [], node
    while at in parent:
        seen.append(at)
        at = parent[at]
        if at in seen:
            return None
    return [at, *reversed(seen)]


def test_hierarchy_matches_walking_up(spark):
    rng = random.Random(5)
    parent = {f"n{i}": f"n{rng.randrange(max(0, i - 3), i)}" for i in range(1, 120)}
    parent |= {"a": "b", "b": "c", "c": "a", "below": "c", "lower": "below", "self": "self"}
    parent |= {f"leaf{i}": "n0" for i in range(60)}  # a hot parent
    rows = [(p, c) for c, p in parent.items()]
    rows += rows[:20] + [(None, "x"), ("x", None), ("", "y"), ("y", "")]
    links = spark.createDataFrame(rows, LINK)
    got = {r["entity_id"]: r for r in h.hierarchy(links).collect()}
    ids = set(parent) | set(parent.values())
    assert set(got) == ids
    for i in ids:
        path = _walk(parent, i)
        assert (got[i]["root_id"], got[i]["depth"], got[i]["path"]) == ((path[0], len(path) - 1, path) if path else ("", -1, None))
    loops = {r["entity_id"]: (r["loop_id"], r["on_loop"]) for r in h.loops(links).collect()}
    assert loops == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "below": ("a", False), "lower": ("a", False), "self": ("self", True)}
    pairs = {(r["ancestor_id"], r["descendant_id"]): r["distance"] for r in h.descendants(h.hierarchy(links)).collect()}
    want = {(a, i): len(p) - 1 - k for i in ids if (p := _walk(parent, i)) for k, a in enumerate(p[:-1])}
    assert pairs == want


def test_hierarchy_of_nothing_and_clashing_columns(spark):
    assert h.hierarchy(spark.createDataFrame([], LINK)).count() == 0
    assert h.loops(spark.createDataFrame([], LINK)).count() == 0
    odd = spark.createDataFrame([("r", "c", 1, 2, "x")], LINK + ", node int, depth int, entity_id string")
    assert {(r["entity_id"], r["depth"]) for r in h.hierarchy(odd).collect()} == {("r", 0), ("c", 1)}


def test_deep_chain(spark):
    links = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(300)], LINK)
    depth = {r["entity_id"]: r["depth"] for r in h.hierarchy(links, path=False).collect()}
    assert depth == {str(i): i for i in range(301)}


EVENT = "event_id long, ts long, repo string, kind string, session_id string, detail string, logged_at timestamp"


def test_sessions_match_a_sorted_scan(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        ts = rng.choice([None, 0]) if rng.random() < 0.03 else 1_612_000_000 + int(rng.expovariate(1 / 40_000))
        if ts and rng.random() < 0.1:
            ts = ts * 1000 + rng.randrange(1000)
        stream = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None])
        rows.append((i, ts, rng.choice(["r1", "r2", None]), rng.choice(["tool_call", "error", None]), stream, rng.choice(["d", None]), datetime(2021, 1, 1)))
    rows += [(10_000 + r[0], *r[1:]) for r in rows[:50]]  # written twice
    # exactly the gap, and one second more
    rows += [(20_000, 1_700_000_000, "r1", "error", "edge", None, None), (20_001, 1_700_001_800, "r1", "error", "edge", None, None), (20_002, 1_700_003_601, "r1", "error", "edge", None, None)]
    seen = {(r[1], r[2], r[3], r[4], r[5]) for r in rows if r[1]}
    streams: dict[str, list] = {}
    for ts, repo, kind, session, _ in seen:
        streams.setdefault(session or "legacy/" + (repo or ""), []).append((ts // 1000 if ts > 100_000_000_000 else ts, kind or ""))
    want = set()
    for k, v in streams.items():
        v.sort()
        run = [v[0]]
        for x in [*v[1:], (10**18, "")]:
            if x[0] - run[-1][0] > 1800:
                want.add((k, run[0][0], run[-1][0], len(run), tuple(sorted(Counter(y[1] for y in run).items()))))
                run = []
            run.append(x)
    events = spark.createDataFrame(rows, EVENT)
    got = {(r["stream"], r["started_at"], r["ended_at"], r["n_events"], tuple(sorted(r["kinds"].items()))) for r in s.sessions(events).collect()}
    assert got == want
    assert {(r["stream"], r["started_at"], r["ended_at"]) for r in s.sessions(events, kinds=False).collect()} == {w[:3] for w in want}


def test_sessions_of_nothing(spark):
    assert s.sessions(spark.createDataFrame([], EVENT)).count() == 0
    assert s.sessions(spark.createDataFrame([(1, None, None, None, None, None, None)], EVENT), kinds=False).count() == 0


EDGE = "edge_id long, to_entity string, to_table string, raw_target string, raw_callee string, indexed_at timestamp_ntz, key string"
RECORD = "id string, indexed_at timestamp_ntz, is_deleted boolean, code long"


def test_orphans_match_lookups(spark):
    rng = random.Random(9)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rng.randrange(200), seconds=rng.randrange(86_400))
    records = [(f"t:{rng.randrange(150)}", day(), rng.random() < 0.3 or None, 1) for _ in range(260)]
    records += records[:10] + [(None, day(), True, 1), ("", day(), False, 1)]
    edges = []
    for i in range(700):
        key = "t:7" if rng.random() < 0.3 else f"t:{rng.randrange(220)}"
        form = rng.random()
        to = (key, "t", None) if form < 0.7 else (rng.choice([None, ""]), "t", key[2:]) if form < 0.9 else (None, rng.choice([None, "", "t"]), rng.choice([None, ""]))
        edges.append((i, *to, None, None if rng.random() < 0.05 else day(), "clash"))
    edges += edges[:30]
    held: dict[str, list] = {}
    for k, at, gone, _ in records:
        if k:
            held.setdefault(k, []).append((at, bool(gone)))
    want = []
    for i, to, table, raw, _, at, _ in edges:
        key = to or (f"{table}:{raw}" if table and raw else None)
        if key is None:
            continue
        v = held.get(key)
        status = "missing" if not v else "deleted" if max(v)[1] else "late" if at and at < min(v)[0] else None
        if status:
            want.append((i, status))
    refs = o.references(spark.createDataFrame(edges, EDGE))
    found = o.orphans(refs, o.records(spark.createDataFrame(records, RECORD)))
    assert sorted((r["edge_id"], r["status"]) for r in found.collect()) == sorted(want)
    report = o.report(found).collect()
    assert sum(r["n"] for r in report) == len(want)


def test_orphans_of_nothing(spark):
    none_e, none_r = spark.createDataFrame([], EDGE), spark.createDataFrame([], RECORD)
    one = spark.createDataFrame([(1, "t:x", "t", None, None, datetime(2024, 1, 1), "k")], EDGE)
    assert o.orphans(o.references(none_e), o.records(none_r)).count() == 0
    assert [r["status"] for r in o.orphans(o.references(one), o.records(none_r)).collect()] == ["missing"]
