"""Joins over edges and traversals: callers, callees, impact, type hierarchy, references, clusters.

Edges join their ends by id.  Traversals keep a frontier per hop, drop what was seen
with an anti join, and stop at the asked depth, so a plan has as many joins as hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import folder
from ..plans.bind import named
from ..plans.cut import Cutter, broadcast_if_small
from .search import SYMBOL


def _few(names: DataFrame) -> DataFrame:
    """A frame of asked names, broadcast where its counted size allows."""
    return broadcast_if_small(names, 256)


def _ends(edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges joined with both ends, columns s_… and d_…."""
    return edges.join(named(dst, "d_"), F.col("dst") == F.col("d_id")).join(named(src, "s_"), F.col("src") == F.col("s_id"))


def callers(functions: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct functions that call a function of one of ``names(name)``, with the name called."""
    hit = calls.join(functions.select(F.col("id").alias("dst"), F.col("name").alias("called")), "dst").join(_few(names.select(F.col("name").alias("called"))), "called", "left_semi")
    return hit.select("called", "src").distinct().join(functions.select(F.col("id").alias("src"), *SYMBOL), "src").where(F.col("name").isNotNull()).select("called", F.col("src").alias("id"), *SYMBOL)


def callees(functions: DataFrame, calls: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct functions that a function of one of ``names(name)`` calls, with the name of the caller."""
    hit = calls.join(functions.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src").join(_few(names.select(F.col("name").alias("caller"))), "caller", "left_semi")
    return hit.select("caller", "dst").distinct().join(functions.select(F.col("id").alias("dst"), *SYMBOL), "dst").where(F.col("name").isNotNull()).select("caller", F.col("dst").alias("id"), *SYMBOL)


def explore(entities: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(section, id, name, file_path): what surrounds the symbols of a name: itself, callers, callees, siblings, supertypes, subtypes, links.

    Where several tables have the name, the first of function, class, skill, config,
    api, package, file counts.
    """
    order = F.array_position(F.array(*map(F.lit, ("function", "class", "skill", "config", "api", "package", "file"))), F.col("node_table"))
    e = entities.select("id", "name", "node_table", "file_path")
    all_roots = e.join(_few(names), "name", "left_semi").withColumn("rank", order).where(F.col("rank") > 0)
    best = all_roots.groupBy("name").agg(F.min("rank").alias("best"))
    roots = all_roots.join(_few(best), "name").where(F.col("rank") == F.col("best")).select("id", "name", "node_table", "file_path")
    r = roots.select(F.col("id").alias("root"), F.col("file_path").alias("root_file"))
    far = e.select(F.col("id").alias("far"), "name", "file_path")

    def side(section: str, rel: str, at: str, other: str) -> DataFrame:
        hit = edges.where(F.col("rel") == rel).join(r, F.col(at) == F.col("root")).select(F.col(other).alias("far")).distinct()
        return hit.join(far, "far").select(F.lit(section).alias("section"), F.col("far").alias("id"), "name", "file_path")

    siblings = e.where(F.col("node_table").isin("function", "class")).join(r.select(F.col("root_file").alias("file_path")).distinct(), "file_path", "left_semi").join(r, F.col("id") == F.col("root"), "left_anti")
    parts = [
        roots.select(F.lit("self").alias("section"), "id", "name", "file_path"),
        side("called_by", "calls", "dst", "src"),
        side("calls_to", "calls", "src", "dst"),
        siblings.select(F.lit("siblings").alias("section"), "id", "name", "file_path"),
        *(side(f"{rel}_{way}", rel, at, other) for rel in ("inherits", "implements", "links_to") for way, at, other in (("to", "src", "dst"), ("from", "dst", "src"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def external_callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, name, file_path, n_external, callers): each function with its distinct callers from other files."""
    f = functions.select("id", "name", "file_path")
    both = _ends(calls.select("src", "dst").distinct(), f, f).where(F.col("s_file_path") != F.col("d_file_path"))
    got = both.groupBy("dst").agg(F.countDistinct("s_name").alias("n_external"))
    return f.join(got, F.col("id") == F.col("dst"), "left").select("id", "name", "file_path", F.coalesce("n_external", F.lit(0).cast("long")).alias("n_external"))


def cross_file_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, direction, n): calls into and out of each file from and to other files."""
    f = functions.select("id", "file_path")
    both = _ends(calls.select("src", "dst"), f, f).where(F.col("s_file_path") != F.col("d_file_path"))
    two = both.select(F.explode(F.array(F.struct(F.col("d_file_path").alias("file_path"), F.lit("in").alias("direction")), F.struct(F.col("s_file_path").alias("file_path"), F.lit("out").alias("direction")))).alias("x")).select("x.*")
    return two.groupBy("file_path", "direction").agg(F.count(F.lit(1)).alias("n"))


def endpoint_callers(entities: DataFrame, edges: DataFrame, pattern: str = "") -> DataFrame:
    """Who calls endpoints whose name contains the pattern."""
    e = entities.select("id", "name", "file_path")
    calls = edges.where(F.col("rel") == "calls_endpoint").select("src", "dst", "method")
    return _ends(calls, e, e).where(F.lower("d_name").contains(pattern.lower())).select(F.col("s_name").alias("caller"), F.col("s_file_path").alias("file_path"), F.col("d_name").alias("endpoint"), "method").distinct()


def backlinks(entities: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(section, id, name): callers, importers, containers, dependents and linking notes of the symbols of a name."""
    e = entities.select("id", "name", "node_table", "body")
    target = e.join(_few(names), "name", "left_semi").select(F.col("id").alias("dst"))
    names_of = {"calls": "callers", "contains": "containers", "depends_on_package": "dependents", "links_to": "wikilinks", "inherits": "subtypes", "implements": "implementors"}
    rows = edges.where(F.col("rel").isin(*names_of)).join(target, "dst", "left_semi").select("rel", "src").distinct()
    section = F.create_map(*(F.lit(x) for kv in names_of.items() for x in kv))[F.col("rel")]
    linked = rows.join(e.select(F.col("id").alias("src"), "name"), "src").select(section.alias("section"), F.col("src").alias("id"), "name")
    wanted = _few(names.select(F.col("name").alias("wanted")))
    # a contains condition has no key: the asked names are few, and meet every import once
    importers = e.where(F.col("node_table") == "import_decl").join(wanted, F.col("body").contains(F.col("wanted"))).select(F.lit("importers").alias("section"), "id", "name").distinct()
    return linked.unionByName(importers)


def references(entities: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(section, id, n): definitions, call sites and imports of a name."""
    e = entities.select("id", "name", "node_table", "body")
    wanted = _few(names.select(F.col("name").alias("wanted")))
    own = e.where(F.col("node_table").isin("function", "class")).join(wanted, F.col("name") == F.col("wanted"))
    defs = own.select(F.lit("definition").alias("section"), "id", F.lit(1).cast("long").alias("n"))
    sites = edges.where(F.col("rel") == "calls").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("call").alias("section"), "id", "n")
    imports = e.where(F.col("node_table") == "import_decl").join(wanted, F.col("body").contains(F.col("wanted"))).groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("import").alias("section"), "id", "n")
    return defs.unionByName(sites).unionByName(imports)


def safe_delete(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, definitions, callers, importers, safe) of every function name: safe to delete where nothing calls or imports it.

    An import names a symbol when the name is one of its words, so names and imports meet on words.
    """
    f = entities.where(F.col("node_table") == "function").select("id", "name").where(F.col("name").isNotNull())
    n_calls = calls.select("src", "dst").distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("c"))
    defs = f.join(n_calls, F.col("id") == F.col("dst"), "left").groupBy("name").agg(F.count(F.lit(1)).alias("definitions"), F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("callers"))
    words = entities.where(F.col("node_table") == "import_decl").select("id", F.explode(F.array_distinct(F.split("body", r"[^A-Za-z0-9_]+"))).alias("name"))
    imported = words.groupBy("name").agg(F.count(F.lit(1)).alias("importers"))
    out = defs.join(imported, "name", "left").withColumn("importers", F.coalesce("importers", F.lit(0).cast("long")))
    return out.withColumn("safe", (F.col("callers") == 0) & (F.col("importers") == 0))


def hops(calls: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(hop, n): distinct callers at each number of hops from ``start(id)``, without a seen-set, so a node counts at every number of hops that leads to it."""
    e = calls.select("src", "dst").distinct()
    front, out = start.select("id"), None
    for k in range(1, depth + 1):
        front = e.join(front.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        row = front.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("hop"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def impact(functions: DataFrame, calls: DataFrame, start: DataFrame, depth: int = 3, by: str = "id", per_hop: int | None = None) -> DataFrame:
    """(node, hop): what is reached against the calls from ``start(node)``, each at its first hop.

    ``by`` 'name' merges functions of one name, as names are what people ask for; 'id'
    keeps them apart.  ``per_hop`` keeps the first nodes of each hop in their order.
    """
    if by == "name":
        f = functions.select("id", "name").where(F.col("name").isNotNull())
        e = _ends(calls.select("src", "dst").distinct(), f, f).select(F.col("s_name").alias("src"), F.col("d_name").alias("dst")).distinct()
    else:
        e = calls.select("src", "dst").distinct()
    cutter = Cutter(calls.sparkSession, "impact")
    e = cutter.cut(e)
    front = start.select("node").distinct()
    out = cutter.cut(front.withColumn("hop", F.lit(0)))
    for k in range(1, depth + 1):
        new = e.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(out, "node", "left_anti")
        if per_hop is not None:
            new = new.orderBy("node").limit(per_hop)
        front = cutter.cut(new)
        out = out.unionByName(front.withColumn("hop", F.lit(k)))
    return out.where(F.col("hop") > 0)


def type_hierarchy(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(id, direction, relative, level): supertypes and subtypes of every class up to ``depth`` levels, each at its nearest."""
    cutter = Cutter(edges.sparkSession, "types")
    up = cutter.cut(edges.where(F.col("rel").isin("inherits", "implements") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    out = front = cutter.cut(up.select(F.col("src").alias("id"), F.col("dst").alias("relative"), F.lit(1).alias("level")))
    for k in range(2, depth + 1):
        new = front.join(up, F.col("relative") == F.col("src")).select("id", F.col("dst").alias("relative")).distinct().where(F.col("id") != F.col("relative")).join(out, ["id", "relative"], "left_anti")
        front = cutter.cut(new.withColumn("level", F.lit(k)))
        out = out.unionByName(front)
    parents = out.select("id", F.lit("up").alias("direction"), "relative", "level")
    return parents.unionByName(out.select(F.col("relative").alias("id"), F.lit("down").alias("direction"), F.col("id").alias("relative"), "level"))


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(id)``."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def folder_clusters(entities: DataFrame, edges: DataFrame, more_than: int = 10, depth: int = 2) -> DataFrame:
    """(src, dst): edges after folders with more than ``more_than`` members are drawn as one node; no self-loops, each once.

    Files and symbols whose path has less than two segments stay themselves.
    """
    can = (F.col("node_table") != "file") & F.col("file_path").contains("/")
    place = F.concat(F.coalesce("repo", F.lit("")), F.lit(":"), folder(F.col("file_path"), depth))
    n = entities.select("id", F.when(can, place).alias("cluster"))
    big = n.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("cluster", F.lit(True).alias("big"))
    node = n.join(big, "cluster", "left").select("id", F.when(F.col("big"), F.concat(F.lit("cluster:"), F.col("cluster"))).otherwise(F.col("id")).alias("node"))
    both = edges.select("src", "dst").join(node.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(node.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst")
    return both.where(F.col("a") != F.col("b")).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def two_cycles(pairs: DataFrame) -> DataFrame:
    """(a, b), a before b: nodes of ``pairs(src, dst)`` that point at each other."""
    p = pairs.select("src", "dst").where(F.col("src") < F.col("dst")).distinct()
    q = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where(F.col("src") < F.col("dst")).distinct()
    return p.join(q, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def siblings(entities: DataFrame, start: DataFrame, k: int = 15) -> DataFrame:
    """(root, id, name): up to ``k`` other functions and classes of the file of each of ``start(id)``, by id."""
    e = entities.where(F.col("node_table").isin("function", "class")).select("id", "name", "repo", "file_path")
    roots = e.join(_few(start.select("id")), "id", "left_semi").select(F.col("id").alias("root"), "repo", "file_path")
    return first_per(e.join(_few(roots), ["repo", "file_path"]).where(F.col("id") != F.col("root")).select("root", "id", "name"), ["root"], [F.col("id")], k)


def overview(entities: DataFrame, edges: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nodes with the most edges, (id, name, degree), and the edges between them, (src, dst, rel)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    top = ends.join(entities.select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(k).select("id", "name", "degree")
    t = F.broadcast(top.select("id"))  # k rows
    return top, edges.select("src", "dst", "rel").join(t.withColumnRenamed("id", "src"), "src", "left_semi").join(t.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel").distinct()


def centered(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst, rel): the edges that touch ``start(id)``."""
    s = start.select("id")
    e = edges.select("src", "dst", "rel")
    out = e.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "rel")
    return out.unionByName(e.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel")).distinct()


def skill_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between notes with the line they stand in; targets that have no note keep their id."""
    e = entities.select("id", "name")
    links = edges.where(F.col("rel") == "links_to").select("src", "dst", "context").distinct()
    return links.join(named(e, "s_"), F.col("src") == F.col("s_id")).join(named(e, "d_"), F.col("dst") == F.col("d_id"), "left").select(F.col("s_name").alias("note"), F.coalesce("d_name", "dst").alias("target"), "context", "src", "dst")


def traverse_skills(entities: DataFrame, edges: DataFrame, pattern: str, detail: int = 4) -> DataFrame:
    """(section, id, text) of the first note whose name contains the pattern: itself, its links, its sections, its body, as detail grows."""
    notes = entities.where(F.col("node_table") == "skill").select("id", "name", "body")
    root = notes.where(F.lower("name").contains(pattern.lower())).orderBy("id").limit(1)
    r = root.select(F.col("id").alias("src"))
    out = root.select(F.lit("note").alias("section"), "id", F.col("name").alias("text"))
    if detail >= 2:
        out = out.unionByName(edges.where(F.col("rel") == "links_to").join(F.broadcast(r), "src").select(F.lit("link").alias("section"), F.col("dst").alias("id"), F.col("context").alias("text")).distinct())
    if detail >= 3:
        out = out.unionByName(edges.where(F.col("rel") == "contains").join(F.broadcast(r), "src").select(F.lit("part").alias("section"), F.col("dst").alias("id"), F.lit(None).cast("string").alias("text")).distinct())
    if detail >= 4:
        out = out.unionByName(root.select(F.lit("body").alias("section"), "id", F.col("body").alias("text")))
    return out


def first_per(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; slices are ranked before they meet, so a hot key is never one task's rows."""
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    near = sliced.withColumn("r", F.row_number().over(Window.partitionBy(*key, "slice").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("r") <= k).drop("slice", "r")
