"""Parent-child links to full hierarchies by pointer doubling.

Each inner node holds a pointer to an ancestor and the number of steps to it.
A round joins the pointers with themselves, which doubles every jump, and stops
pointers that have met a root.  After round ``r`` all nodes of depth up to
``2**(r-1)`` are settled, so a round that settles none proves that the rest sit
on a cycle or below one.

Only nodes that are both a parent and a child take part; leaves, most of the
rows, join once at the end.  Pointers that met a root leave the joins.  A parent
with very many children is a hot key only of that last join, which has one row
for it on the other side and whose skewed partitions adaptive execution splits.

Defined results: rows with a null or empty end are ignored; repeated rows count
once; a child named by several parents keeps the smallest parent id; a self-link
is a cycle; an empty table gives no rows; columns beside the two ends are never
read, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter


def contains_edges(edges: DataFrame) -> DataFrame:
    """The ``contains`` rows of an edge table as (parent, child)."""
    return edges.where(F.lower("kind") == "contains").select(F.col("from_entity").alias("parent"), F.col("to_entity").alias("child"))


def _doubled(cutter: Cutter, inner: DataFrame, path: bool) -> DataFrame:
    """(node, anc, dist, done[, path]) of the inner nodes; what is not done never meets a root."""
    state = cutter.cut(inner.select("node", "anc", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done"), *([F.array("anc").alias("path")] if path else [])))
    left, settled = state.count(), []
    while left:
        # rows that a round settles stay in its step
        open_rows = state.where(~F.col("done"))
        t = reduce(DataFrame.unionByName, [*settled, open_rows]).select(F.col("node").alias("t_node"), F.col("anc").alias("t_anc"), F.col("dist").alias("t_dist"), F.col("done").alias("t_done"), *([F.col("path").alias("t_path")] if path else []))
        far = F.col("t_node").isNotNull()
        moved = open_rows.join(t, F.col("anc") == F.col("t_node"), "left").select(
            "node",
            F.when(far, F.col("t_anc")).otherwise(F.col("anc")).alias("anc"),
            F.when(far, F.col("dist") + F.col("t_dist")).otherwise(F.col("dist")).alias("dist"),
            F.when(far, F.col("t_done")).otherwise(F.lit(True)).alias("done"),
            *([F.when(far, F.concat("t_path", "path")).otherwise(F.col("path")).alias("path")] if path else []),
        )
        after = cutter.cut(moved)
        if not settled:
            cutter.drop(state)
        settled.append(after.where("done"))
        state, before = after, left
        left = state.where(~F.col("done")).count()
        if left == before:
            break
    return reduce(DataFrame.unionByName, [*settled, state.where(~F.col("done"))])


def hierarchy(links: DataFrame, path: bool = True) -> DataFrame:
    """(entity_id, root_id, depth, on_loop[, path]) of every id in ``links(parent, child)``.

    ``path`` runs from the root to the node.  A node on a cycle or below one has
    root '', depth -1 and a null path; ``loops`` tells the two apart.
    """
    cutter = Cutter(links.sparkSession, "hierarchy")
    ok = links.where((F.col("parent") != "") & (F.col("child") != ""))
    up = cutter.cut(ok.groupBy("child").agg(F.min("parent").alias("parent")))
    parents = up.select(F.col("parent").alias("p")).distinct()
    marked = cutter.cut(up.join(parents, F.col("child") == F.col("p"), "full").select("child", "parent", "p"))
    roots = marked.where(F.col("child").isNull()).select(F.col("p").alias("entity_id"))
    inner = _doubled(cutter, marked.where(F.col("child").isNotNull() & F.col("p").isNotNull()).select(F.col("child").alias("node"), F.col("parent").alias("anc")), path)
    leaves = marked.where(F.col("p").isNull()).select("child", "parent")

    def row(entity: Column, done: Column, root: Column, depth: Column, way: Column) -> list[Column]:
        return [
            entity.alias("entity_id"),
            F.when(done, root).otherwise(F.lit("")).alias("root_id"),
            F.when(done, depth).otherwise(F.lit(-1)).cast("int").alias("depth"),
            *([F.when(done, way).alias("path")] if path else []),
        ]

    none = F.lit(None).cast("array<string>")
    way = F.col("path") if path else none
    tops = roots.select(*row(F.col("entity_id"), F.lit(True), F.col("entity_id"), F.lit(0), F.array("entity_id")))
    mids = inner.select(*row(F.col("node"), F.col("done"), F.col("anc"), F.col("dist"), F.concat(way, F.array("node")) if path else none))
    ends = leaves.join(inner, F.col("parent") == F.col("node"), "left").select(
        *row(
            F.col("child"),
            F.coalesce(F.col("done"), F.lit(True)),
            F.coalesce(F.col("anc"), F.col("parent")),
            F.coalesce(F.col("dist"), F.lit(0)) + 1,
            F.concat(F.coalesce(way, F.array().cast("array<string>")), F.array("parent", "child")) if path else none,
        )
    )
    return tops.unionByName(mids).unionByName(ends)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every pair in the output of ``hierarchy``; a node is not its own descendant."""
    return (
        tree.where(F.col("depth") > 0)
        .select("entity_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where(F.col("at") < F.col("depth"))
        .select("ancestor_id", F.col("entity_id").alias("descendant_id"), (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def with_counts(tree: DataFrame) -> DataFrame:
    """``tree`` with ``n_descendants`` of each node (0 on and below cycles); partial counts are made before the shuffle."""
    n = descendants(tree).groupBy(F.col("ancestor_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return tree.join(n, "entity_id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0).cast("long")))


def loops(links: DataFrame) -> DataFrame:
    """(entity_id, loop_id, on_loop) of every node on a cycle or below one.

    ``loop_id`` is the smallest id on the cycle.  The unsettled pointers double on
    until a jump is at least as long as there are unsettled nodes; the targets of
    such jumps are exactly the nodes on cycles, and the smallest id that a jump
    passed over from a node on a cycle is its cycle's smallest.
    """
    cutter = Cutter(links.sparkSession, "loops")
    ok = links.where((F.col("parent") != "") & (F.col("child") != ""))
    up = cutter.cut(ok.groupBy("child").agg(F.min("parent").alias("parent")))
    lost = hierarchy(up.select("parent", "child"), path=False).where(F.col("depth") < 0).select(F.col("entity_id").alias("child"))
    state = cutter.cut(up.join(lost, "child", "left_semi").select(F.col("child").alias("node"), F.col("parent").alias("anc"), F.col("parent").alias("least")))
    n, jump = state.count(), 1
    while jump < n:
        t = state.select(F.col("node").alias("t_node"), F.col("anc").alias("t_anc"), F.col("least").alias("t_least"))
        after = cutter.cut(state.join(t, F.col("anc") == F.col("t_node")).select("node", F.col("t_anc").alias("anc"), F.least("least", "t_least").alias("least")))
        cutter.drop(state)
        state, jump = after, jump * 2
    on = state.select(F.col("anc").alias("on_node")).distinct()
    ring = state.join(on, F.col("node") == F.col("on_node"), "left_semi").select(F.col("node").alias("r_node"), F.col("least").alias("r_least"))
    return (
        state.join(ring.withColumnRenamed("r_node", "a_node").withColumnRenamed("r_least", "a_least"), F.col("anc") == F.col("a_node"))
        .join(ring.select(F.col("r_node")), F.col("node") == F.col("r_node"), "left")
        .select(F.col("node").alias("entity_id"), F.col("a_least").alias("loop_id"), F.col("r_node").isNotNull().alias("on_loop"))
    )
