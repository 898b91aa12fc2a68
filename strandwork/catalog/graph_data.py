"""Queries over the tables of the code graph for the operators on hierarchies, sessions and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as h
from ..operators import orphans as o
from ..operators import sessions as s
from ..plans.load import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return h.contains_edges(table(spark, d, "code_edges"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return o.orphans(o.references(table(spark, d, "code_edges")), o.records(table(spark, d, "code_entities")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return h.hierarchy(_links(spark, d), path=False).select("entity_id", "root_id", "depth")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = h.with_counts(h.hierarchy(_links(spark, d)))
    return tree.select("entity_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return h.descendants(h.hierarchy(_links(spark, d)))


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    return h.loops(_links(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return s.sessions(table(spark, d, "insight_events"), kinds=False)


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = s.sessions(table(spark, d, "insight_events"))
    of = lambda k: F.coalesce(F.try_element_at("kinds", F.lit(k)), F.lit(0).cast("long"))
    return out.select("stream", "started_at", "ended_at", "duration_s", "n_events", of("tool_call").alias("n_tool_call"), of("file_edit").alias("n_file_edit"), of("error").alias("n_error"), of("").alias("n_other"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "status")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return o.report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p2_loops, p3_found, p3_sessions, p6_found, p6_report)}

_TREE = """
WITH RECURSIVE up AS (
  SELECT to_entity AS child, min(from_entity) AS parent FROM code_edges
  WHERE lower(kind) = 'contains' AND from_entity <> '' AND to_entity <> '' GROUP BY 1),
ids AS (SELECT child AS id FROM up UNION SELECT parent FROM up),
tree AS (
  SELECT id AS entity_id, id AS root_id, 0 AS depth, id AS path FROM ids WHERE id NOT IN (SELECT child FROM up)
  UNION ALL
  SELECT up.child, t.root_id, t.depth + 1, t.path || ' > ' || up.child FROM tree t JOIN up ON up.parent = t.entity_id)
"""
_PAIRS = """
pairs AS (
  SELECT parent AS ancestor_id, child AS descendant_id, 1 AS distance FROM up JOIN tree ON tree.entity_id = child
  UNION ALL
  SELECT up.parent, p.descendant_id, p.distance + 1 FROM pairs p JOIN up ON up.child = p.ancestor_id)
"""
_LOOPS = """
WITH RECURSIVE up AS (
  SELECT to_entity AS child, min(from_entity) AS parent FROM code_edges
  WHERE lower(kind) = 'contains' AND from_entity <> '' AND to_entity <> '' GROUP BY 1),
tree AS (
  SELECT DISTINCT parent AS id FROM up WHERE parent NOT IN (SELECT child FROM up)
  UNION ALL
  SELECT up.child FROM tree t JOIN up ON up.parent = t.id),
lost AS (SELECT child, parent FROM up WHERE child NOT IN (SELECT id FROM tree)),
reach AS (
  SELECT child AS node, parent AS seen FROM lost
  UNION
  SELECT r.node, l.parent FROM reach r JOIN lost l ON l.child = r.seen),
ring AS (SELECT node FROM reach WHERE node = seen)
SELECT r.node AS entity_id, min(r.seen) AS loop_id, r.node IN (SELECT node FROM ring) AS on_loop
FROM reach r WHERE r.seen IN (SELECT node FROM ring) GROUP BY r.node
"""
_EVENTS = """
WITH e AS (
  SELECT DISTINCT ts, repo, kind, session_id, detail FROM insight_events WHERE ts <> 0),
s AS (
  SELECT CASE WHEN coalesce(session_id, '') <> '' THEN session_id ELSE 'legacy/' || coalesce(repo, '') END AS stream,
         CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS sec, coalesce(kind, '') AS kind FROM e),
g AS (
  SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY stream ORDER BY sec) <= 1800 THEN 0 ELSE 1 END AS first FROM s),
n AS (SELECT *, sum(first) OVER (PARTITION BY stream ORDER BY sec ROWS UNBOUNDED PRECEDING) AS session FROM g)
"""
_ORPHANS = """
WITH refs AS (
  SELECT edge_id, to_table, indexed_at, CASE WHEN coalesce(to_entity, '') <> '' THEN to_entity
         WHEN coalesce(to_table, '') <> '' AND coalesce(raw_target, '') <> '' THEN to_table || ':' || raw_target END AS key FROM code_edges),
recs AS (
  SELECT id, min(indexed_at) AS born, max_by(coalesce(is_deleted, false), indexed_at) AS gone FROM code_entities GROUP BY id),
found AS (
  SELECT edge_id, to_table, indexed_at, CASE WHEN id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN indexed_at < born THEN 'late' END AS status
  FROM refs LEFT JOIN recs ON key = id WHERE key IS NOT NULL)
"""
ORACLE = {
    "p2_found": _TREE + "SELECT ids.id AS entity_id, coalesce(root_id, '') AS root_id, coalesce(depth, -1)::INTEGER AS depth FROM ids LEFT JOIN tree ON entity_id = ids.id",
    "p2_hierarchy": _TREE.rstrip() + "," + _PAIRS + "SELECT ids.id AS entity_id, coalesce(root_id, '') AS root_id, coalesce(depth, -1)::INTEGER AS depth, path, coalesce(n, 0) AS n_descendants FROM ids LEFT JOIN tree ON entity_id = ids.id LEFT JOIN (SELECT ancestor_id, count(*) AS n FROM pairs GROUP BY 1) ON ancestor_id = ids.id",
    "p2_descendants": _TREE.rstrip() + "," + _PAIRS + "SELECT ancestor_id, descendant_id, distance::INTEGER AS distance FROM pairs",
    "p2_loops": _LOOPS,
    "p3_found": _EVENTS + "SELECT stream, min(sec) AS started_at, max(sec) AS ended_at FROM n GROUP BY stream, session",
    "p3_sessions": _EVENTS
    + "SELECT stream, min(sec) AS started_at, max(sec) AS ended_at, max(sec) - min(sec) AS duration_s, count(*) AS n_events, count(*) FILTER (kind = 'tool_call') AS n_tool_call, count(*) FILTER (kind = 'file_edit') AS n_file_edit, count(*) FILTER (kind = 'error') AS n_error, count(*) FILTER (kind = '') AS n_other FROM n GROUP BY stream, session",
    "p6_found": _ORPHANS + "SELECT edge_id, status FROM found WHERE status IS NOT NULL",
    "p6_report": _ORPHANS + "SELECT coalesce(to_table, '') AS to_table, coalesce(strftime(indexed_at, '%Y-%m'), '') AS month, status, count(*) AS n FROM found WHERE status IS NOT NULL GROUP BY ALL",
}
