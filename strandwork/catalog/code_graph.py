"""Queries over the code graph and their SQL.

Targets are chosen by the data: the most-called function name, ties by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import ask, census, graph, resolve, search, store
from ..plans.bind import Graph, size_of
from ..plans.load import spread
from ..sources import code
from ..sources.parsers import EXTENSIONS, LARGEST, skip_pattern

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_BASE = """
WITH RECURSIVE ents AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, row_id DESC) AS rn FROM code_entities)
  WHERE rn = 1 AND NOT coalesce(is_deleted, false)),
fn AS (SELECT * FROM ents WHERE node_table = 'function'),
edges AS (SELECT lower(kind) AS rel, from_entity AS src, to_entity AS dst, from_table AS src_table, to_table AS dst_table, repo, line, raw_callee, method, url_pattern, context
  FROM code_edges WHERE from_entity <> '' AND to_entity <> ''),
calls AS (SELECT src, dst, line FROM edges WHERE rel = 'calls'),
ucalls AS (SELECT DISTINCT src, dst FROM calls),
top_name AS (SELECT name FROM calls JOIN fn ON fn.id = dst GROUP BY name ORDER BY count(*) DESC, name LIMIT 1),
top_id AS (SELECT dst AS id FROM calls JOIN fn ON fn.id = dst GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
"""


#: The module of an import's body b.
_MODULE = "CASE WHEN regexp_matches(b, '^from\\s+[\\w.]+\\s+import\\b') THEN replace(regexp_extract(b, '^from\\s+([\\w.]+)\\s+import\\b', 1), '.', '/') WHEN regexp_matches(b, '\\bfrom\\s+[''\"][^''\"]+[''\"]') THEN regexp_replace(regexp_extract(b, '\\bfrom\\s+[''\"]([^''\"]+)[''\"]', 1), '^(\\.{1,2}/)+', '') WHEN regexp_matches(b, '^(pub\\s+)?use\\s+[^;\\s]+') THEN replace(regexp_extract(b, '^(?:pub\\s+)?use\\s+([^;\\s]+)', 1), '::', '/') ELSE '' END"


def _add(name: str, sql: str | None, ctes: str = "") -> Callable:
    def take(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            ORACLE[name] = _BASE + (ctes + ", " if ctes else "") + "nothing AS (SELECT 1)\n" + sql
        return f

    return take


def _top_name(g: Graph) -> DataFrame:
    """The most-called function name, one row that is asked for as a person would ask for it."""
    n = g.calls.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).join(g.functions("name").select(F.col("id").alias("dst"), "name"), "dst").where(F.col("name").isNotNull())
    top = n.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(1).collect()
    return g.spark.createDataFrame([(r["name"],) for r in top], "name string")


def _top_id(g: Graph) -> DataFrame:
    """The most-called function, one row."""
    top = census.fan(g.functions("name", "file_path"), g.calls, k=1, among=lambda ids: g.listed(ids, "name", "file_path")).collect()
    return g.spark.createDataFrame([(r["id"],) for r in top], "id string")


_SYMBOL = "name, qualified_name, file_path, start_line, end_line, signature, language"
_F = ("name", "file_path")
_SIZED = ("name", "file_path", "start_line", "end_line")


@_add("find_function_exact", f"SELECT id, {_SYMBOL} FROM fn WHERE name = 'parse_path'")
def _(g: Graph) -> DataFrame:
    return search.find_function(g.ever(F.col("name") == "parse_path", *search.SYMBOL, tables=("function",)), "parse_path")


@_add("search_functions_ci", f"SELECT id, {_SYMBOL} FROM fn WHERE contains(lower(name), 'parse')")
def _(g: Graph) -> DataFrame:
    return search.search_functions(g.functions(*search.SYMBOL), "PARSE")


@_add("search_fuzzy_ranked", "SELECT id, f.name, file_path, coalesce(n, 0) AS callers FROM fn f LEFT JOIN (SELECT name, count(*) AS n FROM calls JOIN fn ON fn.id = dst GROUP BY 1) c ON c.name = f.name WHERE contains(lower(f.name), 'parse') ORDER BY callers DESC, id LIMIT 50")
def _(g: Graph) -> DataFrame:
    return search.search_ranked(g.functions(*search.SYMBOL), g.calls, "parse")


@_add("file_entities", "SELECT id, node_table, kind, name, start_line, end_line FROM ents WHERE node_table IN ('function', 'class') AND file_path IN (SELECT min(file_path) FROM fn)")
def _(g: Graph) -> DataFrame:
    e = g.entities("node_table", "kind", "name", "start_line", "end_line", "file_path")
    path = e.where(F.col("node_table") == "function").agg(F.min("file_path").alias("p"))
    return e.join(F.broadcast(path), F.col("file_path") == F.col("p")).where(F.col("node_table").isin("function", "class")).select("id", "node_table", "kind", "name", "start_line", "end_line")


@_add("cross_search", "SELECT node_table, id, name, file_path FROM (SELECT *, row_number() OVER (PARTITION BY node_table ORDER BY id) AS r FROM ents WHERE contains(lower(name), 'edge')) WHERE r <= 20")
def _(g: Graph) -> DataFrame:
    return search.cross_search(g.entities("node_table", "name", "file_path"), "edge")


@_add("http_calls", "SELECT DISTINCT src, dst, upper(method) AS method, url_pattern, line FROM edges WHERE rel = 'calls_endpoint' AND method IS NOT NULL")
def _(g: Graph) -> DataFrame:
    return search.http_calls(g.edges)


@_add("api_changelog", "SELECT node_table, id, name, file_path, start_line, greatest(end_line - start_line, 0) AS size FROM ents WHERE node_table IN ('function', 'class') AND repo = 'atlas-core'")
def _(g: Graph) -> DataFrame:
    return search.api_changelog(g.entities("node_table", "repo", *_SIZED, tables=("function", "class")), "atlas-core")


@_add("largest_functions", "SELECT id, name, file_path, greatest(end_line - start_line, 0) AS size FROM fn ORDER BY size DESC NULLS LAST, id LIMIT 15")
def _(g: Graph) -> DataFrame:
    return search.largest(g.functions(*_SIZED))


@_add("list_all_classes", "SELECT id, name, file_path FROM ents WHERE node_table = 'class' ORDER BY name, id LIMIT 50")
def _(g: Graph) -> DataFrame:
    return search.list_all(g.entities("node_table", *_F, tables=("class",)), "class")


@_add("imports_list", "SELECT id, name, file_path, body FROM ents WHERE node_table = 'import_decl'")
def _(g: Graph) -> DataFrame:
    return search.imports_of(g.entities("node_table", "name", "file_path", "body", tables=("import_decl",)), None)


@_add(
    "ask_search_terms",
    "SELECT name, file_path, max(CAST(contains(lower(coalesce(name, '')), 'parse') OR contains(lower(coalesce(qualified_name, '')), 'parse') AS INT) + CAST(contains(lower(coalesce(name, '')), 'edge') OR contains(lower(coalesce(qualified_name, '')), 'edge') AS INT)) AS score FROM fn "
    "WHERE regexp_matches(lower(coalesce(name, '')), 'parse|edge') OR regexp_matches(lower(coalesce(qualified_name, '')), 'parse|edge') OR regexp_matches(lower(coalesce(signature, '')), 'parse|edge') GROUP BY 1, 2 ORDER BY score DESC, name, file_path LIMIT 30",
)
def _(g: Graph) -> DataFrame:
    return search.ask_terms(g.functions(*search.SYMBOL), ["parse", "Edge"])


@_add("compact_ultra_path", "SELECT id, CASE WHEN len(string_split(file_path, '/')) > 3 THEN '…/' || array_to_string(list_slice(string_split(file_path, '/'), -3, -1), '/') ELSE file_path END AS file_path FROM fn")
def _(g: Graph) -> DataFrame:
    return search.compact(g.functions("file_path", "signature", "body")).select("id", "file_path")


@_add("known_entities", "SELECT DISTINCT node_table || ':' || name || ':' || coalesce(qualified_name, '') AS entry FROM ents WHERE name IS NOT NULL")
def _(g: Graph) -> DataFrame:
    return search.catalogue(g.entities("node_table", "name", "qualified_name"))


@_add("repo_catalogue", "SELECT repo, count(*) AS n_entities FROM ents WHERE repo NOT LIKE '\\_%' ESCAPE '\\' AND NOT contains(repo, '.old.') GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return search.repos(g.entities("repo"))


_SUPPORTED = ", ".join(f"('{e}', '{lang}')" for e, lang in sorted(EXTENSIONS.items()))


@_add("supported_languages", f"SELECT * FROM (VALUES {_SUPPORTED}) t(extension, language)")
def _(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(sorted(EXTENSIONS.items()), "extension string, language string")


@_add("find_callers", f"SELECT DISTINCT d.name AS called, s.id, s.{_SYMBOL.replace(', ', ', s.')} FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE d.name IN (SELECT name FROM top_name) AND s.name IS NOT NULL")
def _(g: Graph) -> DataFrame:
    return graph.callers(g.functions(*search.SYMBOL), g.calls, _top_name(g))


@_add("find_callees", f"SELECT DISTINCT s.name AS caller, d.id, d.{_SYMBOL.replace(', ', ', d.')} FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE s.name IN (SELECT name FROM top_name) AND d.name IS NOT NULL")
def _(g: Graph) -> DataFrame:
    return graph.callees(g.functions(*search.SYMBOL), g.calls, _top_name(g))


_EXPLORE = """
ranked AS (SELECT e.id, e.name, e.file_path, array_position(['function', 'class', 'skill', 'config', 'api', 'package', 'file'], node_table) AS rank FROM ents e WHERE name IN (SELECT name FROM top_name)),
roots AS (SELECT id, name, file_path FROM ranked WHERE rank = (SELECT min(rank) FROM ranked WHERE rank > 0)),
linked AS (
  SELECT DISTINCT CASE WHEN rel = 'calls' THEN 'called_by' ELSE rel || '_from' END AS section, src AS id FROM edges WHERE rel IN ('calls', 'inherits', 'implements', 'links_to') AND dst IN (SELECT id FROM roots)
  UNION SELECT CASE WHEN rel = 'calls' THEN 'calls_to' ELSE rel || '_to' END, dst FROM edges WHERE rel IN ('calls', 'inherits', 'implements', 'links_to') AND src IN (SELECT id FROM roots))"""


@_add(
    "explore_function",
    "SELECT 'self' AS section, id, name, file_path FROM roots UNION ALL SELECT section, id, name, file_path FROM linked JOIN ents USING (id) UNION ALL SELECT 'siblings', id, name, file_path FROM ents WHERE node_table IN ('function', 'class') AND file_path IN (SELECT file_path FROM roots) AND id NOT IN (SELECT id FROM roots)",
    _EXPLORE,
)
def _(g: Graph) -> DataFrame:
    return graph.explore(g.entities("node_table", *_F), g.edges, _top_name(g))


@_add("file_context_external_callers", "SELECT f.id, f.name, f.file_path, count(DISTINCT s.name) AS n_external FROM fn f LEFT JOIN ucalls c ON c.dst = f.id LEFT JOIN fn s ON s.id = c.src AND s.file_path <> f.file_path GROUP BY ALL")
def _(g: Graph) -> DataFrame:
    return graph.external_callers(g.functions(*_F), g.calls)


@_add("context_cross_file_calls", "SELECT file_path, direction, count(*) AS n FROM (SELECT d.file_path, 'in' AS direction FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE s.file_path <> d.file_path UNION ALL SELECT s.file_path, 'out' FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE s.file_path <> d.file_path) GROUP BY ALL")
def _(g: Graph) -> DataFrame:
    return graph.cross_file_calls(g.functions("file_path"), g.calls)


@_add("endpoint_callers", "SELECT DISTINCT s.name AS caller, s.file_path, d.name AS endpoint, e.method FROM edges e JOIN ents s ON s.id = e.src JOIN ents d ON d.id = e.dst WHERE rel = 'calls_endpoint'")
def _(g: Graph) -> DataFrame:
    return graph.endpoint_callers(g.entities(*_F), g.edges)


_BACK = """tgt AS (SELECT id FROM ents WHERE name IN (SELECT name FROM top_name))"""


@_add(
    "backlinks",
    "SELECT DISTINCT CASE rel WHEN 'calls' THEN 'callers' WHEN 'contains' THEN 'containers' WHEN 'depends_on_package' THEN 'dependents' WHEN 'links_to' THEN 'wikilinks' WHEN 'inherits' THEN 'subtypes' ELSE 'implementors' END AS section, src AS id, name FROM edges JOIN ents ON ents.id = src "
    "WHERE rel IN ('calls', 'contains', 'depends_on_package', 'links_to', 'inherits', 'implements') AND dst IN (SELECT id FROM tgt) UNION ALL SELECT DISTINCT 'importers', id, ents.name FROM ents, top_name t WHERE node_table = 'import_decl' AND contains(body, t.name)",
    _BACK,
)
def _(g: Graph) -> DataFrame:
    return graph.backlinks(g.entities("node_table", "name", "body"), g.edges, _top_name(g))


@_add(
    "find_all_references",
    "SELECT 'definition' AS section, id, 1 AS n FROM ents WHERE node_table IN ('function', 'class') AND name IN (SELECT name FROM top_name) UNION ALL SELECT 'call', src, count(*) FROM calls WHERE dst IN (SELECT id FROM ents WHERE node_table IN ('function', 'class') AND name IN (SELECT name FROM top_name)) GROUP BY 2 "
    "UNION ALL SELECT 'import', id, 1 FROM ents, top_name t WHERE node_table = 'import_decl' AND contains(body, t.name)",
)
def _(g: Graph) -> DataFrame:
    return graph.references(g.entities("node_table", "name", "body"), g.edges, _top_name(g))


@_add(
    "safe_delete_check",
    "SELECT name, definitions, callers, coalesce(importers, 0) AS importers, callers = 0 AND coalesce(importers, 0) = 0 AS safe FROM defs LEFT JOIN imp USING (name)",
    "defs AS (SELECT name, count(*) AS definitions, coalesce(sum(c), 0)::BIGINT AS callers FROM fn LEFT JOIN (SELECT dst, count(*) AS c FROM ucalls GROUP BY 1) x ON x.dst = fn.id WHERE name IS NOT NULL GROUP BY 1), imp AS (SELECT name, count(*) AS importers FROM (SELECT id, unnest(list_distinct(regexp_split_to_array(body, '[^A-Za-z0-9_]+'))) AS name FROM ents WHERE node_table = 'import_decl') GROUP BY 1)",
)
def _(g: Graph) -> DataFrame:
    return graph.safe_delete(g.entities("node_table", "name", "body", tables=("function", "import_decl")), g.calls)


_HOPS = "h1 AS (SELECT DISTINCT src AS id FROM ucalls WHERE dst IN (SELECT id FROM top_id)), h2 AS (SELECT DISTINCT src AS id FROM ucalls WHERE dst IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT src AS id FROM ucalls WHERE dst IN (SELECT id FROM h2))"


@_add("call_hops_1_2_3", "SELECT 1 AS hop, count(*) AS n FROM h1 UNION ALL SELECT 2, count(*) FROM h2 UNION ALL SELECT 3, count(*) FROM h3", _HOPS)
def _(g: Graph) -> DataFrame:
    return graph.hops(g.calls, _top_id(g))


_IMPACT = "walk AS (SELECT {start} AS node, 0 AS hop FROM {first} UNION SELECT e.src, w.hop + 1 FROM walk w JOIN e ON e.dst = w.node WHERE w.hop < 3)"


@_add("impact_analysis_by_id", "SELECT node, min(hop) AS hop FROM walk GROUP BY 1 HAVING min(hop) > 0", "e AS (SELECT * FROM ucalls), " + _IMPACT.format(start="id", first="top_id"))
def _(g: Graph) -> DataFrame:
    return graph.impact(g.functions("name"), g.calls, _top_id(g).withColumnRenamed("id", "node"))


@_add("impact_analysis_by_name", "SELECT node, min(hop) AS hop FROM walk GROUP BY 1 HAVING min(hop) > 0", "e AS (SELECT DISTINCT s.name AS src, d.name AS dst FROM ucalls c JOIN fn s ON s.id = c.src JOIN fn d ON d.id = c.dst WHERE s.name IS NOT NULL AND d.name IS NOT NULL), " + _IMPACT.format(start="name", first="top_name"))
def _(g: Graph) -> DataFrame:
    return graph.impact(g.functions("name"), g.calls, _top_name(g).withColumnRenamed("name", "node"), by="name")


@_add(
    "type_hierarchy",
    "SELECT id, 'up' AS direction, relative, min(level) AS level FROM walk WHERE id <> relative GROUP BY 1, 3 UNION ALL SELECT relative, 'down', id, min(level) FROM walk WHERE id <> relative GROUP BY relative, id",
    "up AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('inherits', 'implements') AND src <> dst), walk AS (SELECT src AS id, dst AS relative, 1 AS level FROM up UNION SELECT w.id, up.dst, w.level + 1 FROM walk w JOIN up ON up.src = w.relative WHERE w.level < 5 AND w.id <> w.relative)",
)
def _(g: Graph) -> DataFrame:
    return graph.type_hierarchy(g.edges)


@_add("endpoint_closed_edges", "SELECT rel, src, dst FROM edges WHERE src IN (SELECT id FROM fn) AND dst IN (SELECT id FROM fn)")
def _(g: Graph) -> DataFrame:
    return graph.closed_edges(g.edges.select("rel", "src", "dst"), g.functions("node_table"))


@_add(
    "folder_clustering",
    "SELECT DISTINCT a.node AS src, b.node AS dst FROM edges e JOIN node a ON a.id = e.src JOIN node b ON b.id = e.dst WHERE a.node <> b.node",
    "place AS (SELECT id, CASE WHEN node_table <> 'file' AND contains(file_path, '/') THEN coalesce(repo, '') || ':' || array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') END AS cluster FROM ents), big AS (SELECT cluster FROM place WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(*) > 10), node AS (SELECT id, CASE WHEN cluster IN (SELECT cluster FROM big) THEN 'cluster:' || cluster ELSE id END AS node FROM place)",
)
def _(g: Graph) -> DataFrame:
    return graph.folder_clusters(g.entities("node_table", "repo", "file_path"), g.edges)


@_add("import_cycles", "SELECT DISTINCT p.a, p.b FROM p JOIN p q ON q.a = p.b AND q.b = p.a WHERE p.a < p.b", "p AS (SELECT DISTINCT s.file_path AS a, d.file_path AS b FROM ucalls c JOIN fn s ON s.id = c.src JOIN fn d ON d.id = c.dst WHERE s.repo = d.repo)")
def _(g: Graph) -> DataFrame:
    f = g.functions("repo", "file_path")
    both = g.calls.select("src", "dst").join(f.select(F.col("id").alias("src"), F.col("repo").alias("r1"), F.col("file_path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("repo").alias("r2"), F.col("file_path").alias("b")), "dst")
    return graph.two_cycles(both.where(F.col("r1") == F.col("r2")).select(F.col("a").alias("src"), F.col("b").alias("dst")))


@_add("centered_graph", "SELECT DISTINCT src, dst, rel FROM edges WHERE src IN (SELECT id FROM top_id) OR dst IN (SELECT id FROM top_id)")
def _(g: Graph) -> DataFrame:
    return graph.centered(g.edges, _top_id(g))


@_add("graph_siblings", "SELECT root, id, name FROM (SELECT r.id AS root, e.id, e.name, row_number() OVER (PARTITION BY r.id ORDER BY e.id) AS k FROM ents r JOIN ents e ON e.repo = r.repo AND e.file_path = r.file_path AND e.id <> r.id WHERE r.id IN (SELECT id FROM top_id) AND e.node_table IN ('function', 'class')) WHERE k <= 15")
def _(g: Graph) -> DataFrame:
    return graph.siblings(g.entities("node_table", "name", "repo", "file_path", tables=("function", "class")), _top_id(g))


_OVER = "top AS (SELECT ents.id, name, degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d JOIN ents USING (id) ORDER BY degree DESC, ents.id LIMIT 100)"


@_add("overview_nodes", "SELECT id, name, degree FROM top", _OVER)
def _(g: Graph) -> DataFrame:
    return graph.overview(g.entities("name"), g.edges)[0]


@_add("overview_edges", "SELECT DISTINCT src, dst, rel FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)", _OVER)
def _(g: Graph) -> DataFrame:
    return graph.overview(g.entities("name"), g.edges)[1]


@_add("skill_graph", "SELECT DISTINCT s.name AS note, coalesce(d.name, e.dst) AS target, e.context, e.src, e.dst FROM edges e JOIN ents s ON s.id = e.src LEFT JOIN ents d ON d.id = e.dst WHERE rel = 'links_to'")
def _(g: Graph) -> DataFrame:
    return graph.skill_graph(g.entities("name"), g.edges)


@_add(
    "skill_traverse",
    "SELECT 'note' AS section, id, name AS text FROM root UNION ALL SELECT DISTINCT 'link', dst, context FROM edges WHERE rel = 'links_to' AND src IN (SELECT id FROM root) UNION ALL SELECT DISTINCT 'part', dst, NULL FROM edges WHERE rel = 'contains' AND src IN (SELECT id FROM root) UNION ALL SELECT 'body', id, body FROM root",
    "root AS (SELECT id, name, body FROM ents WHERE node_table = 'skill' AND contains(lower(name), 'a') ORDER BY id LIMIT 1)",
)
def _(g: Graph) -> DataFrame:
    return graph.traverse_skills(g.entities("node_table", "name", "body", tables=("skill",)), g.edges, "a")


@_add("graph_stats", "SELECT node_table, count(*) AS n FROM ents GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return census.stats(g.entities("node_table"))


@_add("relation_stats", "SELECT rel, count(*) AS n FROM edges GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return census.relation_stats(g.edges)


@_add("fan_in_top", "SELECT dst AS id, count(*) AS n, name, file_path FROM calls JOIN fn ON fn.id = dst GROUP BY ALL ORDER BY n DESC, dst LIMIT 10")
def _(g: Graph) -> DataFrame:
    return census.fan(g.functions(*_F), g.calls, among=lambda ids: g.listed(ids, *_F))


@_add("fan_out_top", "SELECT src AS id, count(*) AS n, name, file_path FROM calls JOIN fn ON fn.id = src GROUP BY ALL ORDER BY n DESC, src LIMIT 10")
def _(g: Graph) -> DataFrame:
    return census.fan(g.functions(*_F), g.calls, "src", among=lambda ids: g.listed(ids, *_F))


@_add("dense_files", "SELECT repo, file_path, count(*) AS n_functions FROM fn GROUP BY ALL ORDER BY n_functions DESC, repo, file_path LIMIT 30")
def _(g: Graph) -> DataFrame:
    return census.dense_files(g.functions("repo", "file_path"))


_DEG = "deg AS (SELECT fn.id, fn.name, fn.repo, fn.file_path, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM fn LEFT JOIN (SELECT dst, count(*) AS i FROM ucalls GROUP BY 1) a ON a.dst = fn.id LEFT JOIN (SELECT src, count(*) AS o FROM ucalls GROUP BY 1) b ON b.src = fn.id)"


@_add("clusters", "SELECT repo, file_path, sum(out_degree)::BIGINT AS calls_out, sum(in_degree)::BIGINT AS calls_in, sum(out_degree + in_degree)::BIGINT AS total FROM deg GROUP BY 1, 2", _DEG)
def _(g: Graph) -> DataFrame:
    return census.clusters(g.functions("repo", "file_path"), g.calls)


@_add("bridges", "SELECT id, in_degree, out_degree, in_degree * out_degree AS score FROM deg WHERE in_degree * out_degree > 0 ORDER BY score DESC, id LIMIT 20", _DEG)
def _(g: Graph) -> DataFrame:
    return census.bridges(g.functions("name"), g.calls)


@_add("central", "SELECT id, name, in_degree FROM deg", _DEG)
def _(g: Graph) -> DataFrame:
    return census.central(g.functions("name"), g.calls)


_DUP = "SELECT body_hash, count(*) AS n, count(DISTINCT name) AS n_names, min(id) AS first_id FROM fn WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


@_add("duplicate_functions", _DUP)
def _(g: Graph) -> DataFrame:
    return census.duplicates(g.functions("name", "body_hash"), None)


@_add("duplicate_files", "SELECT sha256(content) AS body_hash, count(*) AS n, count(DISTINCT path) AS n_names, min(file_id) AS first_id FROM source_files WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(g: Graph) -> DataFrame:
    return census.duplicates(_as_bodies(g), None)


def _as_bodies(g: Graph) -> DataFrame:
    return g.table("source_files").select(F.col("file_id").alias("id"), F.col("path").alias("name"), F.col("repo").alias("file_path"), F.sha2("content", 256).alias("body_hash"))


@_add("duplicate_members", "SELECT sha256(content) AS body_hash, file_id AS id, path AS name, repo AS file_path FROM source_files WHERE sha256(content) IN (SELECT sha256(content) FROM source_files GROUP BY 1 HAVING count(*) > 1)")
def _(g: Graph) -> DataFrame:
    return census.duplicate_members(_as_bodies(g))


_UNUSED = ", ".join(f"'{n}'" for n in census.UNUSED_NAMES)


@_add(
    "unused_symbols",
    f"SELECT id, name, file_path, end_line - start_line AS size FROM fn f WHERE name IS NOT NULL AND name NOT IN ({_UNUSED}) AND NOT regexp_matches(name, '^(test_|Test|Execute|override)') AND end_line - start_line >= 1 AND NOT EXISTS (SELECT 1 FROM called c WHERE c.repo = f.repo AND c.name = f.name)",
    "called AS (SELECT DISTINCT repo, name FROM ucalls JOIN fn ON fn.id = dst)",
)
def _(g: Graph) -> DataFrame:
    return census.unused_symbols(g.functions("repo", *_SIZED), g.calls)


_DEAD = f"SELECT id, name, file_path, end_line - start_line AS size FROM fn WHERE end_line - start_line >= 3 AND NOT regexp_matches(coalesce(name, ''), '{census.ALIVE_NAME}') AND NOT regexp_matches(coalesce(signature, ''), '{census.ALIVE_SIGNATURE}') AND id NOT IN (SELECT dst FROM calls)"


@_add("dead_code", _DEAD)
def _(g: Graph) -> DataFrame:
    return census.dead_code(g.functions("signature", *_SIZED), g.calls)


@_add(
    "lint_smells",
    "SELECT 'god_function' AS smell, id AS subject, end_line - start_line AS measure FROM fn WHERE end_line - start_line > 40 UNION ALL SELECT 'fan_in', id, in_degree FROM deg WHERE in_degree > 8 UNION ALL SELECT 'fan_out', id, out_degree FROM deg WHERE out_degree > 8 "
    f"UNION ALL SELECT 'dense_file', repo || ':' || file_path, count(*) FROM fn GROUP BY repo, file_path HAVING count(*) > 12 UNION ALL SELECT 'duplicate_body', body_hash, n FROM ({_DUP})",
    _DEG,
)
def _(g: Graph) -> DataFrame:
    return census.smells(g.functions("repo", "body_hash", *_SIZED), g.calls)


@_add("god_functions", "SELECT id, name, end_line - start_line AS size FROM fn WHERE end_line - start_line > 15")
def _(g: Graph) -> DataFrame:
    return g.functions(*_SIZED).where(size_of() > 15).select("id", "name", size_of().alias("size"))


_LANG = "CASE lower(trim(language)) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'rb' THEN 'ruby' WHEN 'cu' THEN 'cuda' WHEN 'golang' THEN 'go' WHEN 'cs' THEN 'csharp' ELSE coalesce(lower(trim(language)), 'unknown') END"


@_add(
    "naming_census",
    f"SELECT language, sum(snake)::BIGINT AS snake, sum(camel)::BIGINT AS camel, sum(pascal)::BIGINT AS pascal, count(*) AS n, CAST(floor(sum(snake) * 100 / count(*)) AS INT) AS snake_pct FROM (SELECT {_LANG} AS language, CAST(contains(name, '_') AS INT) AS snake, CAST(NOT contains(name, '_') AND lower(name[1]) = name[1] AS INT) AS camel, CAST(NOT contains(name, '_') AND lower(name[1]) <> name[1] AS INT) AS pascal FROM fn WHERE name <> '') GROUP BY 1",
)
def _(g: Graph) -> DataFrame:
    return census.naming(g.functions("name", "language"))


@_add("naming_profile", "SELECT CASE WHEN contains(name, '_') AND lower(name) = name THEN 'snake' WHEN regexp_matches(name, '^[a-z].*[A-Z]') THEN 'camel' WHEN regexp_matches(name, '^[A-Z]') THEN 'pascal' ELSE 'none' END AS convention, count(*) AS n FROM fn WHERE name <> '' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return census.naming_strict(g.functions("name"))


@_add("import_styles", "SELECT CASE WHEN contains(trim(body), 'from ') THEN 'from' WHEN contains(body, 'require(') THEN 'require' WHEN starts_with(trim(body), 'use ') THEN 'use' WHEN contains(body, 'import') THEN 'import' ELSE 'other' END AS style, count(*) AS n FROM ents WHERE node_table = 'import_decl' AND body IS NOT NULL GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return census.import_styles(g.entities("node_table", "body", tables=("import_decl",)))


@_add(
    "language_distribution",
    f"SELECT language, coalesce(files, 0) AS files, coalesce(functions, 0) AS functions, avg_size, max_size FROM (SELECT {_LANG} AS language, count(*) AS files FROM source_files GROUP BY 1) a FULL JOIN (SELECT {_LANG} AS language, count(*) AS functions, round(avg(greatest(end_line - start_line, 0)), 4) AS avg_size, max(greatest(end_line - start_line, 0)) AS max_size FROM fn GROUP BY 1) b USING (language)",
)
def _(g: Graph) -> DataFrame:
    return census.languages(g.table("source_files"), g.functions("language", "start_line", "end_line"))


@_add("directory_census", "SELECT repo, split_part(path, '/', 1) AS directory, count(*) AS files FROM source_files GROUP BY ALL")
def _(g: Graph) -> DataFrame:
    return census.directories(g.table("source_files"))


@_add(
    "project_profile",
    "SELECT f.repo, files, coalesce(functions, 0) AS functions, coalesce(calls, 0) AS calls, CASE WHEN crates THEN 'Workspace' WHEN services THEN 'Services' WHEN components THEN 'Components' WHEN lib THEN 'Library' WHEN models AND handlers THEN 'MVC' WHEN handlers THEN 'Handlers' ELSE 'Standard' END AS architecture, main_language FROM f LEFT JOIN a USING (repo) LEFT JOIN c USING (repo) LEFT JOIN m USING (repo)",
    "f AS (SELECT repo, count(*) AS files, bool_or(regexp_matches(path, '(^|/)crates/')) AS crates, bool_or(regexp_matches(path, '(^|/)services/')) AS services, bool_or(regexp_matches(path, '(^|/)components/')) AS components, bool_or(regexp_matches(path, '^lib/')) AS lib, bool_or(regexp_matches(path, '(^|/)models?/')) AS models, bool_or(regexp_matches(path, '(^|/)handlers?/')) AS handlers FROM source_files GROUP BY 1), "
    f"a AS (SELECT repo, count(*) AS functions FROM fn GROUP BY 1), c AS (SELECT fn.repo, count(*) AS calls FROM calls JOIN fn ON fn.id = src GROUP BY 1), m AS (SELECT repo, language AS main_language FROM (SELECT repo, {_LANG} AS language, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, {_LANG} DESC) AS r FROM source_files GROUP BY 1, 2) WHERE r = 1)",
)
def _(g: Graph) -> DataFrame:
    return census.profile(g.table("source_files"), g.functions("repo"), g.calls)


@_add(
    "edit_preflight",
    "SELECT repo, file_path, count(*) AS n, round(avg(CAST(contains(name, '_') AS INT)), 6) AS snake_ratio, CASE WHEN avg(CAST(contains(name, '_') AS INT)) > 0.7 THEN 'snake_case' WHEN avg(CAST(contains(name, '_') AS INT)) < 0.3 THEN 'camelCase' ELSE 'mixed' END AS advice, coalesce(max(end_line) > 500, false) AS long_file FROM fn WHERE name <> '' GROUP BY 1, 2",
)
def _(g: Graph) -> DataFrame:
    return census.edit_preflight(g.functions("repo", "file_path", "name", "end_line"))


@_add(
    "index_insights",
    f"SELECT 'longest' AS insight, id AS subject, end_line - start_line AS n FROM fn WHERE end_line - start_line > 50 UNION ALL SELECT 'dead', id, size FROM ({_DEAD}) WHERE size >= 10 UNION ALL (SELECT 'dense', repo || ':' || file_path, count(*) AS n FROM fn GROUP BY repo, file_path ORDER BY n DESC, repo, file_path LIMIT 3) UNION ALL SELECT 'language', {_LANG}, count(*) FROM source_files GROUP BY 2",
)
def _(g: Graph) -> DataFrame:
    return census.insights(g.functions("repo", "signature", *_SIZED), g.calls, g.table("source_files"))


@_add(
    "resolve_call_targets",
    "SELECT src, old_dst, line, coalesce(first_id, old_dst) AS dst, first_id IS NOT NULL AS resolved FROM (SELECT src, dst AS old_dst, line, repo, coalesce(nullif(raw_callee, ''), list_last(string_split(dst, '_'))) AS name FROM edges WHERE rel = 'calls' AND dst NOT IN (SELECT id FROM ents)) LEFT JOIN (SELECT repo, name, min(id) AS first_id FROM fn WHERE name IS NOT NULL GROUP BY 1, 2) USING (repo, name)",
)
def _(g: Graph) -> DataFrame:
    return resolve.resolve_calls(g.entities("node_table", "name", "repo"), g.rel("calls"))


@_add("http_endpoint_link", "SELECT DISTINCT c.id AS call_id, a.id AS endpoint_id FROM (SELECT src AS id, lower(method || ' ' || url_pattern) AS key FROM edges WHERE rel = 'calls_endpoint') c JOIN (SELECT id, lower(name) AS key FROM ents WHERE node_table = 'api') a USING (key)")
def _(g: Graph) -> DataFrame:
    calls = g.rel("calls_endpoint").select(F.col("src").alias("id"), F.concat("method", F.lit(" "), "url_pattern").alias("name"))
    return resolve.link_endpoints(calls, g.entities("name", tables=("api",)))


@_add(
    "virtual_dispatch",
    "SELECT src, dst FROM (SELECT o.id AS src, f.id AS dst, row_number() OVER (PARTITION BY o.id ORDER BY f.id) AS r FROM o JOIN fn f ON f.name = o.name AND f.id <> o.id) WHERE r <= 10",
    "o AS (SELECT id, name FROM fn WHERE name IS NOT NULL AND (regexp_matches(coalesce(signature, ''), 'override|@Override') OR starts_with(coalesce(body, ''), '@Override') OR regexp_matches(coalesce(body, ''), '^[^\\n]*(\\n[^\\n]*){0,20}?\\n?\\s*@Override')))",
)
def _(g: Graph) -> DataFrame:
    return resolve.virtual_dispatch(g.functions("name", "qualified_name", "signature", "body"))


@_add(
    "cross_repo_links",
    "SELECT import_id, repo, path FROM (SELECT i.import_id, f.repo, f.path, row_number() OVER (PARTITION BY i.import_id ORDER BY f.repo, f.path) AS r FROM i JOIN f ON f.repo <> i.from_repo AND contains(f.path, i.module)) WHERE r <= 5",
    f"i AS (SELECT * FROM (SELECT import_id, from_repo, {_MODULE} AS module FROM (SELECT id AS import_id, repo AS from_repo, trim(body) AS b FROM ents WHERE node_table = 'import_decl' AND body IS NOT NULL)) WHERE module <> ''), f AS (SELECT DISTINCT repo, path FROM source_files WHERE path IS NOT NULL)",
)
def _(g: Graph) -> DataFrame:
    return resolve.link_repos(g.entities("node_table", "repo", "body", tables=("import_decl",)), g.table("source_files"))


@_add("skipped_files", f"SELECT file_id, regexp_matches(path, '{skip_pattern()}') OR octet_length(encode(content)) > {LARGEST} AS skipped FROM source_files")
def _(g: Graph) -> DataFrame:
    return g.table("source_files").select("file_id", code.skipped(F.col("path"), F.col("content")).alias("skipped"))


@_add("parse_sources", None)
def _(g: Graph) -> DataFrame:
    return code.parsed(spread(g.table("source_files").select("path", "content", "repo"))).groupBy("language", "row", "kind", "rel").agg(F.count(F.lit(1)).alias("n"))


@_add("file_hashes", "SELECT repo, path, sha256(content) AS hash FROM source_files")
def _(g: Graph) -> DataFrame:
    return code.files_of(g.table("source_files")).select("repo", "path", "hash")


@_add(
    "file_scopes",
    "SELECT DISTINCT file_path, CASE WHEN len(p) >= 3 AND p[1] IN ('crates', 'src', 'lib') THEN array_to_string(list_filter(list_slice(p, 2, len(p) - 2), lambda x: x <> 'src'), '::') WHEN len(p) >= 2 THEN array_to_string(list_slice(p, 1, len(p) - 1), '::') ELSE 'root' END AS scope FROM (SELECT file_path, string_split(file_path, '/') AS p FROM ents WHERE file_path IS NOT NULL)",
)
def _(g: Graph) -> DataFrame:
    return g.entities("file_path").where(F.col("file_path").isNotNull()).select("file_path", ids.file_scope(F.col("file_path")).alias("scope")).distinct()


@_add("sanitized_ids", "SELECT id, rtrim(substr(trim(regexp_replace(regexp_replace(qualified_name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 200), '_') AS key FROM ents")
def _(g: Graph) -> DataFrame:
    return g.entities("qualified_name").select("id", ids.sanitize_id(F.col("qualified_name")).alias("key"))


@_add("import_modules", f"SELECT id, {_MODULE} AS module FROM (SELECT id, trim(body) AS b FROM ents WHERE node_table = 'import_decl')")
def _(g: Graph) -> DataFrame:
    return g.entities("body", tables=("import_decl",)).select("id", ids.module_of_import(F.col("body")).alias("module"))


@_add("upsert_last_wins", "SELECT id, name, body_hash, start_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, row_id DESC) AS r FROM code_entities) WHERE r = 1")
def _(g: Graph) -> DataFrame:
    from ..plans.bind import latest

    return latest(g.table("code_entities"), "id", ["indexed_at", "row_id"], ["name", "body_hash", "start_line"])


@_add(
    "incremental_changed_files",
    "SELECT repo, path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (repo, path) WHERE o.h IS NULL OR o.h <> n.h OR n.h = ''",
    "o AS (SELECT repo, path, arg_max(coalesce(hash, ''), indexed_at) AS h FROM (SELECT * FROM source_files ORDER BY file_id) WHERE indexed_at < TIMESTAMP '2025-01-01' GROUP BY 1, 2), n AS (SELECT repo, path, arg_max(coalesce(hash, ''), indexed_at) AS h FROM (SELECT * FROM source_files ORDER BY file_id) GROUP BY 1, 2)",
)
def _(g: Graph) -> DataFrame:
    f = g.table("source_files").select("repo", "path", "hash", "indexed_at", "file_id")
    return store.changes(f.where(F.col("indexed_at") < F.lit("2025-01-01").cast("timestamp_ntz")), f)


@_add("delete_file_entities", "SELECT rel, src, dst FROM edges WHERE src NOT IN (SELECT id FROM ents WHERE file_path = (SELECT min(file_path) FROM fn)) AND dst NOT IN (SELECT id FROM ents WHERE file_path = (SELECT min(file_path) FROM fn))")
def _(g: Graph) -> DataFrame:
    e = g.entities("file_path", "node_table")
    path = e.where(F.col("node_table") == "function").agg(F.min("file_path").alias("p"))
    gone = e.join(F.broadcast(path), F.col("file_path") == F.col("p")).select("id")
    return store._without_ends(g.edges.select("rel", "src", "dst"), gone)


@_add("clear_repo", "SELECT id, repo FROM ents WHERE repo <> 'atlas-core' OR repo IS NULL")
def _(g: Graph) -> DataFrame:
    return store.without_repo(g.entities("repo", "node_table"), g.edges.select("src", "dst"), "atlas-core")[0].select("id", "repo")


@_add("obsidian_notes", "SELECT name || '.md' AS file, '# ' || name || chr(10) || chr(10) || file_path || chr(10) || chr(10) || '## Calls' || chr(10) || coalesce(links, 'none') || chr(10) AS text FROM top LEFT JOIN l USING (id) UNION ALL SELECT 'index.md', '# Index' || chr(10) || chr(10) || array_to_string(list_sort(list(DISTINCT '- [[' || name || ']]')), chr(10)) || chr(10) FROM top",
    "top AS (SELECT fn.id, name, file_path FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM ucalls UNION ALL SELECT dst FROM ucalls) GROUP BY 1) d JOIN fn USING (id) ORDER BY n DESC, fn.id LIMIT 50), l AS (SELECT c.src AS id, array_to_string(list_sort(list(DISTINCT '- [[' || d.name || ']]')), chr(10)) AS links FROM ucalls c JOIN top s ON s.id = c.src JOIN top d ON d.id = c.dst GROUP BY 1)")
def _(g: Graph) -> DataFrame:
    return store.notes(g.functions(*_F), g.calls)


@_add("raw_sql_view", "SELECT node_table, count(*) AS n FROM ents WHERE repo = 'atlas-core' GROUP BY 1")
def _(g: Graph) -> DataFrame:
    ask.register_views(g)
    return ask.raw_query(g.spark, "SELECT node_table, count(*) AS n FROM entities WHERE repo = 'atlas-core' GROUP BY node_table")[0]


@_add("ask_how_many", "SELECT count(*) AS n FROM fn")
def _(g: Graph) -> DataFrame:
    return ask.answer(g, "How many functions are there?")

