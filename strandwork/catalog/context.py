"""Queries on what surrounds files, changes and names, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, history, resolve, store
from ..plans.bind import Graph
from .code_graph import _BASE, _F, _MODULE, _SIZED, _top_id, _top_name
from .texts import _K, entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, ctes: str = "") -> Callable:
    def take(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        ORACLE[name] = _BASE + (ctes + ", " if ctes else "") + "nothing AS (SELECT 1)\n" + sql
        return f

    return take


def _top_file(g: Graph) -> DataFrame:
    return g.functions("file_path", "repo").join(F.broadcast(_top_id(g).limit(1)), "id", "left_semi").select("repo", "file_path")


_FILE = "p AS (SELECT repo, file_path FROM fn WHERE id IN (SELECT id FROM top_id))"
_SECTIONS = ", ".join(f"'{k}': '{v}'" for k, v in (*context.SECTIONS.items(), ("file", "file")))


@_add(
    "file_context",
    f"SELECT file_path, (MAP {{{_SECTIONS}}})[node_table] AS section, id, name, kind, start_line, end_line, NULL AS of FROM ents WHERE file_path IN (SELECT file_path FROM p) AND node_table IN ('file', 'function', 'class', 'import_decl', 'config', 'doc', 'package', 'infra') "
    "UNION ALL SELECT DISTINCT d.file_path, 'external_callers', s.id, s.name, s.kind, s.start_line, s.end_line, d.name FROM ucalls c JOIN fn d ON d.id = c.dst JOIN ents s ON s.id = c.src WHERE d.file_path IN (SELECT file_path FROM p) AND s.file_path <> d.file_path AND s.name IS NOT NULL",
    _FILE,
)
def _(g: Graph) -> DataFrame:
    return context.file_context(g.entities("node_table", "kind", *_SIZED), g.calls, _top_file(g))


@_add(
    "context_bundle",
    "SELECT file_path, direction, own, other, other_file FROM (SELECT *, row_number() OVER (PARTITION BY file_path, direction ORDER BY other, other_file, own) AS r FROM x) WHERE r <= 20",
    "x AS (SELECT DISTINCT d.file_path, 'in' AS direction, d.name AS own, s.name AS other, s.file_path AS other_file FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE s.file_path <> d.file_path AND s.name IS NOT NULL UNION SELECT DISTINCT s.file_path, 'out', s.name, d.name, d.file_path FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE s.file_path <> d.file_path AND d.name IS NOT NULL)",
)
def _(g: Graph) -> DataFrame:
    f = g.functions(*_F)
    return context.cross_file_rows(f, g.calls, f.select("file_path").where(F.col("file_path").isNotNull()))


def _type_files(g: Graph) -> DataFrame:
    """The files of the types that something implements."""
    c = g.entities("file_path", "repo", tables=("class",))
    return c.join(g.rel("implements").select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select("repo", "file_path").distinct()


_TYPES = "tf AS (SELECT DISTINCT repo, file_path FROM ents WHERE node_table = 'class' AND id IN (SELECT dst FROM edges WHERE rel = 'implements'))"


@_add(
    "impact_importers",
    f"SELECT DISTINCT tf.file_path, m.file_path AS importer FROM (SELECT repo, file_path, {_MODULE} AS module FROM (SELECT repo, file_path, trim(body) AS b FROM ents WHERE node_table = 'import_decl' AND body IS NOT NULL)) m JOIN tf ON tf.repo = m.repo AND contains(tf.file_path, m.module) AND m.file_path <> tf.file_path WHERE m.module <> ''",
    _TYPES,
)
def _(g: Graph) -> DataFrame:
    return context.importers(g.entities("node_table", "repo", "file_path", "body", tables=("import_decl",)), _type_files(g))


@_add("impact_implementors", "SELECT DISTINCT c.file_path, c.name AS type, s.name, s.file_path AS their_file FROM ents c JOIN ents t ON t.name = c.name AND t.node_table = 'class' JOIN edges e ON e.rel = 'implements' AND e.dst = t.id JOIN ents s ON s.id = e.src WHERE c.node_table = 'class' AND c.file_path IN (SELECT file_path FROM tf)", _TYPES)
def _(g: Graph) -> DataFrame:
    return context.implementors(g.entities("node_table", *_F), g.edges, _type_files(g))


_WHEN = "TIMESTAMP '2025-01-01'"
_CHANGED = f"o AS (SELECT repo, path, arg_max(coalesce(hash, ''), indexed_at) AS h FROM (SELECT * FROM source_files ORDER BY file_id) WHERE indexed_at < {_WHEN} GROUP BY 1, 2), n AS (SELECT repo, path, arg_max(coalesce(hash, ''), indexed_at) AS h FROM (SELECT * FROM source_files ORDER BY file_id) GROUP BY 1, 2), ch AS (SELECT repo, path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (repo, path) WHERE o.h IS NULL OR o.h <> n.h OR n.h = '')"


def _changed(g: Graph) -> DataFrame:
    f = g.table("source_files").select("repo", "path", "hash", "indexed_at", "file_id")
    return store.changes(f.where(F.col("indexed_at") < F.lit("2025-01-01").cast("timestamp_ntz")), f)


@_add("review_diff", "SELECT ch.repo, path, change, id, name, start_line, end_line FROM ch LEFT JOIN (SELECT * FROM ents WHERE node_table IN ('function', 'class')) s ON s.repo = ch.repo AND s.file_path = path", _CHANGED)
def _(g: Graph) -> DataFrame:
    return context.review_diff(_changed(g), g.entities("repo", *_SIZED, tables=("function", "class")))


@_add("review_callers", "SELECT DISTINCT ch.repo, path, d.id, c.src AS caller, regexp_matches(s.file_path, '(^|[/_.])(tests?|spec)([/_.]|$)') AS tested FROM ch JOIN fn d ON d.repo = ch.repo AND d.file_path = path JOIN ucalls c ON c.dst = d.id JOIN fn s ON s.id = c.src", _CHANGED)
def _(g: Graph) -> DataFrame:
    return history.callers_of_changed(_changed(g), g.functions("repo", "file_path"), g.calls)


_WORDS = "t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))) AS w FROM documents WHERE text IS NOT NULL)"


@_add(
    "conversations_search",
    "SELECT kind AS section, id, title FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS r FROM k WHERE kind IN ('decision', 'problem', 'solution', 'topic') AND (contains(lower(title), 'watcher') OR contains(lower(content), 'watcher'))) WHERE r <= 20",
    _K.strip().removeprefix("WITH ").strip(),
)
def _(g: Graph) -> DataFrame:
    e = entries(g)
    return context.conversations_search(e, e.select("id", F.lit("").alias("name")), "watcher")


@_add(
    "linked_decisions",
    "SELECT 'linked_decisions' AS section, id, title FROM k WHERE kind = 'decision' AND id IN (SELECT doc_id FROM t JOIN fn ON lower(fn.name) = w WHERE length(fn.name) >= 4 AND fn.name = (SELECT name FROM hit))",
    _K.strip().removeprefix("WITH ").strip() + ", " + _WORDS + ", hit AS (SELECT fn.name FROM t JOIN fn ON lower(fn.name) = w JOIN k ON k.id = doc_id WHERE k.kind = 'decision' AND length(fn.name) >= 4 GROUP BY 1 ORDER BY count(DISTINCT doc_id) DESC, 1 LIMIT 1)",
)
def _(g: Graph) -> DataFrame:
    e = entries(g)
    names = g.functions("name").select("name")
    said = resolve.link_names(e.where(F.col("kind") == "decision").select(F.col("id").alias("text_id"), F.col("content").alias("text")), names).select(F.col("text_id").alias("id"), "name")
    top = said.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(1).collect()
    return context.conversations_search(e, said, top[0]["name"] if top else "").where(F.col("section") == "linked_decisions")


_REPO = r"'(^|/)({0})$'"


@_add(
    "suggest_structure",
    "SELECT f.repo, coalesce(f.repo IN (SELECT repo FROM ents WHERE node_table IN ('function', 'class')), false) AS indexed, CASE WHEN rust THEN 'rust' WHEN pkg AND tsc THEN 'typescript' WHEN pkg THEN 'javascript' WHEN py THEN 'python' WHEN dart THEN 'dart' WHEN go THEN 'go' WHEN cs THEN 'csharp' ELSE 'unknown' END AS language FROM f",
    "f AS (SELECT repo, " + ", ".join(f"bool_or(regexp_matches(path, {_REPO.format(p)})) AS {n}" for n, p in (("rust", r"Cargo\.toml"), ("pkg", r"package\.json"), ("tsc", r"tsconfig\.json"), ("py", r"pyproject\.toml|requirements\.txt"), ("dart", r"pubspec\.yaml"), ("go", r"go\.mod"), ("cs", r"[^/]+\.csproj|[^/]+\.sln"))) + " FROM source_files WHERE path IS NOT NULL GROUP BY 1)",
)
def _(g: Graph) -> DataFrame:
    return context.suggest_structure(g.table("source_files"), g.functions("repo"), g.classes("repo"))


@_add(
    "search_dispatch",
    "SELECT 'exact' AS mode, 'function' AS section, id, name FROM fn WHERE name = 'parse_path' UNION ALL SELECT 'fuzzy', 'function', id, name FROM fn WHERE contains(lower(name), 'parse') UNION ALL SELECT 'file', node_table, id, name FROM ents WHERE node_table IN ('function', 'class') AND file_path = 'src/main.rs' "
    "UNION ALL SELECT 'cross_type', node_table, id, name FROM (SELECT *, row_number() OVER (PARTITION BY node_table ORDER BY id) AS r FROM ents WHERE contains(lower(name), 'edge')) WHERE r <= 20",
)
def _(g: Graph) -> DataFrame:
    e = g.entities()
    one = lambda mode, q: context.dispatch(e, g.edges, mode, q).select(F.lit(mode).alias("mode"), "section", "id", "name")
    return one("exact", "parse_path").unionByName(one("fuzzy", "parse")).unionByName(one("file", "src/main.rs")).unionByName(one("cross_type", "edge"))


@_add(
    "file_list",
    "SELECT l.repo, l.path, language, line_count, coalesce(n, 0) AS n_symbols FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC NULLS LAST, file_id DESC) AS r FROM source_files WHERE path IS NOT NULL) l LEFT JOIN (SELECT repo, file_path AS path, count(*) AS n FROM ents WHERE node_table IN ('function', 'class') GROUP BY 1, 2) s ON s.repo = l.repo AND s.path = l.path WHERE r = 1",
)
def _(g: Graph) -> DataFrame:
    return context.file_list(g.table("source_files"), g.entities("node_table", "repo", "file_path", tables=("function", "class")))


@_add(
    "node_detail",
    "SELECT id, section, value, 1 AS n FROM (SELECT id, unnest(['name', 'qualified_name', 'file_path', 'signature', 'language']) AS section, unnest([name, qualified_name, file_path, signature, language]) AS value FROM ents WHERE id IN (SELECT id FROM top_id)) WHERE value IS NOT NULL UNION ALL SELECT src, 'out', rel, count(*) FROM edges WHERE src IN (SELECT id FROM top_id) GROUP BY 1, 3 UNION ALL SELECT dst, 'in', rel, count(*) FROM edges WHERE dst IN (SELECT id FROM top_id) GROUP BY 1, 3",
)
def _(g: Graph) -> DataFrame:
    return context.node_detail(g.entities("name", "qualified_name", "file_path", "signature", "language"), g.edges, _top_id(g))


@_add("conversation_feed", "SELECT id, kind, title, created_at FROM k WHERE kind IS NOT NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 100", _K.strip().removeprefix("WITH ").strip())
def _(g: Graph) -> DataFrame:
    return context.conversation_feed(entries(g))


@_add(
    "editor_references",
    "SELECT DISTINCT d.name, 'reference' AS section, s.id, s.file_path, c.line FROM calls c JOIN fn d ON d.id = c.dst JOIN fn s ON s.id = c.src WHERE d.name IN (SELECT name FROM top_name) UNION ALL SELECT name, 'definition', id, file_path, start_line FROM fn WHERE name IN (SELECT name FROM top_name)",
)
def _(g: Graph) -> DataFrame:
    return context.definition_and_references(g.functions(*_SIZED), g.calls, _top_name(g))


@_add(
    "index_status",
    "SELECT repo, coalesce(scans, 0) AS scans, coalesce(files, 0) AS files, last_scan, coalesce(versions, 0)::BIGINT AS versions, coalesce(live, 0)::BIGINT AS live, last_index FROM (SELECT repo, count(*) AS scans, count(DISTINCT path) AS files, max(indexed_at) AS last_scan FROM source_files WHERE repo IS NOT NULL GROUP BY 1) FULL JOIN (SELECT repo, sum(v) AS versions, sum((NOT gone)::INT) AS live, max(t) AS last_index FROM (SELECT repo, id, count(*) AS v, max(indexed_at) AS t, arg_max(coalesce(is_deleted, false), (indexed_at, row_id)) AS gone FROM code_entities WHERE repo IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (repo)",
)
def _(g: Graph) -> DataFrame:
    return context.index_status(g.table("source_files"), g.table("code_entities"))


@_add("health_check", "SELECT true AS ok")
def _(g: Graph) -> DataFrame:
    return context.healthy(g.table("source_files"))


@_add(
    "commit_modified_files",
    "SELECT commit, min(file_id) AS file_id FROM c JOIN f ON f.path = c.path OR ends_with(f.path, '/' || c.path) GROUP BY commit, c.path",
    "c AS (SELECT DISTINCT file_id AS commit, array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS path FROM source_files WHERE path IS NOT NULL), f AS (SELECT path, min(file_id) AS file_id FROM source_files WHERE path IS NOT NULL GROUP BY 1)",
)
def _(g: Graph) -> DataFrame:
    f = g.table("source_files").where(F.col("path").isNotNull())
    parts = F.split("path", "/")
    return history.match_files(f, f.select(F.col("file_id").alias("commit"), F.when(F.size(parts) < 2, F.col("path")).otherwise(F.array_join(F.slice(parts, -2, 2), "/")).alias("path")))
