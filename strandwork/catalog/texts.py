"""Queries over notes, stored texts, history, vectors, conversations and activity, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, ask, conversation, history, knowledge, resolve, search, store, vectors
from ..plans.bind import Graph
from ..plans.cut import shared_dir
from ..plans.load import spread
from ..sources import code
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable:
    def take(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return take


def entries(g: Graph, wide: bool = False) -> DataFrame:
    """Documents as knowledge entries: the first 60 characters as title, source and language as tags, low confidence where the language is unknown."""
    d = g.table("documents")
    d = spread(d) if wide else d
    lang = F.lower(F.split_part("lang", F.lit("-"), F.lit(1)))
    tags = F.filter(F.array(F.lower(F.trim("source")), lang), lambda t: t.isNotNull())
    return d.select(
        F.col("doc_id").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("title"), F.coalesce("text", F.lit("")).alias("content"), "kind", F.coalesce("repo", F.lit("_global")).alias("repo"),
        F.when(F.col("lang").isNull() | (lang == "und"), "low").otherwise("high").alias("confidence"), tags.alias("tags"), "created_at", F.col("ingested_at").alias("updated_at"),
    )


_K = """
WITH k AS (
  SELECT doc_id AS id, substr(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') AS content, kind, coalesce(repo, '_global') AS repo,
    CASE WHEN lang IS NULL OR lower(split_part(lang, '-', 1)) = 'und' THEN 'low' ELSE 'high' END AS confidence,
    list_filter([lower(trim(source)), lower(split_part(lang, '-', 1))], lambda x: x IS NOT NULL) AS tags, created_at, ingested_at AS updated_at FROM documents),
topical AS (SELECT * FROM (SELECT id, kind, repo, title, created_at, unnest(list_distinct(tags)) AS tag FROM k) WHERE tag <> '' AND NOT regexp_matches(tag, '^(v[0-9]|status:|shipped:|session|phase-|bug:)'))
"""


@_add(
    "knowledge_search_scoped",
    _K + "SELECT id, title, kind, repo, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN repo = '_global' THEN 1 ELSE 0 END, updated_at DESC NULLS LAST, id) AS r FROM k WHERE (contains(lower(title), 'watcher') OR contains(lower(content), 'watcher') OR list_contains(tags, 'watcher')) AND repo IN ('atlas-core', '_global')) WHERE r = 1",
)
def _(g: Graph) -> DataFrame:
    return knowledge.search(entries(g), "watcher", "atlas-core", "both", limit=None)


@_add("memory_search", _K + "SELECT id, kind, title, created_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC NULLS LAST, id) AS r FROM k WHERE kind IN ('decision', 'problem', 'solution', 'note') AND (contains(lower(title), 'commit') OR contains(lower(content), 'commit'))) WHERE r <= 25 ORDER BY created_at DESC NULLS LAST, id LIMIT 50")
def _(g: Graph) -> DataFrame:
    return knowledge.memories(entries(g), "commit")


@_add("conversation_timeline", _K + "SELECT kind, id, title, created_at FROM k WHERE contains(content, 'Open question')")
def _(g: Graph) -> DataFrame:
    return knowledge.timeline(entries(g), "Open question")


@_add("decision_list", _K + "SELECT id, title, created_at FROM k WHERE kind = 'decision' ORDER BY created_at DESC NULLS LAST, id LIMIT 50")
def _(g: Graph) -> DataFrame:
    return knowledge.decisions(entries(g))


@_add("dream_arcs", _K + "SELECT tag, upper(substr(translate(tag, '-_', '  '), 1, 1)) || substr(translate(tag, '-_', '  '), 2) AS title, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, array_to_string(list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))), ',') AS kinds FROM topical GROUP BY tag HAVING count(*) >= 2")
def _(g: Graph) -> DataFrame:
    return knowledge.arcs(entries(g))


@_add("cross_repo_patterns", _K + "SELECT tag, count(DISTINCT repo) AS n_repos, count(*) AS total, arg_max(title, (coalesce(created_at, TIMESTAMP '0001-01-01'), id)) AS example FROM topical GROUP BY tag HAVING count(DISTINCT repo) >= 2")
def _(g: Graph) -> DataFrame:
    return knowledge.patterns(entries(g))


_STOP = ", ".join(f"'{w}'" for w in knowledge.STOP)
_BAG = _K + f", bag AS (SELECT id, kind, tags, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(title || ' ' || content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})))) AS bag FROM k)"
_PAIRS = _BAG + ", w AS (SELECT id, len(bag) AS n, unnest(bag) AS w FROM bag), o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM w a JOIN w b ON a.w = b.w AND a.id <> b.id GROUP BY ALL), p AS (SELECT a, b, i / (na + nb - i) AS score FROM o)"


@_add("meaningful_words", _BAG + "SELECT id, array_to_string(bag, ' ') AS words FROM bag")
def _(g: Graph) -> DataFrame:
    return knowledge.bags(entries(g)).select("id", F.array_join("bag", " ").alias("words"))


@_add("jaccard_duplicates", _PAIRS + ", d AS (SELECT a, min(b) FILTER (b < a) AS duplicate_of FROM p WHERE score >= 0.7 GROUP BY 1), t AS (SELECT a, count(DISTINCT bag) AS n FROM p JOIN bag ON bag.id = p.b WHERE score >= 0.7 AND score < 1 GROUP BY 1) SELECT id, duplicate_of, coalesce(n, 0) AS n_links FROM bag LEFT JOIN d ON d.a = id LEFT JOIN t ON t.a = id WHERE len(bag) > 0")
def _(g: Graph) -> DataFrame:
    return knowledge.duplicate_of(entries(g, wide=True))


_META = "(v[0-9]|status:|shipped:|session|phase-|bug:)"


@_add(
    "tag_suggestions",
    _BAG.replace("SELECT id, kind, tags,", "SELECT id, CASE WHEN confidence = 'low' THEN [] ELSE tags END AS tags,", 1)
    + f", tg AS (SELECT id, bag, unnest(list_distinct(tags)) AS tag FROM bag), tb AS (SELECT DISTINCT tag, unnest(bag) AS w FROM tg WHERE tag <> '' AND NOT regexp_matches(tag, '^{_META}')), tn AS (SELECT tag, count(*) AS tag_n FROM tb GROUP BY 1), "
    f"pl AS (SELECT id, len(bag) AS n, unnest(bag) AS w FROM bag WHERE len(list_filter(tags, lambda t: t <> '' AND NOT regexp_matches(t, '^{_META}'))) = 0), j AS (SELECT id, tag, i / (n + tag_n - i) AS s FROM (SELECT id, n, tag, count(*) AS i FROM pl JOIN tb USING (w) GROUP BY ALL) JOIN tn USING (tag)), "
    "pt AS (SELECT tag, w FROM (SELECT tag, unnest(regexp_split_to_array(lower(tag), '[-_]')) AS w FROM tn) WHERE length(w) >= 3), b AS (SELECT id, tag, 0.15 + 0.2 * least(count(*), 2) AS s FROM pl JOIN pt USING (w) GROUP BY 1, 2), "
    "best AS (SELECT id, tag, round(max(s), 6)::DOUBLE AS score FROM (SELECT id, tag, s::DOUBLE AS s FROM j UNION ALL SELECT id, tag, s::DOUBLE FROM b) GROUP BY 1, 2) SELECT id, tag, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rank FROM best WHERE score >= 0.12) WHERE rank <= 3",
)
def _(g: Graph) -> DataFrame:
    e = entries(g).withColumn("tags", F.when(F.col("confidence") == "low", F.array().cast("array<string>")).otherwise(F.col("tags")))
    return knowledge.suggest_tags(e)


@_add(
    "edge_proposals",
    _BAG.replace("SELECT id, kind, tags,", "SELECT id, kind, repo,", 1) + ", w AS (SELECT id, repo, kind, len(bag) AS n, unnest(bag) AS w FROM bag), o AS (SELECT a.id AS a, b.id AS b, a.kind AS x, b.kind AS y, a.n AS na, b.n AS nb, count(*) AS i FROM w a JOIN w b ON a.w = b.w AND a.repo = b.repo AND a.id <> b.id GROUP BY ALL), p AS (SELECT *, i / (na + nb - i) AS score FROM o), dup AS (SELECT DISTINCT a AS id FROM p WHERE score >= 0.7 AND b < a), "
    "r AS (SELECT a AS from_id, b AS to_id, round(score, 6) AS score, CASE WHEN x = 'solution' AND y = 'problem' THEN 'solves_for' WHEN x = 'decision' AND y IN ('problem', 'claim') THEN 'decided_about' WHEN (x = 'problem' AND y IN ('solution', 'decision')) OR (x = 'claim' AND y = 'decision') THEN NULL WHEN coalesce(x, '') = coalesce(y, '') THEN NULL WHEN score >= 0.4 THEN 'related_to' END AS relation FROM p WHERE score >= 0.3 AND a NOT IN (SELECT id FROM dup) AND b NOT IN (SELECT id FROM dup)) SELECT from_id, to_id, relation, score FROM r WHERE relation IS NOT NULL",
)
def _(g: Graph) -> DataFrame:
    return knowledge.proposals(entries(g, wide=True))


_SAY = "CASE WHEN kind = 'problem' THEN 'a problem appears' WHEN kind = 'solution' THEN 'a solution lands' WHEN kind = 'decision' THEN 'a decision is made' WHEN kind = 'claim' THEN 'a claim is made' ELSE coalesce(kind, 'a note is taken') END"
_FIRST = "regexp_extract(regexp_replace(coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|[-*+] |>|```|\\|)'))[1], ''), '[*_`]|\\[\\[|\\]\\]', '', 'g'), '^(.*?[.!?])(\\s|$)|^(.*)$', 0)"


@_add(
    "arc_narration",
    _K + f", a AS (SELECT k.id, k.title, k.content, k.kind, k.created_at, row_number() OVER (ORDER BY k.created_at NULLS FIRST, k.id) AS scene, {_SAY.replace('kind', 'k.kind')} AS say FROM topical t JOIN k USING (id) WHERE tag = 'postmortem') SELECT id, scene::INT AS scene, CASE WHEN scene = 1 THEN 'On ' || strftime(created_at, '%Y-%m-%d') || ' the story begins. ' || upper(say[1]) || substr(say, 2) ELSE 'Then, on ' || strftime(created_at, '%Y-%m-%d') || ', ' || say END || ': “' || title || '”. ' || {_FIRST} AS line FROM a",
)
def _(g: Graph) -> DataFrame:
    e = entries(g)
    return knowledge.narration(knowledge.topical(e, "id", "title", "content", "kind", "created_at").where(F.col("tag") == "postmortem"))


_LINKED_K = "l AS (SELECT from_id AS src, to_id AS dst, relation FROM r WHERE relation IS NOT NULL)"


def _linked(g: Graph) -> DataFrame:
    """The ends of the links that ``edge_proposals`` gives."""
    return knowledge.linked(entries(g, wide=True))


def _solved(g: Graph) -> DataFrame:
    """(dst): the problems that a link of ``edge_proposals`` solves."""
    return _linked(g).where((F.col("relation") == "solves_for") & ~F.col("source")).select(F.col("id").alias("dst"))


_WITH_LINKS = ORACLE["edge_proposals"].rsplit(" SELECT from_id", 1)[0] + ", " + _LINKED_K + " "


@_add("knowledge_lint", _WITH_LINKS + "SELECT 'kind' AS section, coalesce(kind, '') AS key, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'orphan', id::VARCHAR, 1 FROM k WHERE id NOT IN (SELECT src FROM l UNION SELECT dst FROM l) UNION ALL SELECT 'contradiction', id::VARCHAR, 1 FROM k WHERE kind = 'contradiction' UNION ALL SELECT 'low_confidence', id::VARCHAR, 1 FROM k WHERE confidence = 'low'")
def _(g: Graph) -> DataFrame:
    return knowledge.lint(entries(g), _linked(g).select(F.col("id").alias("src"), F.col("id").alias("dst")))


@_add("decision_get", _K + "SELECT id, title, content, created_at FROM k WHERE kind = 'decision' AND contains(lower(title), 'the') ORDER BY id LIMIT 1")
def _(g: Graph) -> DataFrame:
    return knowledge.decision(entries(g), "THE")


@_add("summary_counts", _WITH_LINKS + "SELECT kind AS fact, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1 UNION ALL SELECT 'open problems', count(*) FROM k WHERE kind = 'problem' AND id NOT IN (SELECT dst FROM l WHERE relation = 'solves_for') UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM insight_events WHERE session_id <> ''")
def _(g: Graph) -> DataFrame:
    return store.summary_counts(entries(g), _solved(g), g.table("insight_events").where(F.col("session_id") != "").select("session_id").distinct())


@_add("open_problems", _WITH_LINKS + "SELECT id, title FROM k WHERE kind = 'problem' AND id NOT IN (SELECT dst FROM l WHERE relation = 'solves_for')")
def _(g: Graph) -> DataFrame:
    return store.open_problems(entries(g), _solved(g))


@_add("context_summary", _K + " SELECT 'decision' AS section, id, title FROM (SELECT * FROM k WHERE kind = 'decision' ORDER BY created_at DESC NULLS LAST, id LIMIT 15) UNION ALL SELECT 'problem', id, title FROM (SELECT * FROM k WHERE kind = 'problem' ORDER BY created_at DESC NULLS LAST, id LIMIT 5) UNION ALL SELECT 'solution', id, title FROM (SELECT * FROM k WHERE kind = 'solution' ORDER BY created_at DESC NULLS LAST, id LIMIT 5)")
def _(g: Graph) -> DataFrame:
    return store.context_summary(entries(g))


@_add("web_search", _K + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, row_id DESC) AS r FROM code_entities) WHERE r = 1 AND NOT coalesce(is_deleted, false) AND node_table = 'function') SELECT type, id, name FROM (SELECT 'function' AS type, id, name FROM f WHERE contains(lower(name), 'watch') UNION ALL SELECT 'knowledge', id::VARCHAR, title FROM k WHERE contains(title, 'watch') OR contains(content, 'watch')) ORDER BY type, id LIMIT 20")
def _(g: Graph) -> DataFrame:
    return search.web_search(g.functions("name"), entries(g), "watch", 20)


@_add(
    "indexed_search",
    "SELECT item_id, title, source, kind, 2.0::DOUBLE * CAST(contains(lower(coalesce(title, '')), 'lazy') AS INT) + CAST(contains(lower(coalesce(body, '')), 'lazy') AS INT) AS score, substr(coalesce(body, ''), 1, 280) AS snippet FROM indexed_content WHERE contains(lower(coalesce(title, '')), 'lazy') OR contains(lower(coalesce(body, '')), 'lazy') ORDER BY score DESC, title NULLS FIRST, item_id LIMIT 50",
)
def _(g: Graph) -> DataFrame:
    return search.indexed_search(g.table("indexed_content"), "lazy")


@_add("indexed_upsert", "SELECT source, item_id, title, kind FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY indexed_at DESC, item_id DESC) AS r FROM indexed_content) WHERE r = 1")
def _(g: Graph) -> DataFrame:
    return store.store_indexed(g.table("indexed_content").select("item_id", "title", "source", "kind", "indexed_at")).select("source", "item_id", "title", "kind")


@_add("result_archive", "SELECT item_id, octet_length(encode(body)) > 4096 AS archived, CASE WHEN octet_length(encode(body)) > 4096 THEN array_to_string(list_slice(string_split(body, chr(10)), 1, 20), chr(10)) ELSE body END AS shown, CASE WHEN octet_length(encode(body)) > 4096 THEN substr(sha256(body), 1, 12) END AS archive_id FROM indexed_content WHERE body IS NOT NULL")
def _(g: Graph) -> DataFrame:
    return search.archive(g.table("indexed_content").where(F.col("body").isNotNull()), "item_id", "body")


_PLAIN = "regexp_replace(regexp_replace('<article><p>' || coalesce(body, '') || '</p></article>', '(?is)<script[\\s>].*?</script>|<style[\\s>].*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"


@_add("html_title_article", f"SELECT item_id, trim(coalesce(title, '') || ' & notes') AS title, length(trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'), ' '))::INT AS n_chars, true AS html FROM indexed_content")
def _(g: Graph) -> DataFrame:
    # the stored bodies are plain; each is framed as the page it came from
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit(" &amp; notes</title></head><body><article><p>"), F.coalesce("body", F.lit("")), F.lit("</p></article></body></html>"))
    return g.table("indexed_content").select("item_id", code.html_title(page).alias("title"), F.length(code.html_text(page)).alias("n_chars"), code.looks_like_html(page).alias("html"))


@_add("entity_links", "WITH n AS (SELECT DISTINCT name, lower(name) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, row_id DESC) AS r FROM code_entities) WHERE r = 1 AND NOT coalesce(is_deleted, false) AND node_table IN ('function', 'class') AND length(name) >= 4), t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id AS text_id, name FROM t JOIN n USING (w)")
def _(g: Graph) -> DataFrame:
    names = g.entities("node_table", "name").where(F.col("node_table").isin("function", "class")).select("name")
    return resolve.link_names(g.table("documents").select(F.col("doc_id").alias("text_id"), "text"), names)


_LINKED = ORACLE["entity_links"].replace("SELECT doc_id AS text_id, name FROM t JOIN n USING (w)", ", m AS (SELECT DISTINCT doc_id AS session, name FROM t JOIN n USING (w))")


_CLASSES = _LINKED + ", k AS (SELECT session, list_sort(list(name))::VARCHAR AS key FROM m GROUP BY 1), c AS (SELECT session, min(session) OVER (PARTITION BY key) AS cls, count(*) OVER (PARTITION BY key) AS size FROM k)"


def _mentions(g: Graph) -> DataFrame:
    names = g.entities("node_table", "name").where(F.col("node_table").isin("function", "class")).select("name")
    texts = g.table("documents").select(F.col("doc_id").alias("text_id"), "text")
    return resolve.link_names(texts, names).select(F.col("text_id").alias("session"), "name")


@_add("co_discussed", _CLASSES + ", p AS (SELECT DISTINCT cls, size, name FROM c JOIN m USING (session)) SELECT a.cls AS a, b.cls AS b, count(*) AS n, a.size AS n_a, b.size AS n_b FROM p a JOIN p b ON a.name = b.name AND (a.cls < b.cls OR a.cls = b.cls AND a.size > 1) GROUP BY ALL")
def _(g: Graph) -> DataFrame:
    return conversation.co_discussed(_mentions(g))


@_add("co_discussed_classes", _CLASSES + " SELECT session, cls, size FROM c")
def _(g: Graph) -> DataFrame:
    return conversation.discussion_classes(_mentions(g))


@_add("notes_for_file", _K + "SELECT id, kind, title, repo AS scope, CASE confidence WHEN 'high' THEN 1 ELSE 2 END AS tier, created_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE confidence WHEN 'high' THEN 1 ELSE 2 END, created_at DESC NULLS LAST, id) AS r FROM k WHERE kind IN ('decision', 'problem') AND contains(lower(repo), 'atlas-core')) WHERE r <= 5")
def _(g: Graph) -> DataFrame:
    e = entries(g).withColumns({"scope": F.col("repo"), "tier": F.when(F.col("confidence") == "high", 1).otherwise(2)})
    return knowledge.for_file(e, "atlas-core/main.rs")


@_add("arc_detail", _PAIRS.replace("FROM k)", "FROM k WHERE list_contains(tags, 'adr'))", 1) + ", d AS (SELECT a, min(b) FILTER (b < a) AS duplicate_of FROM p WHERE score >= 0.7 GROUP BY 1) SELECT k.id, title, k.kind, created_at, duplicate_of FROM k LEFT JOIN d ON d.a = k.id WHERE list_contains(tags, 'adr')")
def _(g: Graph) -> DataFrame:
    return knowledge.arc_detail(entries(g), "adr")


_WORD = "list_sum(list_transform(list_slice(embedding, {a}, {b}), lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (32 - i)::INT ELSE 0 END))::BIGINT"


@_add("vector_codes", f"SELECT vec_id, {_WORD.format(a=1, b=32)} AS high, {_WORD.format(a=33, b=64)} AS low FROM embeddings")
def _(g: Graph) -> DataFrame:
    return store.with_codes(g.table("embeddings")).select("vec_id", F.get("bits", F.lit(0)).alias("high"), F.get("bits", F.lit(1)).alias("low"))


@_add("packed_codes", f"SELECT vec_id, {_WORD.format(a=1, b=32)} AS high, {_WORD.format(a=33, b=64)} AS low FROM embeddings")
def _(g: Graph) -> DataFrame:
    return g.table("embeddings").select("vec_id", vectors.packed("embedding").alias("bits")).select("vec_id", F.get("bits", F.lit(0)).alias("high"), F.get("bits", F.lit(1)).alias("low"))


@_add("code_distance", "SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST((x[1] > 0) <> (x[2] > 0) AS INT)))::BIGINT AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(g: Graph) -> DataFrame:
    v = store.with_codes(g.table("embeddings"))
    both = v.select(F.col("vec_id").alias("a"), F.col("bits").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("bits").alias("y")), F.col("b") == F.col("a") + 1)
    return both.select("a", "b", vectors.hamming(F.col("x"), F.col("y")).cast("long").alias("distance"))


def _path(prefix: str = "") -> str:
    return f"{prefix}p_brand || '/' || {prefix}p_type"


def _commits(g: Graph) -> DataFrame:
    return g.table("orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


def _changes(g: Graph) -> DataFrame:
    p = g.table("part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("path"))
    return g.table("lineitem").select(F.col("l_orderkey").alias("commit"), "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("commit", "path")


_H = f"WITH ch AS (SELECT DISTINCT l_orderkey AS commit, {_path()} AS path FROM lineitem JOIN part ON l_partkey = p_partkey), cm AS (SELECT o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts FROM orders), ct AS (SELECT author, path, count(*) AS n FROM ch JOIN cm USING (commit) GROUP BY ALL) "


@_add("file_churn", _H + "SELECT path, count(*) AS commits FROM ch GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return history.file_churn(_changes(g))


@_add("change_coupling", _H + "SELECT a.path AS a, b.path AS b, count(*) AS n FROM ch a JOIN ch b ON a.commit = b.commit AND a.path < b.path GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return history.coupling(_changes(g))


@_add("contributor_map", _H + "SELECT author, path, n FROM ct")
def _(g: Graph) -> DataFrame:
    return history.contributors(_commits(g), _changes(g))


@_add("top_contributors", _H + "SELECT author, path, n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS r FROM ct) WHERE r <= 10")
def _(g: Graph) -> DataFrame:
    return history.top_contributors(_commits(g), _changes(g))


@_add("reviewers", _H + "SELECT author, sum(n)::BIGINT AS score FROM ct WHERE contains(path, 'Brand#11') OR contains('Brand#11', path) GROUP BY 1 ORDER BY score DESC, author LIMIT 5")
def _(g: Graph) -> DataFrame:
    return history.reviewers(_commits(g), _changes(g), ["Brand#11"])


@_add("hotspots", _H + f"SELECT p_partkey AS id, p_name AS name, {_path()} AS path, p_size AS size, coalesce(n, 0) AS churn, p_size * coalesce(n, 0) AS risk FROM part LEFT JOIN (SELECT path, count(*) AS n FROM ch GROUP BY 1) c ON c.path = {_path()} ORDER BY risk DESC, id LIMIT 30")
def _(g: Graph) -> DataFrame:
    f = g.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"), F.lit(0).alias("start_line"), F.col("p_size").alias("end_line"))
    return history.hotspots(f, _changes(g))


@_add("entity_evolution", _H + "SELECT path, commit, author, ts FROM ch JOIN cm USING (commit) WHERE contains(path, 'Brand#11')")
def _(g: Graph) -> DataFrame:
    return history.evolution(_commits(g), _changes(g), "Brand#11")


def _hunks(g: Graph) -> DataFrame:
    # each call's line, with five lines of context, is a hunk of its caller's file
    f = g.functions("repo", "file_path").select(F.col("id").alias("src"), F.concat_ws(":", "repo", "file_path").alias("path"))
    e = g.table("code_edges").where((F.lower("kind") == "calls") & F.col("line").isNotNull()).select(F.col("edge_id").alias("hunk"), F.col("from_entity").alias("src"), "line")
    return e.join(f, "src").select("hunk", "path", F.greatest(F.col("line") - 5, F.lit(1)).alias("first"), (F.col("line") + 5).alias("last"))


_FN = "WITH fn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, row_id DESC) AS r FROM code_entities) WHERE r = 1 AND NOT coalesce(is_deleted, false) AND node_table = 'function'), hk AS (SELECT edge_id AS hunk, name, concat_ws(':', repo, file_path) AS path, greatest(e.line - 5, 1) AS first, e.line + 5 AS last, e.line FROM (SELECT edge_id, from_entity, line FROM code_edges WHERE lower(kind) = 'calls' AND line IS NOT NULL) e JOIN fn ON fn.id = from_entity) "


def _symbols(g: Graph) -> DataFrame:
    return g.functions("name", "repo", "file_path", "start_line", "end_line").select("id", "name", F.concat_ws(":", "repo", "file_path").alias("path"), "start_line", "end_line")


@_add("review_hunk_overlap", _FN + "SELECT hunk, id FROM hk JOIN fn ON concat_ws(':', repo, file_path) = path AND first <= end_line AND last >= start_line WHERE start_line <= end_line")
def _(g: Graph) -> DataFrame:
    return history.overlaps(_hunks(g), _symbols(g))


@_add("hover_disambiguation", _FN + "SELECT hunk AS point, id, inside FROM (SELECT hunk, fn.id, concat_ws(':', repo, file_path) = path AND hk.line BETWEEN start_line AND end_line AS inside, row_number() OVER (PARTITION BY hunk ORDER BY coalesce(concat_ws(':', repo, file_path) = path AND hk.line BETWEEN start_line AND end_line, false) DESC, fn.id) AS r FROM hk JOIN fn ON fn.name = hk.name) WHERE r = 1")
def _(g: Graph) -> DataFrame:
    f = _symbols(g)
    e = g.table("code_edges").where((F.lower("kind") == "calls") & F.col("line").isNotNull()).select(F.col("edge_id").alias("point"), F.col("from_entity").alias("id"), "line")
    return history.symbol_at(e.join(f.select("id", "name", "path"), "id").select("point", "name", "path", "line"), f)


@_add("error_before_edit", "WITH e AS (SELECT session_id, event_id, kind FROM insight_events WHERE coalesce(session_id, '') <> '') SELECT session_id, event_id, before FROM (SELECT *, last_value(CASE WHEN kind = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE kind = 'file_edit'")
def _(g: Graph) -> DataFrame:
    e = g.table("insight_events").where(F.coalesce("session_id", F.lit("")) != "").select("session_id", "event_id", (F.col("kind") == "file_edit").alias("l"), (F.col("kind") == "error").alias("r"))
    return history.last_before(e, "session_id", "event_id", "l", "r")


_Q = "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), "
_HAM = "s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda x: CAST((x[1] > 0) <> (x[2] > 0) AS INT)))::INT AS distance FROM embeddings, q WHERE vec_id <> query_id), "
_COS = "round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6)"


@_add("binary_quantize", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def _(g: Graph) -> DataFrame:
    return g.table("embeddings").select("vec_id", vectors.bit_string(F.col("embedding")).alias("bits"))


@_add("hamming_topk", _Q + _HAM + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10")
def _(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    return vectors.hamming_topk(v, vectors.queries_of(v))


@_add("cosine_topk", _Q + f"r AS (SELECT query_id, vec_id, {_COS} AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) WHERE rank <= 10")
def _(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    return vectors.cosine_topk(v, vectors.queries_of(v))


@_add("semantic_two_stage", _Q + _HAM + f"c AS (SELECT query_id, vec_id, {_COS} AS score FROM s JOIN q USING (query_id) JOIN embeddings USING (vec_id) WHERE distance <= 31) SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 10")
def _(g: Graph) -> DataFrame:
    v = g.table("embeddings")
    return vectors.two_stage(v, vectors.queries_of(v))


@_add("embedding_stats", "SELECT count(embedding) AS n, max(len(embedding))::INT AS dims, count(embedding) * max(len(embedding)) * 4 / 1024 AS kb_float, count(embedding) * ceil(max(len(embedding)) / 8) / 1024 AS kb_bits FROM embeddings")
def _(g: Graph) -> DataFrame:
    return vectors.stats(g.table("embeddings"))


_E = "WITH e AS (SELECT *, CASE WHEN ts > 100000000000 THEN ts // 1000 ELSE ts END AS sec FROM insight_events WHERE ts <> 0), h AS (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H') AS hour FROM e) "


@_add("insight_summary", _E + "SELECT 'total' AS section, '' AS key, count(*) AS n FROM h UNION ALL SELECT 'repo', coalesce(repo, ''), count(*) FROM h GROUP BY 2 UNION ALL SELECT 'kind', coalesce(kind, ''), count(*) FROM h GROUP BY 2 UNION ALL SELECT 'hour', hour, count(*) FROM h GROUP BY 2")
def _(g: Graph) -> DataFrame:
    return activity.summary(g.table("insight_events"))


@_add("insight_hourly", _E + "SELECT hour, count(*) AS n FROM h GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return activity.hourly(g.table("insight_events"))


@_add("insight_rates", _E + "SELECT count(*) AS calls, min(sec) AS first_at, max(sec) AS last_at, (max(sec) - min(sec)) // 86400 AS span_days, count(*) // greatest((max(sec) - min(sec)) // 86400, 1) AS per_day FROM e")
def _(g: Graph) -> DataFrame:
    return activity.rates(g.table("insight_events"))


@_add("busiest_hours", _E + "SELECT hour, count(*) AS n FROM h GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def _(g: Graph) -> DataFrame:
    return activity.busiest_hours(g.table("insight_events"))


@_add(
    "recent_sessions",
    _E + ", s AS (SELECT *, CASE WHEN coalesce(session_id, '') = '' THEN 'legacy' ELSE session_id END AS session, coalesce(repo, '') AS r FROM e), g AS (SELECT session, min(sec) AS started_at, max(sec) AS ended_at, count(*) AS n, count(DISTINCT r) AS n_repos FROM s GROUP BY 1), f AS (SELECT session, r AS first_repo FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sec, event_id) AS k FROM s) WHERE k = 1), "
    "t AS (SELECT session, sec, event_id, row_number() OVER (PARTITION BY session ORDER BY sec DESC, event_id DESC) AS k FROM s), u AS (SELECT session, count(*) AS tail_n, arg_max(event_id, k) AS tail_first FROM t WHERE k <= 20 GROUP BY 1) SELECT session, started_at, ended_at, n, n_repos, first_repo, tail_n, tail_first FROM g JOIN f USING (session) JOIN u USING (session)",
)
def _(g: Graph) -> DataFrame:
    return activity.recent_sessions(g.table("insight_events"), None)


@_add("session_kinds", _E + "SELECT session, kind, count(*) AS n FROM (SELECT CASE WHEN coalesce(session_id, '') = '' THEN 'legacy' ELSE session_id END AS session, unnest([coalesce(kind, ''), 'repo:' || coalesce(repo, '')]) AS kind FROM e) GROUP BY 1, 2")
def _(g: Graph) -> DataFrame:
    return activity.session_kinds(g.table("insight_events"))


@_add("session_tails", _E + "SELECT session, event_id, sec AS at FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sec DESC, event_id DESC) AS k FROM (SELECT *, CASE WHEN coalesce(session_id, '') = '' THEN 'legacy' ELSE session_id END AS session FROM e)) WHERE k <= 20")
def _(g: Graph) -> DataFrame:
    return activity.session_tails(g.table("insight_events"))


@_add("gain_by_tool", "SELECT coalesce(kind, '') AS tool, count(*) AS calls, count(*) * 2500 AS tokens FROM insight_events GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return activity.gain(g.table("insight_events").select(F.col("kind").alias("tool")))


_TURNS = "t AS (SELECT doc_id AS conv_id, i - 1 AS line, x[i] AS turn FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n(user|assistant): ', chr(1) || '\\1: ', 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) u(i)), turns AS (SELECT conv_id, line, regexp_extract(turn, '^(user|assistant): ', 1) AS role, lower(regexp_replace(turn, '^(?:user|assistant): ', '')) AS low FROM t WHERE regexp_matches(turn, '^(user|assistant): '))"


def _score(signals: tuple[tuple[str, float], ...]) -> str:
    """The SQL of ``conversation.score`` over the text ``low``."""
    listed = ", ".join("{'p': '%s', 'w': %s}" % (p.replace("'", "''"), w) for p, w in signals)
    hits = f"list_filter([{listed}], lambda s: contains(low, s.p))"
    return f"round(least(coalesce(list_max(list_transform({hits}, lambda s: s.w::DOUBLE)), 0.0) + least(len({hits}) * 0.05, 0.2), 1.0), 4)::DOUBLE"


@_add("conversation_scores", f"WITH {_TURNS} SELECT conv_id, line::INT AS line, role, {_score(conversation.PROBLEM)} AS problem, {_score(conversation.SOLUTION)} AS solution, {_score(conversation.DECISION)} AS decision FROM turns")
def _(g: Graph) -> DataFrame:
    return conversation.scores(conversation.turns_of(g.table("documents")))


@_add("conversation_segments")
def _(g: Graph) -> DataFrame:
    return conversation.segments(conversation.turns_of(g.table("documents")))


@_add("solution_preceding_problem")
def _(g: Graph) -> DataFrame:
    return conversation.preceding_problem(conversation.segments(conversation.turns_of(g.table("documents"))))


@_add("compress_texts")
def _(g: Graph) -> DataFrame:
    return conversation.compressed(g.table("indexed_content").where(F.col("body").isNotNull()), "item_id", "body")


@_add("context_delta", "WITH o AS (SELECT source AS key, unnest(string_split(body, chr(10))) AS line FROM (SELECT source, arg_min(coalesce(body, ''), (indexed_at, item_id)) AS body FROM indexed_content GROUP BY 1)), n AS (SELECT source AS key, unnest(string_split(body, chr(10))) AS line FROM (SELECT source, arg_max(coalesce(body, ''), (indexed_at, item_id)) AS body FROM indexed_content GROUP BY 1)), d AS (SELECT key, line, coalesce(b.c, 0) - coalesce(a.c, 0) AS d FROM (SELECT key, line, count(*) AS c FROM o GROUP BY ALL) a FULL JOIN (SELECT key, line, count(*) AS c FROM n GROUP BY ALL) b USING (key, line)) SELECT key, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS change, line FROM d WHERE d <> 0 UNION ALL SELECT key, 'unchanged', NULL FROM d GROUP BY key HAVING max(abs(d)) = 0")
def _(g: Graph) -> DataFrame:
    i = g.table("indexed_content").withColumn("b", F.coalesce("body", F.lit("")))
    two = i.groupBy(F.col("source").alias("key")).agg(F.min_by("b", F.struct("indexed_at", "item_id")).alias("o"), F.max_by("b", F.struct("indexed_at", "item_id")).alias("n"))
    return store.delta(two.select("key", F.col("o").alias("text")), two.select("key", F.col("n").alias("text")))


_LOG = "WITH l AS (SELECT doc, (i - 1)::INT AS n, x[i] AS line, len(x) AS size FROM (SELECT item_id AS doc, regexp_split_to_array(body, '\\r?\\n') AS x FROM indexed_content WHERE kind = 'log' AND body IS NOT NULL), unnest(range(1, len(x) + 1)) t(i)) "
_CUT = _LOG + "SELECT doc, n, line FROM l WHERE size <= {passes} OR n < {head} OR n >= size - {tail} UNION ALL SELECT DISTINCT doc, {head}, '... ' || (size - {head} - {tail}) || ' lines ...' FROM l WHERE size > {passes}"


def _log_lines(g: Graph) -> DataFrame:
    return g.table("indexed_content").where(F.col("kind") == "log").select(F.col("item_id").alias("doc"), F.posexplode(F.split("body", "\r?\n")).alias("n", "line"))


@_add("short_log_output", _CUT.format(passes=46, head=30, tail=15))
def _(g: Graph) -> DataFrame:
    return ask.head_tail(_log_lines(g))


@_add("short_listing", _CUT.format(passes=60, head=20, tail=10))
def _(g: Graph) -> DataFrame:
    return ask.short_listing(_log_lines(g))


@_add("short_file", _CUT.format(passes=200, head=40, tail=20))
def _(g: Graph) -> DataFrame:
    return ask.short_file(_log_lines(g))


@_add("short_containers", _CUT.format(passes=40, head=20, tail=10))
def _(g: Graph) -> DataFrame:
    return ask.short_containers(_log_lines(g))


_KEPT = "(regexp_matches(ltrim(line), '^(Step |#|Successfully built|Successfully tagged|ERROR |error:|Sending build context)') OR (NOT starts_with(ltrim(line), '---') AND regexp_matches(ltrim(line), 'DONE|CACHED|^exporting ')))"


@_add("short_image_build", _LOG + f"SELECT doc, n, line FROM l WHERE {_KEPT} UNION ALL SELECT doc, max(m)::INT + 1, '... ' || count(*) || ' layer lines ...' FROM (SELECT *, size - 1 AS m FROM l) WHERE NOT {_KEPT} GROUP BY 1")
def _(g: Graph) -> DataFrame:
    return ask.short_image_build(_log_lines(g))


def _scratch(g: Graph, name: str) -> str:
    return f"{shared_dir(g.spark)}/strandwork-{name}-{uuid.uuid4().hex[:12]}"


@_add("stream_hourly_counts", ORACLE["insight_hourly"])
def _(g: Graph) -> DataFrame:
    name = f"hours_{uuid.uuid4().hex[:8]}"
    events = streams.event_stream(g.spark, f"{g.folder}/insight_events.parquet")
    streams.run_to_memory(streams.hourly_counts(events), name, _scratch(g, "hours"))
    return g.spark.table(name)


@_add("stream_incremental_index", "SELECT repo, path, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC NULLS LAST, file_id DESC) AS r FROM source_files) WHERE r = 1")
def _(g: Graph) -> DataFrame:
    scans = streams.event_stream(g.spark, f"{g.folder}/source_files.parquet", "file_id long, path string, repo string, hash string, indexed_at timestamp_ntz", per_batch=4)
    folder = _scratch(g, "index")
    streams.index_changes(scans, folder, _scratch(g, "index-check")).awaitTermination()
    return streams.latest_scans(streams.read_log(g.spark, folder))


def _texts(g: Graph) -> DataFrame:
    return streams.event_stream(g.spark, f"{g.folder}/documents.parquet", "doc_id long, text string")


@_add("stream_notification", "SELECT 'knowledge changed' AS title, count(*) AS n, 0 AS batch FROM documents")
def _(g: Graph) -> DataFrame:
    folder = _scratch(g, "notice")
    streams.notify(_texts(g), folder, _scratch(g, "notice-check")).awaitTermination()
    return g.spark.read.parquet(folder)


@_add("stream_known_texts", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(g: Graph) -> DataFrame:
    folder = _scratch(g, "texts")
    streams.index_texts(_texts(g), folder, _scratch(g, "texts-check"), None).awaitTermination()
    return streams.read_log(g.spark, folder).select("hash", "doc_id")


@_add("stream_progress", "SELECT 1 AS batches, count(*) AS n FROM documents")
def _(g: Graph) -> DataFrame:
    q = streams.index_texts(_texts(g), _scratch(g, "texts"), _scratch(g, "texts-check"), None)
    q.awaitTermination()
    batches, n = streams.progress(q)
    return g.spark.createDataFrame([(batches, n)], "batches int, n long")
