"""What surrounds a file, a change or a name: sections of a file, calls across files, reviews of changes, modes of search, views for editors and pages.

Every section is a tagged row of one frame, so a caller filters by section and no
section is gathered.  Starts (files, names) are frames; they are broadcast only where
their size was checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import module_of_import
from ..plans.cut import broadcast_if_small
from .graph import first_per

#: The sections of a file by the table of the symbols in it.
SECTIONS = {"function": "functions", "class": "classes", "import_decl": "imports", "config": "configs", "doc": "docs", "package": "packages", "infra": "infra"}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def file_context(entities: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, section, id, name, kind, start_line, end_line, of): all that a file of ``files(file_path)`` holds, by section, and who calls its functions from other files.

    In 'external_callers' a row is a caller, and ``of`` the function it calls; a repeated call is one row.
    """
    e = entities.select("id", "node_table", "name", "kind", "file_path", "start_line", "end_line")
    start = broadcast_if_small(files.select("file_path").distinct(), 256)
    named = F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv))
    inside = e.join(start, "file_path", "left_semi")
    held = inside.where(F.col("node_table").isin("file", *SECTIONS)).select("file_path", F.coalesce(F.try_element_at(named, F.col("node_table")), F.lit("file")).alias("section"), "id", "name", "kind", "start_line", "end_line", F.lit(None).cast("string").alias("of"))
    own = inside.where(F.col("node_table") == "function").select(F.col("id").alias("dst"), "file_path", F.col("name").alias("of"))
    far = e.select(F.col("id").alias("src"), "name", "kind", F.col("file_path").alias("their_file"), "start_line", "end_line")
    callers = calls.select("src", "dst").distinct().join(own, "dst").join(far, "src").where((F.col("their_file") != F.col("file_path")) & F.col("name").isNotNull())
    return held.unionByName(callers.select("file_path", F.lit("external_callers").alias("section"), F.col("src").alias("id"), "name", "kind", "start_line", "end_line", "of").distinct())


def cross_file_rows(functions: DataFrame, calls: DataFrame, files: DataFrame, limit: int | None = 20) -> DataFrame:
    """(file_path, direction, own, other, other_file): the first calls into and out of each file of ``files(file_path)`` from and to other files."""
    f = functions.select("id", "name", "file_path")
    start = broadcast_if_small(files.select("file_path").distinct(), 256)

    def side(direction: str, own: str, other: str) -> DataFrame:
        mine = f.join(start, "file_path", "left_semi").select(F.col("id").alias(own), F.col("name").alias("own"), "file_path")
        far = f.select(F.col("id").alias(other), F.col("name").alias("other"), F.col("file_path").alias("other_file"))
        rows = calls.select("src", "dst").join(mine, own).join(far, other).where((F.col("other_file") != F.col("file_path")) & F.col("other").isNotNull())
        return rows.select("file_path", F.lit(direction).alias("direction"), "own", "other", "other_file").distinct()

    rows = side("in", "dst", "src").unionByName(side("out", "src", "dst"))
    return first_per(rows, ["file_path", "direction"], [F.col("other"), F.col("other_file"), F.col("own")], limit) if limit is not None else rows


def importers(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, importer): files of the same repo with an import whose module stands in the path of one of ``files(repo, file_path)``; a few files, so they meet all imports."""
    modules = entities.where((F.col("node_table") == "import_decl") & F.col("body").isNotNull()).select("repo", F.col("file_path").alias("importer"), module_of_import(F.col("body")).alias("module")).where(F.col("module") != "").distinct()
    start = broadcast_if_small(files.select("repo", "file_path").distinct(), 256)
    return modules.join(start, "repo").where(F.contains("file_path", "module") & (F.col("importer") != F.col("file_path"))).select("file_path", "importer").distinct()


def implementors(entities: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, type, name, their_file): what implements a type of the name of a class in ``files(file_path)``."""
    c = entities.where(F.col("node_table") == "class").select("id", "name", "file_path").where(F.col("name").isNotNull())
    start = broadcast_if_small(files.select("file_path").distinct(), 256)
    types = c.join(start, "file_path", "left_semi").select("file_path", F.col("name").alias("type")).distinct()
    e = edges.where(F.col("rel") == "implements").select("src", "dst").distinct()
    known = e.join(c.select(F.col("id").alias("dst"), F.col("name").alias("type")), "dst").join(entities.select(F.col("id").alias("src"), "name", F.col("file_path").alias("their_file")), "src")
    return types.join(known, "type").select("file_path", "type", "name", "their_file").distinct()


def review_diff(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, change, id, name, start_line, end_line): each changed file with its functions and classes, or a row without where none is indexed."""
    s = symbols.select("repo", F.col("file_path").alias("path"), "id", "name", "start_line", "end_line")
    return changed.select("repo", "path", "change").join(s, ["repo", "path"], "left").select("repo", "path", "change", "id", "name", "start_line", "end_line")


def conversations_search(entries: DataFrame, mentions: DataFrame, query: str, limit: int = 20, kinds: tuple[str, ...] = ("decision", "problem", "solution", "topic")) -> DataFrame:
    """(section, id, title): the first hits of each kind in title or text, without case, and the decisions about a symbol of that name.

    ``mentions`` is (id, name), what entries say about symbols.
    """
    q = query.lower()
    hit = entries.where(F.col("kind").isin(*kinds) & (F.lower("title").contains(q) | F.lower("content").contains(q))).select("kind", "id", "title")
    rows = first_per(hit, ["kind"], [F.col("id")], limit).select(F.col("kind").alias("section"), "id", "title")
    about = entries.where(F.col("kind") == "decision").join(mentions.where(F.col("name") == query).select("id").distinct(), "id", "left_semi")
    return rows.unionByName(about.select(F.lit("linked_decisions").alias("section"), "id", "title"))


def suggest_structure(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo, indexed, language): whether a repo has symbols, in which case its profile answers, and the language that its marker files tell, by which a layout is suggested."""
    has = lambda *names: F.max(F.col("path").rlike("(?:^|/)(?:" + "|".join(names) + ")$").cast("int")) > 0
    first = [("rust", has(r"Cargo\.toml")), ("typescript", has(r"package\.json") & has(r"tsconfig\.json")), ("javascript", has(r"package\.json")), ("python", has(r"pyproject\.toml", r"requirements\.txt")), ("dart", has(r"pubspec\.yaml")), ("go", has(r"go\.mod")), ("csharp", has(r"[^/]+\.csproj", r"[^/]+\.sln"))]
    language: Column = F.lit("unknown")
    for name, there in reversed(first):
        language = F.when(there, name).otherwise(language)
    known = functions.select("repo").unionByName(classes.select("repo")).distinct().withColumn("there", F.lit(True))
    return files.where(F.col("path").isNotNull()).groupBy("repo").agg(language.alias("language")).join(known, "repo", "left").select("repo", F.coalesce("there", F.lit(False)).alias("indexed"), "language")


#: Modes of ``dispatch``.
MODES = ("exact", "fuzzy", "file", "cross_type", "neighborhood", "backlinks")


def dispatch(entities: DataFrame, edges: DataFrame, mode: str, query: str) -> DataFrame:
    """(section, id, name) of a search in one of ``MODES``; another mode is an error."""
    from . import graph, search

    name = entities.sparkSession.range(1).select(F.lit(query).alias("name"))
    functions = entities.where(F.col("node_table") == "function")
    plain = lambda s, df: df.select(F.lit(s).alias("section"), "id", "name")
    if mode == "exact":
        return plain("function", search.find_function(functions, query))
    if mode == "fuzzy":
        return plain("function", search.search_functions(functions, query))
    if mode == "file":
        return search.file_entities(entities, query).select(F.col("node_table").alias("section"), "id", "name")
    if mode == "cross_type":
        return search.cross_search(entities, query).select(F.col("node_table").alias("section"), "id", "name")
    if mode == "neighborhood":
        return graph.explore(entities, edges, name).select("section", "id", "name")
    if mode == "backlinks":
        return graph.backlinks(entities, edges, name)
    raise ValueError(f"unknown mode {mode!r}")


def file_list(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, path, language, line_count, n_symbols) of the latest scan of every file."""
    last = files.where(F.col("path").isNotNull()).groupBy("repo", "path").agg(F.max_by(F.struct("language", "line_count"), F.struct("indexed_at", "file_id")).alias("r"))
    n = entities.where(F.col("node_table").isin("function", "class")).groupBy("repo", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return last.join(n, ["repo", "path"], "left").select("repo", "path", "r.language", "r.line_count", F.coalesce("n", F.lit(0).cast("long")).alias("n_symbols"))


def node_detail(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, section, value, n): the fields of the nodes of ``ids(id)``, and their edges counted by relation and direction."""
    start = broadcast_if_small(ids.select("id").distinct(), 160)
    fields = ("name", "qualified_name", "file_path", "signature", "language")
    rows = entities.join(start, "id", "left_semi").select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in fields))).alias("x"))
    held = rows.where(F.col("x.value").isNotNull()).select("id", "x.section", "x.value", F.lit(1).cast("long").alias("n"))
    ends = [edges.join(start.withColumnRenamed("id", end), end, "left_semi").groupBy(F.col(end).alias("id"), "rel").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit(way).alias("section"), F.col("rel").alias("value"), "n") for end, way in (("src", "out"), ("dst", "in"))]
    return _union([held, *ends])


def conversation_feed(entries: DataFrame, limit: int = 100) -> DataFrame:
    """(id, kind, title, created_at): the newest entries of any kind."""
    return entries.where(F.col("kind").isNotNull()).select("id", "kind", "title", "created_at").orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def definition_and_references(functions: DataFrame, calls: DataFrame, names: DataFrame, include_declaration: bool = True) -> DataFrame:
    """(name, section, id, file_path, line) for an editor: the callers of a name at their line, and its definitions."""
    f = functions.select("id", "name", "file_path", "start_line")
    wanted = broadcast_if_small(names.select("name").distinct(), 160)
    own = f.join(wanted, "name", "left_semi")
    sites = calls.select("src", "dst", "line").join(own.select(F.col("id").alias("dst"), "name"), "dst").join(f.select(F.col("id").alias("src"), "file_path"), "src").select("name", F.lit("reference").alias("section"), F.col("src").alias("id"), "file_path", "line").distinct()
    return sites.unionByName(own.select("name", F.lit("definition").alias("section"), "id", "file_path", F.col("start_line").alias("line"))) if include_declaration else sites


def index_status(files: DataFrame, raw_entities: DataFrame) -> DataFrame:
    """(repo, scans, files, last_scan, versions, live, last_index): how far the index of each repo is."""
    f = files.where(F.col("repo").isNotNull()).groupBy("repo").agg(F.count(F.lit(1)).alias("scans"), F.countDistinct("path").alias("files"), F.max("indexed_at").alias("last_scan"))
    per_id = raw_entities.where(F.col("repo").isNotNull()).groupBy("repo", "id").agg(F.count(F.lit(1)).alias("v"), F.max("indexed_at").alias("t"), F.max_by(F.coalesce("is_deleted", F.lit(False)), F.struct("indexed_at", "row_id")).alias("gone"))
    e = per_id.groupBy("repo").agg(F.sum("v").alias("versions"), F.sum((~F.col("gone")).cast("long")).alias("live"), F.max("t").alias("last_index"))
    return f.join(e, "repo", "full").select("repo", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("scans", "files")), "last_scan", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("versions", "live")), "last_index")


def healthy(frame: DataFrame) -> DataFrame:
    """(ok) from a row that the session computes."""
    return frame.sparkSession.range(1).select(F.lit(True).alias("ok"))
