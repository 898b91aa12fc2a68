"""Symbol and text search: filters, projections, ranked and tagged unions.

Every ranking ends in a unique key, so results are the same in any engine; a
``limit`` of None keeps all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import short_path
from ..plans.bind import size_of

#: The projection of a symbol in results.
SYMBOL = ("name", "qualified_name", "file_path", "start_line", "end_line", "signature", "language")


def _top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit is not None else df


def find_function(functions: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Functions with exactly this name."""
    return _top(functions.where(F.col("name") == name).select("id", *SYMBOL), [F.col("id")], limit)


def search_functions(functions: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Functions whose name contains the pattern, whatever its case."""
    return _top(functions.where(F.lower("name").contains(pattern.lower())).select("id", *SYMBOL), [F.col("id")], limit)


def search_ranked(functions: DataFrame, calls: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """Matches by how many calls reach a function of their name; all matches are ranked before the limit."""
    hits = search_functions(functions, pattern)
    names = hits.select("name").distinct()
    callers = calls.join(functions.select(F.col("id").alias("dst"), "name"), "dst").join(names, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("callers"))
    ranked = hits.join(callers, "name", "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))
    return _top(ranked.select("id", "name", "file_path", "callers"), [F.desc("callers"), F.col("id")], limit)


def file_entities(symbols: DataFrame, path: str) -> DataFrame:
    """Functions and classes of a file, tagged by table."""
    return symbols.where((F.col("file_path") == path) & F.col("node_table").isin("function", "class")).select("id", "node_table", "kind", "name", "start_line", "end_line")


def cross_search(entities: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` hits of each table by id, tagged with the table.

    Ranks are taken per table and slice of ids first, so no table's hits meet in one task unranked.
    """
    hits = entities.where(F.lower("name").contains(keyword.lower())).select("node_table", "id", "name", "file_path", F.pmod(F.hash("id"), F.lit(32)).alias("slice"))
    local = hits.withColumn("r", F.row_number().over(Window.partitionBy("node_table", "slice").orderBy("id"))).where(F.col("r") <= limit)
    return local.withColumn("r", F.row_number().over(Window.partitionBy("node_table").orderBy("id"))).where(F.col("r") <= limit).select("node_table", "id", "name", "file_path")


def http_calls(edges: DataFrame, method: str | None = None) -> DataFrame:
    """Client calls to endpoints, of one method where given."""
    calls = edges.where((F.col("rel") == "calls_endpoint") & F.col("method").isNotNull())
    calls = calls.where(F.upper("method") == method.upper()) if method else calls
    return calls.select("src", "dst", F.upper("method").alias("method"), "url_pattern", "line").distinct()


def api_changelog(symbols: DataFrame, repo: str) -> DataFrame:
    """Functions and classes of a repo with their size."""
    return symbols.where((F.col("repo") == repo) & F.col("node_table").isin("function", "class")).select("node_table", "id", "name", "file_path", "start_line", size_of().alias("size"))


def largest(functions: DataFrame, k: int = 15) -> DataFrame:
    """The k longest functions."""
    return functions.select("id", "name", "file_path", size_of().alias("size")).orderBy(F.desc_nulls_last("size"), "id").limit(k)


def list_all(entities: DataFrame, node_table: str, limit: int = 50) -> DataFrame:
    """The first names of a table."""
    return entities.where(F.col("node_table") == node_table).select("id", "name", "file_path").orderBy("name", "id").limit(limit)


def imports_of(entities: DataFrame, limit: int | None = 50) -> DataFrame:
    """Import declarations by file."""
    rows = entities.where(F.col("node_table") == "import_decl").select("id", "name", "file_path", "body")
    return _top(rows, [F.col("file_path"), F.col("id")], limit)


def ask_terms(functions: DataFrame, terms: list[str], limit: int = 30) -> DataFrame:
    """Functions that contain any term in name, qualified name or signature, by how many terms are in the names; one per (name, file)."""
    terms = [t.lower() for t in terms]
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "qualified_name", "signature")}
    hit = reduce(lambda a, b: a | b, (c.contains(t) for t in terms for c in low.values()))
    score = reduce(lambda a, b: a + b, ((low["name"].contains(t) | low["qualified_name"].contains(t)).cast("int") for t in terms))
    one = functions.where(hit).groupBy("name", "file_path").agg(F.max(score).alias("score"))
    return one.orderBy(F.desc("score"), "name", "file_path").limit(limit)


def compact(df: DataFrame, heavy: tuple[str, ...] = ("body", "embedding", "binary_embedding", "signature", "qualified_name"), path: str = "file_path") -> DataFrame:
    """Results without heavy columns and with paths cut to their last segments."""
    slim = df.drop(*heavy)
    return slim.withColumn(path, short_path(F.col(path))) if path in slim.columns else slim


def indexed_search(items: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """Stored texts by 2 for a hit in the title and 1 for one in the body, with the first 280 characters; every word of the query may also match apart."""
    q = query.lower()
    title, body = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "body"))
    whole = title.contains(q) | body.contains(q)
    apart = reduce(lambda a, b: a & b, (title.contains(w) | body.contains(w) for w in q.split()))
    score = 2.0 * title.contains(q).cast("double") + body.contains(q).cast("double")
    rows = items.where(whole | apart).select("item_id", "title", "source", "kind", score.alias("score"), F.substring(F.coalesce("body", F.lit("")), 1, 280).alias("snippet"))
    return _top(rows, [F.desc("score"), F.asc_nulls_first("title"), F.col("item_id")], limit)


def web_search(functions: DataFrame, knowledge: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Functions by name without case, and notes by title or text with case."""
    f = functions.where(F.lower("name").contains(query.lower())).select(F.lit("function").alias("type"), F.col("id").cast("string").alias("id"), "name")
    k = knowledge.where(F.col("title").contains(query) | F.col("content").contains(query)).select(F.lit("knowledge").alias("type"), F.col("id").cast("string").alias("id"), F.col("title").alias("name"))
    return f.unionByName(k).orderBy("type", "id").limit(limit)


def catalogue(entities: DataFrame) -> DataFrame:
    """Known names as table:name:qualified name."""
    return entities.where(F.col("name").isNotNull()).select(F.concat_ws(":", "node_table", "name", F.coalesce("qualified_name", F.lit(""))).alias("entry")).distinct()


def repos(entities: DataFrame) -> DataFrame:
    """Repos with symbols; hidden (_…) and old (.old.) ones left out."""
    return entities.where(~F.col("repo").startswith("_") & ~F.col("repo").contains(".old.")).groupBy("repo").agg(F.count(F.lit(1)).alias("n_entities"))


def archive(results: DataFrame, key: str, text: str, limit: int = 4096, lines: int = 20) -> DataFrame:
    """Results over ``limit`` bytes as their first lines and an id to fetch the rest by."""
    big = F.octet_length(text) > limit
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return results.select(key, big.alias("archived"), F.when(big, head).otherwise(F.col(text)).alias("shown"), F.when(big, F.substring(F.sha2(text, 256), 1, 12)).alias("archive_id"))
